"""Section L: evaluation over scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import aggregates, evaluate
from txnrisk.plans.aggregates import rounded
from txnrisk.plans.registry import KEY, register, sq, with_scores
from txnrisk.sources.canonical import ROW_KEY, line_scores

RATES = ["accuracy", "precision", "recall", "f1", "specificity", "false_discovery_rate", "alerts_per_fraud"]


def _rate(n, d):
    return f"CASE WHEN {d} <> 0 THEN ({n})::DOUBLE / ({d}) ELSE 0 END"


def _f1(p, r):
    return f"CASE WHEN ({p}) + ({r}) <> 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END"


def _confusion_cte(threshold, source="scores", score="score"):
    return f"""c AS (SELECT count(*) FILTER ({score} >= {threshold} AND label = 1) AS tp, count(*) FILTER ({score} >= {threshold} AND label = 0) AS fp,
 count(*) FILTER ({score} < {threshold} AND label = 1) AS fn, count(*) FILTER ({score} < {threshold} AND label = 0) AS tn FROM {source})"""


P, R = _rate("tp", "(tp + fp)"), _rate("tp", "(tp + fn)")


@register(
    "l1_confusion",
    with_scores(
        f"""SELECT tp, fp, fn, tn, {sq(_rate('tp + tn', '(tp + fp + fn + tn)'), 8)} AS accuracy, {sq(P, 8)} AS precision, {sq(R, 8)} AS recall, {sq(_f1(P, R), 8)} AS f1,
{sq(_rate('tn', '(tn + fp)'), 8)} AS specificity, {sq(_rate('fp', '(tp + fp)'), 8)} AS false_discovery_rate, {sq(_rate('tp + fp', 'tp'), 8)} AS alerts_per_fraud FROM c""",
        _confusion_cte(0.5),
    ),
)
def l1(spark, sf_dir):
    return rounded(evaluate.confusion(line_scores(spark, sf_dir), "score", "label"), *RATES, digits=8)


CURVE = """g AS (SELECT score, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM scores GROUP BY 1),
cv AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC)),
pr AS (SELECT *, tp / (tp + fp) AS prec, tp / pos AS rec, fp / neg AS fpr FROM cv),
lg AS (SELECT *, coalesce(lag(prec) OVER (ORDER BY score DESC), 1) AS prec0, coalesce(lag(rec) OVER (ORDER BY score DESC), 0) AS rec0, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS fpr0 FROM pr)"""


@register("l2_average_precision", with_scores(f"SELECT {sq('sum((rec - rec0) * prec)', 8)} AS average_precision FROM lg", CURVE))
def l2(spark, sf_dir):
    out = evaluate.ranking_metrics(line_scores(spark, sf_dir), "score", "label")
    return rounded(out.select("average_precision"), "average_precision", digits=8)


@register("l3_trapezoid_pr_auc", with_scores(f"SELECT {sq('sum((rec - rec0) * (prec + prec0) / 2)', 8)} AS pr_auc FROM lg", CURVE))
def l3(spark, sf_dir):
    out = evaluate.ranking_metrics(line_scores(spark, sf_dir), "score", "label")
    return rounded(out.select("pr_auc"), "pr_auc", digits=8)


@register("l4_roc_auc", with_scores(f"SELECT {sq('sum((fpr - fpr0) * (rec + rec0) / 2)', 8)} AS roc_auc FROM lg", CURVE))
def l4(spark, sf_dir):
    out = evaluate.ranking_metrics(line_scores(spark, sf_dir), "score", "label")
    return rounded(out.select("roc_auc"), "roc_auc", digits=8)


@register("l5_curve_table", with_scores(f"SELECT score AS threshold, {sq('rec', 8)} AS tpr, {sq('fpr', 8)} AS fpr, {sq('prec', 8)} AS precision, {sq('rec', 8)} AS recall FROM pr", CURVE))
def l5(spark, sf_dir):
    out = evaluate.curve_table(evaluate.curve(line_scores(spark, sf_dir), "score", "label"))
    return rounded(out, "tpr", "fpr", "precision", "recall", digits=8)


@register("l6_youden", with_scores(f"SELECT score AS optimal_threshold, {sq('rec', 8)} AS tpr, {sq('fpr', 8)} AS fpr, {sq('rec - fpr', 8)} AS j_score FROM pr ORDER BY rec - fpr DESC, score DESC LIMIT 1", CURVE))
def l6(spark, sf_dir):
    out = evaluate.youden(evaluate.curve(line_scores(spark, sf_dir), "score", "label"))
    return rounded(out, "tpr", "fpr", "j_score", digits=8)


RANKED = f"""rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, {KEY}) AS r, count(*) OVER () AS n, sum(label) OVER () AS pos FROM scores)"""


@register(
    "l7_metrics_at_k",
    with_scores(
        f"""SELECT k, CAST(sum(label) FILTER (r <= k) AS BIGINT) AS hits, {sq('sum(label) FILTER (r <= k)::DOUBLE / k', 8)} AS precision, {sq('sum(label) FILTER (r <= k)::DOUBLE / any_value(pos)', 8)} AS recall
FROM rk, (SELECT DISTINCT least(x, (SELECT count(*) FROM scores)) AS k FROM (SELECT unnest([100, 500, 1000, 100000000]) AS x)) GROUP BY 1""",
        RANKED,
    ),
)
def l7(spark, sf_dir):
    out = evaluate.metrics_at_k(line_scores(spark, sf_dir), "score", "label", [100, 500, 1000, 100_000_000], ROW_KEY)
    return rounded(out, "precision", "recall", digits=8)


@register(
    "l8_metrics_at_share",
    with_scores(
        f"""SELECT share, CAST(kk AS BIGINT) AS k, CAST(sum(label) FILTER (r <= kk) AS BIGINT) AS hits, {sq('sum(label) FILTER (r <= kk)::DOUBLE / kk', 8)} AS precision, {sq('sum(label) FILTER (r <= kk)::DOUBLE / any_value(pos)', 8)} AS recall
FROM rk, (SELECT share, greatest(1, floor((SELECT count(*) FROM scores) * share)) AS kk FROM (SELECT unnest([0.01,0.05,0.1,0.2,0.5]::DOUBLE[]) AS share)) GROUP BY share, kk""",
        RANKED,
    ),
)
def l8(spark, sf_dir):
    out = evaluate.metrics_at_share(line_scores(spark, sf_dir), "score", "label", ROW_KEY, limit=10_000)
    return rounded(out, "precision", "recall", digits=8)


@register(
    "l9_alert_efficiency",
    with_scores(
        f"""SELECT level, min(r) AS n_alerts, {sq('min(r)::DOUBLE / any_value(n)', 8)} AS alert_rate, {sq('min(ctp)::DOUBLE / any_value(pos)', 8)} AS achieved FROM
(SELECT *, sum(label) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS ctp FROM rk), (SELECT unnest([0.5,0.7,0.8,0.9,0.95]::DOUBLE[]) AS level) WHERE ctp >= floor(pos * level) GROUP BY 1""",
        RANKED,
    ),
)
def l9(spark, sf_dir):
    out = evaluate.alert_efficiency(line_scores(spark, sf_dir), "score", "label", ROW_KEY)
    return rounded(out, "alert_rate", "achieved", digits=8)


THRESHOLDS = f"""th AS (SELECT t AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp,
 count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn, count(*) AS n FROM scores, (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]::DOUBLE[]) AS t) GROUP BY 1),
tt AS (SELECT *, {R} AS recall, {P} AS precision, {_f1(P, R)} AS f1, (tp + fp)::DOUBLE / n AS flagged_rate, fp * 1.0::DOUBLE + fn * 100.0::DOUBLE AS total_cost FROM th),
tc AS (SELECT *, total_cost / n AS cost_per_transaction, recall >= 0.8 AS recall_ok, flagged_rate <= 0.05 AS flagged_ok, recall >= 0.8 AND flagged_rate <= 0.05 AS compliant FROM tt),
ts AS (SELECT *, CASE WHEN compliant THEN 1000 ELSE 0 END + recall * 100 + greatest(0, 1 - cost_per_transaction) * 50 + precision * 25 AS composite FROM tc)"""


def _table(spark, sf_dir):
    return evaluate.threshold_table(line_scores(spark, sf_dir), "score", "label", [i / 10 for i in range(1, 10)])


@register("l10_threshold_table", with_scores(f"SELECT threshold, {sq('recall', 8)} AS recall, {sq('precision', 8)} AS precision, {sq('f1', 8)} AS f1, {sq('flagged_rate', 8)} AS flagged_rate FROM ts", THRESHOLDS))
def l10(spark, sf_dir):
    out = _table(spark, sf_dir).select("threshold", "recall", "precision", "f1", "flagged_rate")
    return rounded(out, "recall", "precision", "f1", "flagged_rate", digits=8)


@register("l10_best_f1", with_scores(f"SELECT threshold, {sq('f1', 8)} AS f1 FROM ts ORDER BY ts.f1 DESC, threshold LIMIT 1", THRESHOLDS))
def l10_best(spark, sf_dir):
    return rounded(evaluate.best_threshold(_table(spark, sf_dir), "f1").select("threshold", "f1"), "f1", digits=8)


COSTS = "co AS (SELECT score AS threshold, fp, pos - tp AS fn, fp * 50.0::DOUBLE + (pos - tp) * 5000.0::DOUBLE AS total_cost, (fp * 50.0::DOUBLE + (pos - tp) * 5000.0::DOUBLE) / (pos + neg) AS per FROM cv)"


@register(
    "l11_cost_curve",
    with_scores(f"SELECT threshold, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, total_cost, {sq('per', 6)} AS cost_per_transaction FROM co", CURVE, COSTS),
)
def l11(spark, sf_dir):
    out = evaluate.cost_curve(evaluate.curve(line_scores(spark, sf_dir), "score", "label"))
    return rounded(out, "cost_per_transaction", digits=6)


@register(
    "l11_cheapest_threshold",
    with_scores(f"SELECT threshold, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, total_cost, {sq('per', 6)} AS cost_per_transaction FROM co ORDER BY total_cost, threshold LIMIT 1", CURVE, COSTS),
)
def l11_best(spark, sf_dir):
    out = evaluate.cost_curve(evaluate.curve(line_scores(spark, sf_dir), "score", "label"))
    return rounded(evaluate.best_threshold(out, "total_cost", lowest=True), "cost_per_transaction", digits=6)


@register("l11_threshold_costs", with_scores(f"SELECT threshold, total_cost, {sq('cost_per_transaction', 8)} AS cost_per_transaction FROM ts", THRESHOLDS))
def l11_table(spark, sf_dir):
    return rounded(_table(spark, sf_dir).select("threshold", "total_cost", "cost_per_transaction"), "cost_per_transaction", digits=8)


@register("l12_compliance", with_scores("SELECT threshold, recall_ok, flagged_ok, compliant FROM ts", THRESHOLDS))
def l12(spark, sf_dir):
    return _table(spark, sf_dir).select("threshold", "recall_ok", "flagged_ok", "compliant")


@register("l13_composite_score", with_scores(f"SELECT threshold, {sq('composite', 6)} AS composite FROM ts ORDER BY ts.composite DESC, threshold LIMIT 1", THRESHOLDS))
def l13(spark, sf_dir):
    return rounded(evaluate.best_threshold(_table(spark, sf_dir), "composite").select("threshold", "composite"), "composite", digits=6)


LONG = "lm AS (SELECT 'points' AS model, score, label FROM scores UNION ALL SELECT 'quantity', score_b, label FROM scores)"


def _long(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    a = rows.select(F.lit("points").alias("model"), "score", "label")
    return a.unionByName(rows.select(F.lit("quantity").alias("model"), F.col("score_b").alias("score"), "label"))


MODEL_CONFUSION = f"""mc AS (SELECT model, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
 count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM lm GROUP BY 1),
mr AS (SELECT model, {P} AS precision, {R} AS recall, {_f1(P, R)} AS f1, (tp + fp)::DOUBLE / (tp + fp + fn + tn) AS flagged, fp * 1.0::DOUBLE + fn * 100.0::DOUBLE AS total_cost FROM mc)"""


@register(
    "l14_choose_model",
    with_scores(
        f"""SELECT model, {sq('recall', 8)} AS recall, compliant, CASE (SELECT count(*) FROM x WHERE compliant) WHEN 0 THEN 'fallback_recall' WHEN 1 THEN 'unique_compliant' ELSE 'best_recall_among_compliant' END AS reason
FROM x ORDER BY compliant DESC, x.recall DESC, model LIMIT 1""",
        LONG, MODEL_CONFUSION, "x AS (SELECT model, recall, recall >= 0.8 AND flagged <= 0.05 AS compliant FROM mr)",
    ),
)
def l14(spark, sf_dir):
    table = evaluate.threshold_table(_long(spark, sf_dir), "score", "label", [0.5], ["model"])
    return rounded(evaluate.choose_model(table.select("model", "recall", "compliant")), "recall", digits=8)


@register("l14_cheapest_model", with_scores("SELECT model, total_cost FROM mr ORDER BY total_cost, model LIMIT 1", LONG, MODEL_CONFUSION))
def l14_cheapest(spark, sf_dir):
    table = evaluate.threshold_table(_long(spark, sf_dir), "score", "label", [0.5], ["model"])
    return evaluate.cheapest_model(table)


KEYED_CURVE = """kg AS (SELECT model, score, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM lm GROUP BY 1, 2),
kc AS (SELECT model, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS pos, sum(n) OVER (PARTITION BY model) AS neg FROM kg WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
kp AS (SELECT *, tp / (tp + fp) AS prec, tp / pos AS rec, fp / neg AS fpr FROM kc),
kl AS (SELECT *, coalesce(lag(prec) OVER w, 1) AS prec0, coalesce(lag(rec) OVER w, 0) AS rec0, coalesce(lag(fpr) OVER w, 0) AS fpr0 FROM kp WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
ka AS (SELECT model, sum((rec - rec0) * prec) AS ap, sum((rec - rec0) * (prec + prec0) / 2) AS pr, sum((fpr - fpr0) * (rec + rec0) / 2) AS roc FROM kl GROUP BY 1)"""


@register(
    "l15_compare_models",
    with_scores(
        f"""SELECT ka.model, {sq('ap', 8)} AS average_precision, {sq('pr', 8)} AS pr_auc, {sq('roc', 8)} AS roc_auc, {sq('precision', 8)} AS precision, {sq('recall', 8)} AS recall, {sq('f1', 8)} AS f1,
{sq("(ap / (SELECT ap FROM ka WHERE model = 'quantity') - 1) * 100", 6)} AS gain_pct FROM ka JOIN mr ON ka.model = mr.model""",
        LONG, MODEL_CONFUSION, KEYED_CURVE,
    ),
)
def l15(spark, sf_dir):
    out = evaluate.compare_models(_long(spark, sf_dir), "model", "score", "label", "quantity")
    out = rounded(out, "average_precision", "pr_auc", "roc_auc", "precision", "recall", "f1", digits=8)
    return rounded(out, "gain_pct", digits=6)


@register(
    "l16_normalise_comparison",
    with_scores(
        f"""SELECT threshold, {sq('(recall - min(recall) OVER ()) / (max(recall) OVER () - min(recall) OVER ())', 8)} AS recall, {sq('(precision - min(precision) OVER ()) / (max(precision) OVER () - min(precision) OVER ())', 8)} AS precision,
{sq('f1 / max(f1) OVER ()', 8)} AS f1 FROM ts""",
        THRESHOLDS,
    ),
)
def l16(spark, sf_dir):
    table = _table(spark, sf_dir).select("threshold", "recall", "precision", "f1")
    out = evaluate.normalise_columns(evaluate.normalise_columns(table, ["recall", "precision"]), ["f1"], "max")
    return rounded(out, "recall", "precision", "f1", digits=8)


@register("l17_precision_near_recall", with_scores(f"SELECT {sq('prec', 8)} AS precision, {sq('rec', 8)} AS recall, score AS threshold FROM pr ORDER BY abs(rec - 0.8::DOUBLE), score DESC LIMIT 1", CURVE))
def l17(spark, sf_dir):
    out = evaluate.precision_near_recall(evaluate.curve(line_scores(spark, sf_dir), "score", "label"))
    return rounded(out, "precision", "recall", digits=8)


@register("l18_brier", with_scores(f"SELECT {sq('avg((score - label) * (score - label))', 8)} AS brier FROM scores"))
def l18(spark, sf_dir):
    return rounded(evaluate.brier(line_scores(spark, sf_dir), "score", "label"), "brier", digits=8)


REL = "rel AS (SELECT CAST(least(9, floor(score * 10)) AS INT) AS bin, count(*) AS n, avg(score) AS s, avg(label) AS l FROM scores GROUP BY 1)"


@register("l19_reliability", with_scores(f"SELECT bin, n, {sq('s', 8)} AS mean_score, {sq('l', 8)} AS mean_label FROM rel", REL))
def l19(spark, sf_dir):
    return rounded(evaluate.reliability(line_scores(spark, sf_dir), "score", "label"), "mean_score", "mean_label", digits=8)


@register("l19_calibration_error", with_scores(f"SELECT {sq('sum(n * abs(s - l)) / sum(n)', 8)} AS ece FROM rel", REL))
def l19_ece(spark, sf_dir):
    table = evaluate.reliability(line_scores(spark, sf_dir), "score", "label")
    return rounded(evaluate.expected_calibration_error(table), "ece", digits=8)


@register("l20_recall_at_fpr", with_scores(f"SELECT {sq('max(rec)', 8)} AS recall_at_fpr FROM pr WHERE fpr <= 0.05", CURVE))
def l20(spark, sf_dir):
    return rounded(evaluate.recall_at_fpr(evaluate.curve(line_scores(spark, sf_dir), "score", "label")), "recall_at_fpr", digits=8)


_REPORT = f"""cr AS (SELECT '1' AS class, {P} AS p, {R} AS r, tp + fn AS support FROM c UNION ALL SELECT '0', {_rate('tn', '(tn + fn)')}, {_rate('tn', '(tn + fp)')}, tn + fp FROM c),
cf AS (SELECT *, {_f1('p', 'r')} AS f FROM cr)"""


@register(
    "l21_classification_report",
    with_scores(
        f"""SELECT class, {sq('p', 8)} AS precision, {sq('r', 8)} AS recall, {sq('f', 8)} AS f1, support FROM cf
UNION ALL SELECT 'macro avg', {sq('avg(p)', 8)}, {sq('avg(r)', 8)}, {sq('avg(f)', 8)}, CAST(sum(support) AS BIGINT) FROM cf
UNION ALL SELECT 'weighted avg', {sq('sum(p * support) / sum(support)', 8)}, {sq('sum(r * support) / sum(support)', 8)}, {sq('sum(f * support) / sum(support)', 8)}, CAST(sum(support) AS BIGINT) FROM cf""",
        _confusion_cte(0.5), _REPORT,
    ),
)
def l21(spark, sf_dir):
    return rounded(evaluate.classification_report(line_scores(spark, sf_dir), "score", "label"), "precision", "recall", "f1", digits=8)


@register(
    "l22_evasion",
    with_scores(
        f"SELECT count(*) FILTER (score >= 0.5) AS detected, count(*) FILTER (score >= 0.5 AND score_b < 0.5) AS evaded, {sq('avg(CAST(score >= 0.5 AND score_b < 0.5 AS INT))', 8)} AS evasion_rate, {sq('avg(score - score_b)', 8)} AS mean_drop FROM scores WHERE label = 1"
    ),
)
def l22(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    after = rows.select(*ROW_KEY, F.col("score_b").alias("score"))
    return rounded(evaluate.evasion(rows, after, ROW_KEY, "score", "label"), "evasion_rate", "mean_drop", digits=8)


@register("l23_stability", with_scores(f"SELECT {sq('1 - avg(abs(score - score_b))', 8)} AS stability, {sq('max(abs(score - score_b))', 8)} AS max_change FROM scores"))
def l23(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    after = rows.select(*ROW_KEY, F.col("score_b").alias("score"))
    return rounded(evaluate.stability(rows, after, ROW_KEY, "score"), "stability", "max_change", digits=8)


@register(
    "l24_segment_parity",
    with_scores(
        f"""SELECT count(*) AS segments, {sq('max(roc) - min(roc)', 8)} AS roc_auc_gap, {sq('max(ap) - min(ap)', 8)} AS average_precision_gap, {sq('max(fpr) - min(fpr)', 8)} AS fpr_gap,
CASE WHEN max(roc) - min(roc) < 0.05 AND max(fpr) - min(fpr) < 0.05 THEN 'FAIR' ELSE 'NEEDS REVIEW' END AS verdict
FROM ka JOIN (SELECT model, count(*) FILTER (score >= 0.5 AND label = 0)::DOUBLE / count(*) FILTER (label = 0) AS fpr FROM lm GROUP BY 1) x ON ka.model = x.model""",
        "lm AS (SELECT CASE WHEN amount >= (SELECT quantile_cont(amount, 0.5) FROM scores) THEN 'high' ELSE 'low' END AS model, score, label FROM scores)",
        KEYED_CURVE,
    ),
)
def l24(spark, sf_dir):
    rows = aggregates.median_segments(line_scores(spark, sf_dir), "amount")
    out = evaluate.segment_parity(rows, "segment", "score", "label")
    return rounded(out, "roc_auc_gap", "average_precision_gap", "fpr_gap", digits=8)


@register(
    "l24_segment_table",
    with_scores(
        f"""SELECT x.model AS segment, n AS size, {sq('rate', 8)} AS fraud_rate, {sq('roc', 8)} AS roc_auc, {sq('ap', 8)} AS average_precision, {sq('fpr', 8)} AS fpr
FROM ka JOIN (SELECT model, count(*) AS n, avg(label) AS rate, count(*) FILTER (score >= 0.5 AND label = 0)::DOUBLE / count(*) FILTER (label = 0) AS fpr FROM lm GROUP BY 1) x ON ka.model = x.model""",
        "lm AS (SELECT CASE WHEN amount >= (SELECT quantile_cont(amount, 0.5) FROM scores) THEN 'high' ELSE 'low' END AS model, score, label FROM scores)",
        KEYED_CURVE,
    ),
)
def l24_table(spark, sf_dir):
    rows = aggregates.median_segments(line_scores(spark, sf_dir), "amount")
    return rounded(evaluate.segment_table(rows, "segment", "score", "label"), "fraud_rate", "roc_auc", "average_precision", "fpr", digits=8)


@register(
    "l25_business_value",
    with_scores(
        f"""SELECT CAST(k AS BIGINT) AS k, hits, hits * 5000.0::DOUBLE AS prevented_loss, k * 50.0::DOUBLE AS investigation_cost, hits * 5000.0::DOUBLE - k * 50.0::DOUBLE AS net_value, {sq('(hits * 5000.0::DOUBLE - k * 50.0::DOUBLE) / (k * 50.0::DOUBLE)', 6)} AS roi
FROM (SELECT k, CAST(sum(label) FILTER (r <= k) AS BIGINT) AS hits FROM rk, (SELECT unnest([100, 500, 1000]) AS k) GROUP BY 1)""",
        RANKED,
    ),
)
def l25(spark, sf_dir):
    at_k = evaluate.metrics_at_k(line_scores(spark, sf_dir), "score", "label", [100, 500, 1000], ROW_KEY)
    return rounded(evaluate.business_value(at_k, 5000.0, 50.0), "roi", digits=6)
