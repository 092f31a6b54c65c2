"""Section K, first part: splits, folds, encoders, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators import encoding, evaluate, models, splits
from txnrisk.plans.aggregates import rounded
from txnrisk.plans.joins import DAY_PAIR_SQL
from txnrisk.plans.registry import KEY, q, register, sq, with_scores, with_transfers
from txnrisk.plans.topk import HASH_SQL, IDS
from txnrisk.session import scratch_path
from txnrisk.sources.canonical import ROW_KEY, line_scores, table, transfers

ORDER = ["timestamp", *[c for c in ROW_KEY if c != "timestamp"]]
ORDER_SQL = "timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount"


@register(
    "k1_ratio_split",
    with_scores(f"SELECT {KEY}, CASE WHEN row_number() OVER (ORDER BY {ORDER_SQL}) <= floor((SELECT count(*) FROM scores) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM scores"),
)
def k1(spark, sf_dir):
    return splits.ratio_split(line_scores(spark, sf_dir), ORDER).select(*ROW_KEY, "split")


SPAN = """bounds AS (SELECT t0 + to_microseconds(CAST(floor(span * 0.6::DOUBLE) AS BIGINT)) AS a, t0 + to_microseconds(CAST(floor(span * 0.6::DOUBLE) + floor(span * 0.2::DOUBLE) AS BIGINT)) AS b
 FROM (SELECT min(timestamp) AS t0, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS span FROM scores)),
sp AS (SELECT *, CASE WHEN timestamp <= a THEN 'train' WHEN timestamp >= a + INTERVAL 1 DAY AND timestamp <= b THEN 'val' WHEN timestamp >= b + INTERVAL 1 DAY THEN 'test' END AS split FROM scores, bounds)"""


@register("k2_time_span_split", with_scores(f"SELECT {KEY}, split FROM sp", SPAN))
def k2(spark, sf_dir):
    return splits.time_span_split(line_scores(spark, sf_dir), "timestamp").select(*ROW_KEY, "split")


def _span(name, what):
    return f"epoch_us({what}(timestamp) FILTER (split = '{name}'))"


@register(
    "k3_validate_splits",
    with_scores(
        "SELECT "
        + ", ".join(f"{sq(f'avg(label) FILTER (split = {chr(39)}{s}{chr(39)})', 8)} AS {s}_rate, count(*) FILTER (split = '{s}') AS {s}_rows" for s in ("train", "val", "test"))
        + ", true AS is_ordered, 0::BIGINT AS overlap_val, 0::BIGINT AS overlap_test, "
        + ", ".join(f"{sq(f'({_span(s, 'max')} - {_span(s, 'min')})::DOUBLE / ({_span('test', 'max')} - {_span('train', 'min')})', 8)} AS {s}_share" for s in ("train", "val", "test"))
        + f", {sq('greatest(abs(any_value(r.a) - any_value(r.b)), abs(any_value(r.b) - any_value(r.c)), abs(any_value(r.a) - any_value(r.c)))', 8)} AS max_rate_difference, true AS is_similar FROM sp, (SELECT avg(label) FILTER (split = 'train') AS a, avg(label) FILTER (split = 'val') AS b, avg(label) FILTER (split = 'test') AS c FROM sp) r",
        SPAN,
    ),
)
def k3(spark, sf_dir):
    rows = splits.time_span_split(line_scores(spark, sf_dir), "timestamp")
    out = splits.validate_splits(rows, "split", "timestamp", "label")
    return rounded(out, *[c for c in out.columns if c.endswith(("_rate", "_share", "_difference"))], digits=8)


def _fold_sql(bounds):
    """Bounds as SQL over n; each row once per fold and role it belongs to."""
    return f"""n AS (SELECT count(*) AS n FROM scores), f AS ({bounds}),
r AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS i FROM scores),
folds AS (SELECT r.*, fold, CASE WHEN i < tr THEN 'train' ELSE 'test' END AS role FROM r JOIN f ON i < tr OR (i >= s AND i < e))"""


_K4 = _fold_sql("SELECT CAST(k AS INT) AS fold, greatest(0, e - 2000) - 100 AS tr, greatest(0, e - 2000) AS s, e FROM (SELECT k, greatest(2000, n - (5 - k) * 2000) AS e FROM n, range(5) t(k)) WHERE greatest(0, e - 2000) - 100 > 0")
_K5 = _fold_sql("SELECT CAST(k AS INT) AS fold, n - (5 - k) * (n // 6) AS tr, n - (5 - k) * (n // 6) AS s, n - (5 - k - 1) * (n // 6) AS e FROM n, range(5) t(k)")


@register("k4_expanding_folds", with_scores(f"SELECT {KEY}, fold, role FROM folds", _K4))
def k4(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    bounds = splits.expanding_bounds(rows.count(), 5, 2000, 100)
    return splits.assign_folds(rows, ORDER, bounds).select(*ROW_KEY, "fold", "role")


@register("k5_series_folds", with_scores(f"SELECT {KEY}, fold, role FROM folds", _K5))
def k5(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    return splits.assign_folds(rows, ORDER, splits.series_bounds(rows.count(), 5)).select(*ROW_KEY, "fold", "role")


@register(
    "k6_day_split",
    "WITH "
    + DAY_PAIR_SQL
    + """, best AS (SELECT i, j FROM pairs ORDER BY err, i, j LIMIT 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN d < i THEN 'train' WHEN d < j THEN 'val' ELSE 'test' END AS split FROM
(SELECT *, floor((epoch(l_shipdate) - (SELECT min(epoch(l_shipdate)) FROM lineitem)) / 86400) AS d FROM lineitem), best""",
)
def k6(spark, sf_dir):
    out = splits.day_split(table(spark, sf_dir, "lineitem"), "l_shipdate")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "split")


@register(
    "k7_cumulative_graphs",
    with_scores(
        f"""SELECT 'train' AS view, count(*) AS edges, {sq('avg(label)', 8)} AS rate FROM sp WHERE split = 'train'
UNION ALL SELECT 'train_val', count(*), {sq('avg(label)', 8)} FROM sp WHERE split IN ('train', 'val') UNION ALL SELECT 'all', count(*), {sq('avg(label)', 8)} FROM sp WHERE split IS NOT NULL""",
        SPAN,
    ),
)
def k7(spark, sf_dir):
    rows = splits.cumulative_views(splits.time_span_split(line_scores(spark, sf_dir), "timestamp"), "split")
    return rows.groupBy("view").agg(F.count(F.lit(1)).alias("edges"), q(F.avg("label"), 8).alias("rate"))


RANKS = f"s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_SQL}, timestamp, amount) AS r, count(*) OVER (PARTITION BY label) AS n FROM scores)"


@register(
    "k8_stratified_split",
    with_scores(f"SELECT {KEY}, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM s", RANKS),
)
def k8(spark, sf_dir):
    out = splits.stratified_split(line_scores(spark, sf_dir), "label", IDS, ["timestamp", "amount"], limit=10_000)
    return out.select(*ROW_KEY, "split")


@register("k9_stratified_folds", with_scores(f"SELECT {KEY}, CAST((r - 1) % 5 AS INT) AS fold FROM s", RANKS))
def k9(spark, sf_dir):
    return splits.stratified_folds(line_scores(spark, sf_dir), "label", IDS, 5, ["timestamp", "amount"]).select(*ROW_KEY, "fold")


@register(
    "k10_frequency_encoding",
    with_transfers(
        f"SELECT {KEY}, {sq('coalesce(freq, (SELECT avg(freq) FROM f))', 8)} AS payment_format FROM transfers t LEFT JOIN f ON t.payment_format = f.value",
        "f AS (SELECT payment_format AS value, count(*)::DOUBLE / sum(count(*)) OVER () AS freq FROM transfers GROUP BY 1)",
    ),
)
def k10(spark, sf_dir):
    rows = transfers(spark, sf_dir).select(*ROW_KEY, "payment_format")
    fitted = encoding.FeatureEncoder(["payment_format"], [], {"payment_format": encoding.frequency_map(rows, "payment_format")}, {})
    return fitted.transform(rows).select(*ROW_KEY, q("payment_format", 8).alias("payment_format"))


@register(
    "k11_robust_scaling",
    with_transfers(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, {sq('(amount - m) / iqr', 8)} AS amount, {sq('(l_quantity - qm) / qiqr', 8)} AS l_quantity FROM transfers, (SELECT quantile_cont(amount, 0.5) AS m, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS iqr, quantile_cont(l_quantity, 0.5) AS qm, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qiqr FROM transfers)"
    ),
)
def k11(spark, sf_dir):
    rows = transfers(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "amount", "l_quantity")
    return rounded(encoding.robust_scale(rows, ["amount", "l_quantity"]), "amount", "l_quantity", digits=8)


@register(
    "k12_min_max_scaling",
    with_transfers(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, {sq('(amount - lo) / (hi - lo)', 8)} AS amount FROM transfers, (SELECT min(amount) AS lo, max(amount) AS hi FROM transfers)"),
)
def k12(spark, sf_dir):
    rows = transfers(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "amount")
    return rounded(encoding.min_max_scale(rows, ["amount"]), "amount", digits=8)


@register(
    "k12_standard_scaling",
    with_transfers(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, {sq('(amount - m) / s', 6)} AS amount FROM transfers, (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM transfers)"),
)
def k12_standard(spark, sf_dir):
    rows = transfers(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "amount")
    return rounded(encoding.standard_scale(rows, ["amount"]), "amount", digits=6)


@register(
    "k13_target_encoding",
    with_transfers(
        f"SELECT {KEY}, {sq('coalesce(v, 0.5)', 8)} AS bank_rate FROM transfers LEFT JOIN (SELECT from_bank AS b, avg(is_fraud) AS v FROM transfers WHERE timestamp < TIMESTAMP '1996-01-01' AND from_bank <> 3 GROUP BY 1) ON from_bank = b"
    ),
)
def k13(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    seen = rows.filter((F.col("timestamp") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("from_bank") != 3))
    out = encoding.target_encode(rows, encoding.target_map(seen, "from_bank", "is_fraud"), "from_bank", "bank_rate", 0.5)
    return out.select(*ROW_KEY, q("bank_rate", 8).alias("bank_rate"))


@register(
    "k14_feature_encoder",
    with_transfers(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, {sq('(freq - fm) / CASE WHEN fq = 0 THEN 1 ELSE fq END', 6)} AS payment_format, {sq('(amount - am) / aq', 6)} AS amount FROM e,
(SELECT quantile_cont(freq, 0.5) AS fm, quantile_cont(freq, 0.75) - quantile_cont(freq, 0.25) AS fq, quantile_cont(amount, 0.5) AS am, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS aq FROM e)""",
        "f AS (SELECT payment_format AS value, count(*)::DOUBLE / sum(count(*)) OVER () AS freq FROM transfers GROUP BY 1)",
        "e AS (SELECT t.*, freq FROM transfers t JOIN f ON t.payment_format = f.value)",
    ),
)
def k14(spark, sf_dir):
    """Fitted, saved, loaded again and applied."""
    rows = transfers(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "payment_format", "amount")
    path = scratch_path(spark, "k14")
    encoding.FeatureEncoder(["payment_format"], ["amount"]).fit(rows).save(spark, path)
    fitted = encoding.FeatureEncoder.load(spark, path, ["payment_format"], ["amount"])
    return rounded(fitted.transform(rows), "payment_format", "amount", digits=6)


@register(
    "k16_class_weights",
    with_transfers(f"SELECT is_fraud, n, {sq('t::DOUBLE / (k * n)', 8)} AS weight FROM (SELECT is_fraud, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM transfers GROUP BY 1)"),
)
def k16(spark, sf_dir):
    return rounded(encoding.class_weights(transfers(spark, sf_dir), "is_fraud"), "weight", digits=8)


@register(
    "k17_baselines",
    with_scores(
        f"""SELECT 'random' AS model, {sq('avg(label)', 8)} AS average_precision, 0.5::DOUBLE AS roc_auc FROM scores UNION ALL SELECT 'majority', {sq('avg(label)', 8)}, 0.5 FROM scores"""
    ),
)
def k17(spark, sf_dir):
    rows = evaluate.baselines(line_scores(spark, sf_dir), "label")
    out = evaluate.ranking_metrics(rows, "baseline_score", "label", ["model"])
    return rounded(out, "average_precision", "roc_auc", digits=8).select("model", "average_precision", "roc_auc")


@register(
    "k18_ensemble",
    with_scores(
        f"SELECT {KEY}, {sq('(score * 2.0 + score_b * 1.0) / 3.0::DOUBLE', 8)} AS ensemble_score, CAST((CAST(score >= 0.5 AS INT) * 2 + CAST(score_b >= 0.5 AS INT)) / 3.0::DOUBLE >= 0.5 AS INT) AS ensemble_vote FROM scores"
    ),
)
def k18(spark, sf_dir):
    out = evaluate.ensemble(line_scores(spark, sf_dir), ["score", "score_b"], [2.0, 1.0])
    return out.select(*ROW_KEY, q("ensemble_score", 8).alias("ensemble_score"), "ensemble_vote")


_FOLD_METRICS = {"recall": "tp / nullif(tp + fn, 0)", "precision": "tp / nullif(tp + fp, 0)", "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)", "accuracy": "(tp + tn) / (tp + fp + fn + tn)"}
_CM = "cm AS (SELECT fold, role, " + ", ".join(f"count(*) FILTER ({c})::DOUBLE AS {n}" for n, c in {"tp": "score >= 0.5 AND label = 1", "fp": "score >= 0.5 AND label = 0", "fn": "score < 0.5 AND label = 1", "tn": "score < 0.5 AND label = 0"}.items()) + " FROM folds GROUP BY 1, 2)"
_MT = "mt AS (SELECT fold, role, " + ", ".join(f"coalesce({e}, 0) AS {m}" for m, e in _FOLD_METRICS.items()) + " FROM cm)"
_LG = "lg AS (" + " UNION ALL ".join(f"SELECT fold, role, '{m}' AS metric, {e} AS v FROM mt" for m, e in [*((m, m) for m in _FOLD_METRICS), ("overall", "(recall + precision + f1 + accuracy) / 4")]) + ")"
_PR = "pr AS (SELECT metric, fold, max(v) FILTER (role = 'train') AS tr, max(v) FILTER (role = 'test') AS te FROM lg GROUP BY 1, 2)"


@register(
    "k20_fold_metrics",
    with_scores(
        f"""SELECT metric, {sq('avg(tr)', 8)} AS train_mean, {sq('stddev_pop(tr)', 8)} AS train_std, {sq('avg(te)', 8)} AS test_mean, {sq('stddev_pop(te)', 8)} AS test_std,
{sq('avg(tr - te)', 8)} AS overfit, {sq('stddev_pop(tr - te)', 8)} AS overfit_std, count(*) AS n_folds FROM pr GROUP BY 1""",
        _K5, _CM, _MT, _LG, _PR,
    ),
)
def k20_metrics(spark, sf_dir):
    """The metrics of the cross-validation for a stored score instead of fitted ones."""
    rows = line_scores(spark, sf_dir)
    placed = models.ranked_rows(rows, ORDER)
    folds = [models.fold_rows(placed, b) for b in splits.series_bounds(rows.count(), 5)]
    out = models.summarise_folds(models.fold_metrics(reduce(DataFrame.unionByName, folds), "score", "label"))
    out = out.filter(~F.col("metric").isin(models.RANK_METRICS))
    return rounded(out, "train_mean", "train_std", "test_mean", "test_std", "overfit", "overfit_std", digits=8)


@register(
    "k20_fold_summary",
    with_scores(
        f"""SELECT role, {sq('avg(v)', 8)} AS mean_score, {sq('stddev_pop(v)', 8)} AS std_score FROM (SELECT fold, role, avg(score) AS v FROM folds GROUP BY 1, 2) GROUP BY 1""",
        _K5,
    ),
)
def k20_summary(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    placed = splits.assign_folds(rows, ORDER, splits.series_bounds(rows.count(), 5))
    means = placed.groupBy("fold", "role").agg(F.avg("score").alias("v"))
    return means.groupBy("role").agg(q(F.avg("v"), 8).alias("mean_score"), q(F.stddev_pop("v"), 8).alias("std_score"))


