"""Section K, second part: distributed models.

Models on many columns have no SQL twin. A model that can give every payment format a probability of its
own must give each the rate of its training rows; the ``saturated`` queries prove fitting, scoring, saving,
streaming and importances that way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import evaluate, models, splits
from txnrisk.operators.windows import group_size
from txnrisk.plans.registry import KEY, q, register, sq, with_scores, with_transfers
from txnrisk.plans.splits import RANKS, SPAN
from txnrisk.plans.topk import IDS
from txnrisk.session import scratch_path, settle, stored
from txnrisk.sources.canonical import ROW_KEY, line_scores, transfers
from txnrisk.streaming import jobs

COLS = ["amount", "from_bank", "to_bank", "l_quantity", "l_discount", "l_tax", "source_degree"]
ORDER = ["timestamp", *[c for c in ROW_KEY if c != "timestamp"]]


def feature_rows(spark, sf_dir, keep=settle):
    """Model input, settled because fitting reads it many times."""
    rows = group_size(transfers(spark, sf_dir), ["source"], "source_degree")
    extra = [c for c in ROW_KEY if c not in COLS]
    return keep(rows.select(*extra, *COLS, "is_fraud"))


def _split(rows):
    return splits.time_span_split(rows, "timestamp").filter(F.col("split").isNotNull())


def _metrics(scored, model):
    out = evaluate.ranking_metrics(scored, "probability", "is_fraud")
    return out.select(F.lit(model).alias("model"), "positives", "negatives", "average_precision", "pr_auc", "roc_auc")


def _trained(spark, sf_dir, kind, **settings):
    rows = _split(feature_rows(spark, sf_dir))
    model = models.train(rows.filter(F.col("split") == "train"), COLS, "is_fraud", kind, is_stored=True, **settings)
    return rows, model


@register("k15_logistic")
def k15_logistic(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, "logistic", scaler="standard")
    return _metrics(models.score(model, rows.filter(F.col("split") == "test")), "logistic")


@register("k15_random_forest")
def k15_forest(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, "random_forest")
    return _metrics(models.score(model, rows.filter(F.col("split") == "test")), "random_forest")


@register("k15_boosted_trees")
def k15_boosted(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, "boosted_trees")
    return _metrics(models.score(model, rows.filter(F.col("split") == "test")), "boosted_trees")


@register("k19_parameter_search")
def k19(spark, sf_dir):
    rows = feature_rows(spark, sf_dir, keep=stored)
    bounds = splits.series_bounds(rows.count(), 2)
    return models.search(rows, COLS, "is_fraud", "logistic", bounds, ORDER, n=2)


@register("k20_temporal_cv")
def k20(spark, sf_dir):
    rows = feature_rows(spark, sf_dir, keep=stored)
    bounds = splits.series_bounds(rows.count(), 3)
    return models.summarise_folds(models.fit_folds(rows, COLS, "is_fraud", "logistic", bounds, ORDER))


@register("k21_permutation_importance")
def k21(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, "random_forest", numTrees=10, maxDepth=4)
    test = rows.filter(F.col("split") == "test")
    return models.permutation_importance(model, test, COLS, "is_fraud", ORDER, IDS)


@register("k22_batch_scoring")
def k22(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, "logistic")
    return models.score(model, rows.filter(F.col("split") == "test")).select(*ROW_KEY, "probability", "prediction")


# the isotonic fit at a point: the largest, over starts before it, of the least mean up to an end after it
_ISOTONIC = """cal AS (SELECT score, sum(label)::DOUBLE AS t, count(*)::DOUBLE AS w FROM s WHERE r <= floor(n * 0.2::DOUBLE) GROUP BY 1),
c AS (SELECT score, t, w, row_number() OVER (ORDER BY score) AS i, sum(t) OVER (ORDER BY score) AS st, sum(w) OVER (ORDER BY score) AS sw FROM cal),
av AS (SELECT a.i, b.i AS j, (b.st - a.st + a.t) / (b.sw - a.sw + a.w) AS m FROM c a JOIN c b ON a.i <= b.i),
lo AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS m FROM av),
g AS (SELECT c.score, max(lo.m) AS g FROM c JOIN lo ON lo.j = c.i GROUP BY 1),
te AS (SELECT score, label FROM s WHERE r > floor(n * 0.2::DOUBLE)),
e AS (SELECT d.score, (SELECT max(score) FROM g WHERE g.score <= d.score) AS a, (SELECT min(score) FROM g WHERE g.score >= d.score) AS b FROM (SELECT DISTINCT score FROM te) d),
f AS (SELECT e.score, CASE WHEN a IS NULL THEN gb.g WHEN b IS NULL OR a = b THEN ga.g ELSE ga.g + (gb.g - ga.g) * (e.score - a) / (b - a) END AS p
 FROM e LEFT JOIN g ga ON ga.score = a LEFT JOIN g gb ON gb.score = b)"""


@register(
    "k23_isotonic_calibration",
    with_scores(
        f"""SELECT 'uncalibrated' AS score, {sq('avg((te.score - label) * (te.score - label))', 8)} AS brier FROM te
UNION ALL SELECT 'calibrated', {sq('avg((p - label) * (p - label))', 8)} FROM te JOIN f ON te.score = f.score""",
        RANKS, _ISOTONIC,
    ),
)
def k23(spark, sf_dir):
    rows = splits.stratified_split(line_scores(spark, sf_dir), "label", IDS, ["timestamp", "amount"], {"calibration": 0.2, "test": 0.8})
    model = models.fit_calibration(rows.filter(F.col("split") == "calibration"), "score", "label")
    out = models.apply_calibration(model, rows.filter(F.col("split") == "test"), "score")
    before = evaluate.brier(out, "score", "label").select(F.lit("uncalibrated").alias("score"), q("brier", 8).alias("brier"))
    return before.unionByName(evaluate.brier(out, "calibrated", "label").select(F.lit("calibrated").alias("score"), q("brier", 8).alias("brier")))


@register("k24_saved_model")
def k24(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, "random_forest", numTrees=5, maxDepth=4)
    path = scratch_path(spark, "model")
    models.save_model(model, path, 0.4, {"trees": 5.0})
    saved = models.load_model(path)
    out = models.score(saved.model, rows.filter(F.col("split") == "test"), saved.threshold)
    return out.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"))


@register("m8_streaming_scoring")
def m8(spark, sf_dir):
    """The fitted model applied to transfers arriving as files."""
    rows, model = _trained(spark, sf_dir, "logistic")
    arriving, scored = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    rows.filter(F.col("split") == "test").drop("split").write.parquet(arriving)
    stream = jobs.read_stream(spark, arriving, rows.drop("split").schema)
    flagged = jobs.score_stream(stream, lambda df: models.score(model, df), needs=COLS, gives=["probability", "prediction"])
    jobs.run_to_parquet(flagged, scored, scratch_path(spark, "progress"))
    out = spark.read.parquet(scored)
    return out.agg(F.count(F.lit(1)).alias("total"), F.sum("prediction").alias("suspicious"), F.avg("probability").alias("mean_probability"))


# What a saturated model of the payment format learns from the training rows. A boosted tree's first step
# fits 2y - 1 by its mean, which the logistic function of its double makes a probability.
_RATES = [
    SPAN.replace("FROM scores", "FROM transfers").replace("scores, bounds", "transfers, bounds"),
    "rate AS (SELECT payment_format, avg(is_fraud) AS rate, 1 / (1 + exp(-2 * (2 * avg(is_fraud) - 1))) AS p FROM sp WHERE split = 'train' GROUP BY 1)",
]
# between the probabilities of formats with less and more fraud than usual
_FLAG = 0.14185


def _format_rows(spark, sf_dir):
    """Rows with the format's number, an indicator of each format but one, and a column that says nothing."""
    code = F.substring("payment_format", 1, 1).cast("int")
    rows = transfers(spark, sf_dir).select(*ROW_KEY, "payment_format", "is_fraud")
    return rows.withColumns({"code": code, "steady": F.lit(1.0), **{f"is_{k}": (code == k).cast("int") for k in range(1, 5)}})


def _format_tree(spark, sf_dir):
    """(rows with their split, a first boosted tree that can tell all formats apart)."""
    rows = settle(_split(_format_rows(spark, sf_dir)))
    train_rows = rows.filter(F.col("split") == "train")
    cols = ["code", "steady"]
    return rows, models.train(train_rows, cols, "is_fraud", "boosted_trees", balanced=False, is_stored=True, maxIter=1, maxDepth=5)


@register("k15_saturated_logistic", with_transfers(f"SELECT payment_format, {sq('rate', 3)} AS probability FROM rate", *_RATES))
def k15_saturated_logistic(spark, sf_dir):
    """Without a penalty, the probability of each format is its rate."""
    rows = settle(_split(_format_rows(spark, sf_dir)))
    cols = [f"is_{k}" for k in range(1, 5)]
    model = models.train(rows.filter(F.col("split") == "train"), cols, "is_fraud", "logistic", balanced=False, is_stored=True, regParam=0.0, maxIter=200, tol=1e-12)
    out = models.score(model, rows.filter(F.col("split") == "train")).groupBy("payment_format").agg(F.max("probability").alias("probability"))
    return out.withColumn("probability", q("probability", 3))


@register("k15_saturated_tree", with_transfers(f"SELECT payment_format, {sq('p', 8)} AS low, {sq('p', 8)} AS high FROM rate", *_RATES))
def k15_saturated_tree(spark, sf_dir):
    rows, model = _format_tree(spark, sf_dir)
    out = models.score(model, rows.filter(F.col("split") == "train")).groupBy("payment_format")
    return out.agg(q(F.min("probability"), 8).alias("low"), q(F.max("probability"), 8).alias("high"))


@register(
    "k22_saturated_scoring",
    with_transfers(f"SELECT {KEY}, {sq('p', 8)} AS probability, CAST(p >= {_FLAG}::DOUBLE AS INT) AS prediction FROM sp JOIN rate USING (payment_format) WHERE split = 'test'", *_RATES),
)
def k22_saturated(spark, sf_dir):
    rows, model = _format_tree(spark, sf_dir)
    out = models.score(model, rows.filter(F.col("split") == "test"), _FLAG)
    return out.select(*ROW_KEY, q("probability", 8).alias("probability"), "prediction")


@register(
    "k24_saturated_model",
    with_transfers(
        f"SELECT CAST(p >= {_FLAG}::DOUBLE AS INT) AS prediction, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud FROM sp JOIN rate USING (payment_format) WHERE split = 'test' GROUP BY 1",
        *_RATES,
    ),
)
def k24_saturated(spark, sf_dir):
    """The same after saving and loading model and threshold."""
    rows, model = _format_tree(spark, sf_dir)
    path = scratch_path(spark, "model")
    models.save_model(model, path, _FLAG, {"trees": 1.0})
    saved = models.load_model(path)
    out = models.score(saved.model, rows.filter(F.col("split") == "test"), saved.threshold)
    return out.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"))


@register(
    "m8_saturated_stream",
    with_transfers(
        f"SELECT count(*) AS total, CAST(sum(CAST(p >= {_FLAG}::DOUBLE AS INT)) AS BIGINT) AS suspicious, {sq('avg(p)', 8)} AS mean_probability FROM sp JOIN rate USING (payment_format) WHERE split = 'test'",
        *_RATES,
    ),
)
def m8_saturated(spark, sf_dir):
    rows, model = _format_tree(spark, sf_dir)
    arriving, scored = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    rows.filter(F.col("split") == "test").drop("split").write.parquet(arriving)
    stream = jobs.read_stream(spark, arriving, rows.drop("split").schema)
    flagged = jobs.score_stream(stream, lambda df: models.score(model, df, _FLAG), needs=["code", "steady"], gives=["probability", "prediction"])
    jobs.run_to_parquet(flagged, scored, scratch_path(spark, "progress"))
    return spark.read.parquet(scored).agg(
        F.count(F.lit(1)).alias("total"), F.sum("prediction").alias("suspicious"), q(F.avg("probability"), 8).alias("mean_probability")
    )


def _ap_sql(p):
    return f"""(SELECT sum(tp / pos * ctp / cn) FROM (SELECT tp, sum(tp) OVER () AS pos, sum(tp) OVER (ORDER BY p DESC) AS ctp, sum(n) OVER (ORDER BY p DESC) AS cn
 FROM (SELECT {p} AS p, sum(is_fraud)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM pm GROUP BY 1)))"""


_ORDER_SQL = ", ".join(ORDER)


@register(
    "k21_saturated_importance",
    with_transfers(
        f"""SELECT 'code' AS variable, {sq(f'{_ap_sql("p0")} - {_ap_sql("p1")}', 8)} AS "drop" UNION ALL SELECT 'steady', {sq(f'{_ap_sql("p0")} - {_ap_sql("p0")}', 8)}""",
        *_RATES,
        f"""tt AS (SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS at_time,
 row_number() OVER (ORDER BY md5('permute|' || {" || '|' || ".join(IDS)}), {_ORDER_SQL}) AS at_hash FROM sp JOIN rate USING (payment_format) WHERE split = 'test'),
pm AS (SELECT x.is_fraud, x.p AS p0, y.p AS p1 FROM tt x JOIN tt y ON x.at_time = y.at_hash)""",
    ),
)
def k21_saturated(spark, sf_dir):
    """Shuffling the format costs what the shuffled rates lose; shuffling a constant costs nothing."""
    rows, model = _format_tree(spark, sf_dir)
    test = rows.filter(F.col("split") == "test")
    out = models.permutation_importance(model, test, ["code", "steady"], "is_fraud", ORDER, IDS)
    return out.withColumn("drop", q("drop", 8))
