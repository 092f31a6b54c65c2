"""Section F: sorts, limits, top-k, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import topk
from txnrisk.operators.aggregates import outcome
from txnrisk.plans.registry import KEY, q, register, sq, with_scores, with_transfers
from txnrisk.sources.canonical import ROW_KEY, line_scores, transfers

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
HASH_SQL = "md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


@register("f1_sort_by_time", with_transfers(f"SELECT {KEY}, row_number() OVER (ORDER BY timestamp, {KEY}) - 1 AS position FROM transfers"))
def f1(spark, sf_dir):
    out = topk.sort_by_time(transfers(spark, sf_dir), ["timestamp", *ROW_KEY], "position", limit=10_000)
    return out.select(*ROW_KEY, "position")


@register("f2_top_k", with_scores(f"SELECT {KEY}, score, label FROM scores ORDER BY score DESC, {KEY} LIMIT 500"))
def f2(spark, sf_dir):
    return topk.top_k(line_scores(spark, sf_dir), "score", 500, ROW_KEY).select(*ROW_KEY, "score", "label")


@register(
    "f3_top_fraud_accounts",
    with_transfers("SELECT source, count(*) AS count FROM transfers WHERE is_fraud = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
)
def f3(spark, sf_dir):
    return topk.top_values(transfers(spark, sf_dir), "source", 10, F.col("is_fraud") == 1)


@register(
    "f4_rank_features",
    with_transfers(
        "SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS variable, {sq(f'corr({c}, is_fraud)', 8)} AS r FROM transfers" for c in ("amount", "from_bank", "to_bank", "l_discount", "l_tax", "l_quantity"))
        + ") ORDER BY abs(r) DESC, variable LIMIT 3"
    ),
)
def f4(spark, sf_dir):
    from txnrisk.operators.stats import correlations_with

    stats = correlations_with(transfers(spark, sf_dir), ["amount", "from_bank", "to_bank", "l_discount", "l_tax", "l_quantity"], "is_fraud")
    return topk.rank_features(stats.withColumn("r", q("r", 8)), "r", 3)


@register(
    "f5_top_cases",
    with_scores(
        f"""SELECT {KEY}, outcome, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY outcome ORDER BY score DESC, {KEY}) AS INT) AS rank FROM
(SELECT *, CASE WHEN score >= 0.3 AND label = 1 THEN 'TP' WHEN score >= 0.3 THEN 'FP' END AS outcome FROM scores) WHERE outcome IS NOT NULL) WHERE rank <= 5"""
    ),
)
def f5(spark, sf_dir):
    rows = line_scores(spark, sf_dir).withColumn("outcome", outcome("score", "label", 0.3)).filter(F.col("outcome").isin("TP", "FP"))
    out = topk.top_per_group(rows, ["outcome"], [F.col("score").desc(), *ROW_KEY], 5)
    return out.select(*ROW_KEY, "outcome", "score", "rank")


@register("f6_sample_rows", with_scores(f"SELECT {KEY} FROM scores ORDER BY {HASH_SQL}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000"))
def f6(spark, sf_dir):
    return topk.sample_rows(line_scores(spark, sf_dir), 1000, IDS).select(*ROW_KEY)


@register("f6_sample_fraction", with_scores(f"SELECT {KEY} FROM scores WHERE CAST('0x' || substr({HASH_SQL}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.1::DOUBLE"))
def f6_fraction(spark, sf_dir):
    return topk.sample_fraction(line_scores(spark, sf_dir), 0.1, IDS).select(*ROW_KEY)


STRATIFIED = f"""s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_SQL}, timestamp, amount) AS r, count(*) OVER (PARTITION BY label) AS n FROM scores),
sampled AS (SELECT * FROM s WHERE r <= floor(n * 0.25::DOUBLE))"""


@register("f7_stratified_sample", with_scores(f"SELECT {KEY}, label FROM sampled", STRATIFIED))
def f7(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    return topk.stratified_sample(rows, "label", 0.25, IDS, ["timestamp", "amount"]).select(*ROW_KEY, "label")


@register(
    "f8_sampling_report",
    with_scores(
        f"""SELECT a.n AS original_rows, {sq('a.r', 6)} AS original_rate, {sq('a.m')} AS original_amount_mean, b.n AS sampled_rows, {sq('b.r', 6)} AS sampled_rate, {sq('b.m')} AS sampled_amount_mean
FROM (SELECT count(*) AS n, avg(label) AS r, avg(amount) AS m FROM scores) a, (SELECT count(*) AS n, avg(label) AS r, avg(amount) AS m FROM sampled) b""",
        STRATIFIED,
    ),
)
def f8(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    taken = topk.stratified_sample(rows, "label", 0.25, IDS, ["timestamp", "amount"])
    out = topk.sampling_report(rows, taken, "label", "amount")
    return out.withColumns({c: q(c, 6 if c.endswith("rate") else 4) for c in out.columns if not c.endswith("rows")})


_COPIES = " + ".join(f"CAST(u >= {p!r}::DOUBLE AS INT)" for p in topk.poisson_steps(2.0))


@register(
    "f9_bootstrap_positives",
    with_scores(
        f"""SELECT label, CAST(sum(n) AS BIGINT) AS n, {sq('sum(n * amount)', 2)} AS amount FROM (SELECT label, amount, 1 + CASE WHEN label = 1 THEN {_COPIES} ELSE 0 END AS n
FROM (SELECT *, CAST('0x' || substr({HASH_SQL}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM scores)) GROUP BY label"""
    ),
)
def f9(spark, sf_dir):
    out = topk.bootstrap_positives(line_scores(spark, sf_dir), "label", IDS)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), q(F.sum("amount"), 2).alias("amount"))
