"""Section D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.functions.labels import same_value
from txnrisk.operators import aggregates as agg
from txnrisk.operators import splits
from txnrisk.plans.registry import PATTERNS, q, register, sq, with_scores, with_transfers
from txnrisk.sources.canonical import line_scores, pattern_rows, table, transfers, user_events


def rounded(df, *cols, digits=4):
    return df.withColumns({c: q(c, digits) for c in cols})


@register(
    "d1_entity_profile",
    with_transfers(
        f"""SELECT source, count(amount) AS amount_count, {sq('sum(amount)')} AS amount_sum, {sq('avg(amount)')} AS amount_mean,
{sq('stddev_samp(amount)', 2)} AS amount_std, {sq('avg(is_fraud)')} AS is_fraud_mean FROM transfers GROUP BY 1"""
    ),
)
def d1(spark, sf_dir):
    out = agg.entity_profile(transfers(spark, sf_dir), "source")
    return rounded(rounded(out, "amount_sum", "amount_mean", "is_fraud_mean"), "amount_std", digits=2)


PATTERN_PROFILE_SQL = f"""SELECT pattern_type, {sq('avg(amount)', 2)} AS amount_mean, {sq('stddev_samp(amount)', 2)} AS amount_std,
{sq('min(amount)', 2)} AS amount_min, {sq('max(amount)', 2)} AS amount_max, {sq('quantile_cont(amount, 0.5)', 2)} AS amount_median
FROM pattern_rows GROUP BY 1"""


@register("d2_pattern_amount_profile", with_transfers(PATTERN_PROFILE_SQL, PATTERNS))
def d2(spark, sf_dir):
    out = agg.amount_profile(pattern_rows(spark, sf_dir), "pattern_type")
    return rounded(out, "amount_mean", "amount_std", "amount_min", "amount_max", "amount_median", digits=2)


@register(
    "d3_pattern_distinct_banks",
    with_transfers("SELECT pattern_type, count(DISTINCT from_bank) AS n_from_bank, count(DISTINCT to_bank) AS n_to_bank FROM pattern_rows GROUP BY 1", PATTERNS),
)
def d3(spark, sf_dir):
    return agg.distinct_counts(pattern_rows(spark, sf_dir), ["pattern_type"], ["from_bank", "to_bank"])


@register(
    "d4_pattern_summary",
    with_transfers(
        f"""SELECT count(*) AS total_patterns, min(amount) AS amount_min, max(amount) AS amount_max, {sq('avg(amount)')} AS amount_mean,
min(timestamp) AS start, max(timestamp) AS "end", {sq('quantile_cont(amount, 0.5)')} AS amount_median,
(SELECT count(*) FROM (SELECT source FROM pattern_rows UNION SELECT target FROM pattern_rows)) AS unique_accounts,
(SELECT count(*) FROM (SELECT from_bank FROM pattern_rows UNION SELECT to_bank FROM pattern_rows)) AS unique_banks FROM pattern_rows""",
        PATTERNS,
    ),
)
def d4(spark, sf_dir):
    out = agg.pattern_summary(pattern_rows(spark, sf_dir), ["source", "target"], ["from_bank", "to_bank"])
    return rounded(out, "amount_mean", "amount_median")


@register("d4_pattern_type_counts", with_transfers("SELECT pattern_type, count(*) AS n FROM pattern_rows GROUP BY 1", PATTERNS))
def d4_types(spark, sf_dir):
    return pattern_rows(spark, sf_dir).groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n"))


def _rate_sql(key, name):
    return f"SELECT {key} AS {name}, count(*) AS count, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, {sq('avg(is_fraud)', 6)} AS fraud_rate FROM transfers GROUP BY 1"


@register("d5_rate_by_format", with_transfers(_rate_sql("payment_format", "payment_format")))
def d5(spark, sf_dir):
    return rounded(agg.rate_by(transfers(spark, sf_dir), F.col("payment_format"), "payment_format"), "fraud_rate", digits=6)


@register("d5_rate_by_bank_match", with_transfers(_rate_sql("CAST(from_bank = to_bank AS INT)", "same_bank")))
def d5_bank(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    return rounded(agg.rate_by(rows, same_value(F.col("from_bank"), F.col("to_bank")), "same_bank"), "fraud_rate", digits=6)


@register("d5_rate_by_entity_match", with_transfers(_rate_sql("CAST(source = target AS INT)", "same_entity")))
def d5_entity(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    return rounded(agg.rate_by(rows, same_value(F.col("source"), F.col("target")), "same_entity"), "fraud_rate", digits=6)


@register("d5_rate_by_date", with_transfers(_rate_sql("CAST(timestamp AS DATE)", "date")))
def d5_date(spark, sf_dir):
    return rounded(agg.rate_by(transfers(spark, sf_dir), F.col("timestamp").cast("date"), "date"), "fraud_rate", digits=6)


@register(
    "d5_rate_extremes",
    with_transfers(
        f"""SELECT (SELECT payment_format FROM r ORDER BY v DESC, payment_format LIMIT 1) AS highest, {sq('max(v)', 6)} AS highest_value,
(SELECT payment_format FROM r ORDER BY v, payment_format LIMIT 1) AS lowest, {sq('min(v)', 6)} AS lowest_value FROM r""",
        "r AS (SELECT payment_format, avg(is_fraud) AS v FROM transfers GROUP BY 1)",
    ),
)
def d5_extremes(spark, sf_dir):
    rates = agg.rate_by(transfers(spark, sf_dir), F.col("payment_format"), "payment_format")
    return rounded(agg.extremes(rates, "payment_format"), "highest_value", "lowest_value", digits=6)


_EVENT_LABEL = "e AS (SELECT *, CASE WHEN value > 100 THEN 1 ELSE 0 END AS is_high FROM events)"


def _events(spark, sf_dir):
    return user_events(spark, sf_dir).withColumn("is_high", (F.coalesce(F.col("value"), F.lit(0.0)) > 100).cast("int"))


def _volume_sql(key, name, source="e", label="is_high"):
    return f"SELECT {key} AS {name}, count(*) AS count, CAST(sum({label}) AS BIGINT) AS fraud_count, {sq(f'avg({label})', 6)} AS fraud_rate FROM {source} GROUP BY 1"


@register("d6_volume_by_hour", f"WITH {_EVENT_LABEL} " + _volume_sql("CAST(hour(ts) AS INT)", "hour"))
def d6(spark, sf_dir):
    return rounded(agg.rate_by(_events(spark, sf_dir), F.hour("ts"), "hour", "is_high"), "fraud_rate", digits=6)


@register("d6_volume_by_weekday", f"WITH {_EVENT_LABEL} " + _volume_sql("CAST(isodow(ts) - 1 AS INT)", "day_of_week"))
def d6_weekday(spark, sf_dir):
    return rounded(agg.rate_by(_events(spark, sf_dir), F.weekday("ts"), "day_of_week", "is_high"), "fraud_rate", digits=6)


@register("d6_volume_by_month", with_transfers(_volume_sql("CAST(date_trunc('month', timestamp) AS DATE)", "month", "transfers", "is_fraud")))
def d6_month(spark, sf_dir):
    month = F.trunc(F.col("timestamp").cast("date"), "month")
    return rounded(agg.rate_by(transfers(spark, sf_dir), month, "month"), "fraud_rate", digits=6)


@register(
    "d6_peak_periods",
    f"""WITH {_EVENT_LABEL} SELECT
(SELECT CAST(hour(ts) AS INT) FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
(SELECT CAST(isodow(ts) - 1 AS INT) FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_day,
(SELECT CAST(month(ts) AS INT) FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_month""",
)
def d6_peak(spark, sf_dir):
    return agg.peak_periods(_events(spark, sf_dir), "ts")


@register(
    "d7_hour_label_pivot",
    f"WITH {_EVENT_LABEL} SELECT CAST(hour(ts) AS INT) AS hour, count(*) FILTER (is_high = 0) AS class_0, count(*) FILTER (is_high = 1) AS class_1 FROM e GROUP BY 1",
)
def d7(spark, sf_dir):
    return agg.hour_by_label(_events(spark, sf_dir), F.hour("ts"), "is_high")


@register(
    "d8_contingency",
    with_transfers("SELECT from_bank, count(*) FILTER (is_fraud = 1) AS events, count(*) FILTER (is_fraud = 0) AS non_events FROM transfers GROUP BY 1"),
)
def d8(spark, sf_dir):
    return agg.contingency(transfers(spark, sf_dir), "from_bank", "is_fraud")


@register(
    "d9_value_shares",
    with_transfers(f"SELECT payment_format, count(*) AS count, {sq('count(*)::DOUBLE / (SELECT count(*) FROM transfers)', 8)} AS share FROM transfers GROUP BY 1"),
)
def d9(spark, sf_dir):
    return rounded(agg.value_shares(transfers(spark, sf_dir), "payment_format"), "share", digits=8)


def _dist_sql(c):
    return f"""SELECT '{c}' AS "column", {sq(f'avg({c})')} AS mean, {sq(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median,
{sq(f'stddev_samp({c})', 3)} AS std, {sq(f'skewness({c})', 5)} AS skewness, {sq(f'kurtosis({c})', 5)} AS kurtosis FROM transfers"""


@register("d10_distribution_summary", with_transfers(" UNION ALL ".join(_dist_sql(c) for c in ("amount", "from_bank", "to_bank"))))
def d10(spark, sf_dir):
    out = agg.distribution_summary(transfers(spark, sf_dir), ["amount", "from_bank", "to_bank"])
    return rounded(rounded(rounded(out, "mean", "median"), "std", digits=3), "skewness", "kurtosis", digits=5)


@register(
    "d11_dataset_summary",
    with_transfers(
        f"""SELECT count(*) AS total_transactions, {sq('avg(is_fraud)', 6)} AS fraud_rate, {sq('avg(amount)')} AS avg_transaction_amount,
count(DISTINCT payment_format) AS unique_payment_formats, strftime(min(timestamp), '%Y-%m-%d') AS start, strftime(max(timestamp), '%Y-%m-%d') AS "end" FROM transfers"""
    ),
)
def d11(spark, sf_dir):
    out = agg.dataset_summary(transfers(spark, sf_dir))
    return rounded(rounded(out, "fraud_rate", digits=6), "avg_transaction_amount")


@register(
    "d12_class_imbalance",
    with_transfers(
        f"""SELECT count(*) FILTER (is_fraud = 1) AS positives, count(*) FILTER (is_fraud = 0) AS negatives,
{sq('avg(is_fraud)', 6)} AS rate, {sq('count(*) FILTER (is_fraud = 0)::DOUBLE / count(*) FILTER (is_fraud = 1)', 6)} AS scale_pos_weight FROM transfers"""
    ),
)
def d12(spark, sf_dir):
    return rounded(agg.class_imbalance(transfers(spark, sf_dir), "is_fraud"), "rate", "scale_pos_weight", digits=6)


@register(
    "d13_split_profile",
    with_transfers(
        f"""SELECT split, count(*) AS n, {sq('avg(is_fraud)', 6)} AS rate, min(timestamp) AS start, max(timestamp) AS "end"
FROM (SELECT *, CASE WHEN timestamp <= a THEN 'train' WHEN timestamp >= a + INTERVAL 1 DAY AND timestamp <= b THEN 'val' WHEN timestamp >= b + INTERVAL 1 DAY THEN 'test' END AS split
FROM transfers, (SELECT t0 + to_microseconds(CAST(floor(span * 0.6::DOUBLE) AS BIGINT)) AS a, t0 + to_microseconds(CAST(floor(span * 0.6::DOUBLE) + floor(span * 0.2::DOUBLE) AS BIGINT)) AS b
 FROM (SELECT min(timestamp) AS t0, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS span FROM transfers)))
WHERE split IS NOT NULL GROUP BY 1"""
    ),
)
def d13(spark, sf_dir):
    rows = splits.time_span_split(transfers(spark, sf_dir), "timestamp")
    return rounded(agg.split_profile(rows, "split", "is_fraud", "timestamp"), "rate", digits=6)


@register(
    "d14_daily_ratio",
    f"""WITH e AS (SELECT l_shipdate AS t, CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT CAST(floor((epoch(t) - (SELECT min(epoch(t)) FROM e)) / 86400) AS BIGINT) AS day, count(*) AS n, {sq('avg(y)', 6)} AS illicit_ratio,
{sq('avg(y) * count(*) / (SELECT count(*) FROM e)', 8)} AS weighted_ratio FROM e GROUP BY 1""",
)
def d14(spark, sf_dir):
    out = agg.daily_ratio(line_scores(spark, sf_dir), "timestamp", "label")
    return rounded(rounded(out, "illicit_ratio", digits=6), "weighted_ratio", digits=8)


@register(
    "d15_outcome_stats",
    with_scores(
        f"""SELECT outcome, count(*) AS n, {sq('avg(score)', 6)} AS mean, {sq('stddev_samp(score)', 6)} AS std, {sq('min(score)', 6)} AS min,
{sq('max(score)', 6)} AS max, {sq('avg(CAST(score < 0.3 AS INT)) * 100', 6)} AS pct_below_03, {sq('avg(CAST(score > 0.7 AS INT)) * 100', 6)} AS pct_above_07,
{sq('quantile_cont(score, 0.5)', 6)} AS median FROM o GROUP BY 1""",
        "o AS (SELECT *, CASE WHEN score >= 0.5 AND label = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scores)",
    ),
)
def d15(spark, sf_dir):
    out = agg.outcome_stats(line_scores(spark, sf_dir), "score", "label")
    return rounded(out, "mean", "std", "min", "max", "pct_below_03", "pct_above_07", "median", digits=6)


@register(
    "d16_segment_profile",
    with_scores(
        f"""SELECT segment, count(*) AS n, {sq('avg(label)', 6)} AS rate, {sq('avg(score)', 6)} AS mean_score,
{sq('count(*) FILTER (score >= 0.5 AND label = 1)::DOUBLE / count(*) FILTER (label = 1)', 6)} AS recall,
{sq('count(*) FILTER (score >= 0.5 AND label = 0)::DOUBLE / count(*) FILTER (label = 0)', 6)} AS fpr
FROM (SELECT *, CASE WHEN amount >= (SELECT quantile_cont(amount, 0.5) FROM scores) THEN 'high' ELSE 'low' END AS segment FROM scores) GROUP BY 1"""
    ),
)
def d16(spark, sf_dir):
    rows = agg.median_segments(line_scores(spark, sf_dir), "amount")
    return rounded(agg.segment_profile(rows, "segment", "score", "label"), "rate", "mean_score", "recall", "fpr", digits=6)
