"""Section M: monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import monitor
from txnrisk.plans.aggregates import rounded
from txnrisk.plans.evaluation import CURVE, KEYED_CURVE
from txnrisk.plans.registry import q, register, sq, with_scores
from txnrisk.session import scratch_path
from txnrisk.sources.canonical import line_scores, user_events
from txnrisk.streaming import jobs

FEATURES = ["amount", "score", "score_b"]


def _drift(c, source="scores"):
    return f"(SELECT abs(avg({c})) / (stddev_samp({c}) + 1e-10) FROM {source})"


_DRIFT = "(" + " + ".join(_drift(c) for c in FEATURES) + ") / 3"


def _batch(spark, sf_dir):
    """Scored rows with a latency that follows from the batch: 1 ms per 100 rows."""
    rows = line_scores(spark, sf_dir)
    gappy = F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("amount"))
    return rows.withColumn("gappy", gappy)


@register(
    "m1_metric_record",
    with_scores(
        f"""SELECT max(timestamp) AS timestamp, (SELECT {sq('sum((rec - rec0) * (prec + prec0) / 2)', 8)} FROM lg) AS pr_auc,
(SELECT {sq('prec', 8)} FROM pr ORDER BY 2 * prec * rec / (prec + rec + 1e-10) DESC, score LIMIT 1) AS precision, (SELECT {sq('rec', 8)} FROM pr ORDER BY 2 * prec * rec / (prec + rec + 1e-10) DESC, score LIMIT 1) AS recall,
count(*) / 100.0::DOUBLE AS latency_ms, {sq('count(*) / (count(*) / 100.0::DOUBLE / 1000)', 4)} AS throughput_per_second, count(*) AS sample_size,
{sq('(avg(CAST(l_partkey % 13 = 0 AS INT)) + 0 + 0) / 3', 8)} AS missing_data_rate,
{sq(f'(SELECT abs(avg(amount)) / (stddev_samp(amount) + 1e-10) FROM scores WHERE l_partkey % 13 <> 0) / 3 + {_drift("score")} / 3 + {_drift("score_b")} / 3', 6)} AS data_drift_score FROM scores""",
        CURVE,
    ),
)
def m1(spark, sf_dir):
    record = monitor.metric_record(
        _batch(spark, sf_dir), "score", "label", ["gappy", "score", "score_b"], F.count(F.lit(1)) / 100.0, F.max("timestamp")
    )
    out = monitor.flat_record(record)
    out = rounded(out, "pr_auc", "precision", "recall", "missing_data_rate", digits=8)
    return rounded(rounded(out, "throughput_per_second"), "data_drift_score", digits=6)


@register("m2_drift_score", with_scores(f"SELECT {sq(_DRIFT, 6)} AS drift_score"))
def m2(spark, sf_dir):
    return rounded(monitor.drift_score(line_scores(spark, sf_dir).select(*FEATURES)), "drift_score", digits=6)


_PARTS = "old AS (SELECT * FROM scores WHERE timestamp < TIMESTAMP '1999-01-01'), cur AS (SELECT * FROM scores WHERE timestamp >= TIMESTAMP '1999-01-01')"


def _is_current():
    return F.col("timestamp") >= F.lit("1999-01-01").cast("timestamp_ntz")


@register(
    "m3_baseline_drift",
    with_scores(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM cur) AS n, {sq(f'abs((SELECT avg({c}) FROM cur) - (SELECT avg({c}) FROM old)) / ((SELECT stddev_samp({c}) FROM old) + 1e-10)', 8)} AS drift"""
            for c in FEATURES
        ),
        _PARTS,
    ),
)
def m3(spark, sf_dir):
    """The baseline is written and read back, as a monitoring job would do."""
    rows = line_scores(spark, sf_dir)
    path = scratch_path(spark, "baseline")
    monitor.baseline_stats(rows.filter(~_is_current()), FEATURES).write.parquet(path)
    out = monitor.baseline_drift(rows.filter(_is_current()), FEATURES, spark.read.parquet(path))
    return rounded(out, "drift", digits=8)


def _ks(c):
    return f"""SELECT '{c}' AS "column", max(abs(c1::DOUBLE / n1 - c0::DOUBLE / n0)) AS ks FROM (SELECT DISTINCT {c}, count(*) FILTER (y = 1) OVER (ORDER BY {c}) AS c1, count(*) FILTER (y = 0) OVER (ORDER BY {c}) AS c0,
 count(*) FILTER (y = 1) OVER () AS n1, count(*) FILTER (y = 0) OVER () AS n0 FROM s)"""


@register(
    "m4_ks_drift",
    with_scores(
        f"""SELECT "column", {sq('ks', 8)} AS ks, CASE WHEN ks > 0.2 THEN 'retrain' WHEN ks > 0.1 THEN 'alert' ELSE 'ok' END AS action FROM ({" UNION ALL ".join(_ks(c) for c in FEATURES)}) k""",
        "s AS (SELECT *, CAST(timestamp >= TIMESTAMP '1999-01-01' AS INT) AS y FROM scores)",
    ),
)
def m4(spark, sf_dir):
    rows = line_scores(spark, sf_dir).withColumn("is_current", _is_current().cast("int"))
    return rounded(monitor.ks_drift(rows, FEATURES, "is_current"), "ks", digits=8)


# One record per year: area and rates of the year's rows, a latency from its size.
YEARLY = "lm AS (SELECT CAST(year(timestamp) AS INT) AS model, score, label FROM scores)"
_RECORDS = f"""rec AS (SELECT make_timestamp(ka.model, 12, 31, 0, 0, 0.0) AS timestamp, pr AS pr_auc, n / 5.0::DOUBLE AS latency_ms, 5000.0::DOUBLE AS throughput_per_second, m AS missing_data_rate
 FROM ka JOIN (SELECT CAST(year(timestamp) AS INT) AS y, count(*) AS n, avg(CAST(l_partkey % 13 = 0 AS INT)) AS m FROM scores GROUP BY 1) ON y = ka.model)"""


def _yearly(spark, sf_dir):
    from txnrisk.operators.evaluate import ranking_metrics

    rows = _batch(spark, sf_dir).withColumn("year", F.year("timestamp"))
    areas = ranking_metrics(rows, "score", "label", ["year"]).select(F.col("year").alias("_y"), "pr_auc")
    sizes = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("gappy").isNull().cast("double")).alias("missing_data_rate"))
    at = F.make_timestamp_ntz(F.col("year"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    return sizes.join(areas, F.col("year") == F.col("_y")).select(
        at.alias("timestamp"), "pr_auc", (F.col("n") / 5.0).alias("latency_ms"), F.lit(5000.0).alias("throughput_per_second"), "missing_data_rate"
    )


def _rule_sql(rules, names):
    parts = []
    for metric, direction, threshold, level, text in rules:
        if metric in names:
            op = "<" if direction == "below" else ">"
            parts.append(
                f"SELECT timestamp, '{level}' AS level, '{metric}' AS metric, {metric} AS current_value, {threshold}::DOUBLE AS threshold, '{text}' AS description FROM rec WHERE {metric} {op} {threshold}"
            )
    return " UNION ALL ".join(parts)


_NAMES = ["pr_auc", "latency_ms", "throughput_per_second", "missing_data_rate"]


@register(
    "m5_alert_rules",
    with_scores(f"SELECT timestamp, level, metric, {sq('current_value', 8)} AS current_value, threshold, description FROM ({_rule_sql(monitor.SERVICE_RULES, _NAMES)})", YEARLY, KEYED_CURVE, _RECORDS),
)
def m5(spark, sf_dir):
    return rounded(monitor.check_alerts(_yearly(spark, sf_dir), monitor.SERVICE_RULES), "current_value", digits=8)


@register(
    "m5_configured_rules",
    with_scores(f"SELECT timestamp, level, metric, {sq('current_value', 8)} AS current_value, threshold, description FROM ({_rule_sql(monitor.CONFIGURED_RULES, _NAMES)})", YEARLY, KEYED_CURVE, _RECORDS),
)
def m5_configured(spark, sf_dir):
    return rounded(monitor.check_alerts(_yearly(spark, sf_dir), monitor.CONFIGURED_RULES), "current_value", digits=8)


@register(
    "m6_health_report",
    with_scores(
        f"""SELECT max(timestamp) AS last_update, {sq('avg(pr_auc)', 8)} AS avg_pr_auc, {sq('avg(latency_ms)', 4)} AS avg_latency, {sq('avg(throughput_per_second)', 4)} AS avg_throughput,
(SELECT count(*) FROM ({_rule_sql(monitor.CONFIGURED_RULES, _NAMES)}) WHERE CAST(timestamp AS DATE) = DATE '2000-12-31') AS alerts_today,
CASE WHEN avg(pr_auc) < 0.25 THEN 'critical' WHEN (SELECT count(*) FROM ({_rule_sql(monitor.CONFIGURED_RULES, _NAMES)}) WHERE CAST(timestamp AS DATE) = DATE '2000-12-31') > 5 THEN 'warning' ELSE 'healthy' END AS status
FROM (SELECT * FROM rec ORDER BY timestamp DESC LIMIT 3)""",
        YEARLY, KEYED_CURVE, _RECORDS,
    ),
)
def m6(spark, sf_dir):
    records = _yearly(spark, sf_dir)
    alerts = monitor.check_alerts(records, monitor.CONFIGURED_RULES)
    out = monitor.health_report(records, alerts, F.lit("2000-12-31").cast("date"), last=3)
    return rounded(rounded(out, "avg_pr_auc", digits=8), "avg_latency", "avg_throughput")


@register(
    "m7_window_metrics",
    f"""SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS window_start, count(*) AS sample_size, {sq('avg(CAST(value IS NULL AS INT))', 8)} AS missing_data_rate, {sq('avg(value)')} AS mean_value, {sq('max(value)')} AS max_value FROM events GROUP BY 1""",
)
def m7(spark, sf_dir):
    out = monitor.window_metrics(user_events(spark, sf_dir), "ts", "value")
    return out.withColumns({"missing_data_rate": q("missing_data_rate", 8), "mean_value": q("mean_value"), "max_value": q("max_value")})


@register(
    "m7_streaming_window_metrics",
    f"""SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS window_start, count(*) AS sample_size, {sq('avg(CAST(value IS NULL AS INT))', 8)} AS missing_data_rate, {sq('avg(value)')} AS mean_value, {sq('max(value)')} AS max_value FROM events GROUP BY 1
HAVING time_bucket(INTERVAL 300 SECONDS, ts) + INTERVAL 300 SECONDS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
)
def m7_stream(spark, sf_dir):
    """The same metrics from a stream; windows still open at the end are not emitted."""
    schema = user_events(spark, sf_dir).schema
    stream = jobs.read_stream(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, glob="events.parquet")
    path = scratch_path(spark, "window-metrics")
    jobs.run_to_parquet(jobs.window_metric_stream(stream.select(*schema.names), "ts", "value", late="10 minutes"), path, scratch_path(spark, "progress"))
    out = spark.read.parquet(path)
    return out.withColumns({"missing_data_rate": q("missing_data_rate", 8), "mean_value": q("mean_value"), "max_value": q("max_value")})
