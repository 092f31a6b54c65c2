"""Monitoring records, drift scores, alert rules and health reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators.clean import numeric_columns
from txnrisk.operators.evaluate import best_f1_point, curve, curve_metrics
from txnrisk.operators.ordering import WINDOW_ROWS
from txnrisk.operators.quantiles import long_form
from txnrisk.operators.stats import ks_two_sample

# Alert rules as (metric, direction, threshold, level, description).
SERVICE_RULES = [
    ("pr_auc", "below", 0.25, "critical", "Model performance degradation"),
    ("latency_ms", "above", 1000.0, "warning", "High inference latency"),
    ("missing_data_rate", "above", 0.2, "warning", "High missing data rate"),
]
# The configurable rules. The error rate alerts when it is too high.
CONFIGURED_RULES = [
    ("pr_auc", "below", 0.25, "critical", "Primary performance metric"),
    ("precision", "below", 0.1, "warning", "Precision at optimal threshold"),
    ("recall", "below", 0.05, "warning", "Recall at optimal threshold"),
    ("error_rate", "above", 0.01, "critical", "Prediction error rate"),
    ("latency_ms", "above", 100.0, "warning", "Average prediction latency"),
    ("throughput_per_second", "below", 50.0, "warning", "Predictions per second"),
    ("data_drift_score", "above", 0.1, "warning", "Statistical drift from training distribution"),
    ("missing_data_rate", "above", 0.05, "warning", "Rate of missing values in input"),
]
MIN_VALUES = 10
KS_ALERT, KS_RETRAIN = 0.1, 0.2


def drift_score(df: DataFrame, cols: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """Mean of |mean| / deviation over the numeric (or listed) columns with enough values.

    ``first`` limits it to that many columns, in their order.
    """
    cols = list(cols if cols is not None else numeric_columns(df))[:first]
    stats = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols])
    each = F.array(*[F.when(F.col(f"`{c}`.n") > MIN_VALUES, F.abs(F.col(f"`{c}`.m")) / (F.col(f"`{c}`.s") + 1e-10)) for c in cols])
    known = stats.select(F.filter(each, lambda x: x.isNotNull()).alias("_d"))
    mean = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_d"), F.lit(0))
    return known.select(F.coalesce(mean, F.lit(0.0)).alias("drift_score"))


def metric_record(
    df: DataFrame, score: str, label: str, features: Sequence[str], latency_ms: Column, at: Column, keys: Sequence[str] = (),
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """One nested record: performance, operation and data quality of a scored batch."""
    points = curve(df, score, label, keys, limit)
    areas = curve_metrics(points, keys).select(*keys, "pr_auc")
    best = best_f1_point(points, keys)
    nulls = [F.avg(F.col(c).isNull().cast("double")) for c in features]
    quality = df.agg(
        F.count(F.lit(1)).alias("sample_size"),
        (sum(nulls, F.lit(0.0)) / F.lit(float(len(features)))).alias("missing_data_rate"),
        at.alias("timestamp"),
        latency_ms.cast("double").alias("latency_ms"),
    )
    drift = drift_score(df.select(*features))
    through = F.when(F.col("latency_ms") > 0, F.col("sample_size") / F.nullif(F.col("latency_ms") / 1000, F.lit(0.0))).otherwise(0.0)
    return quality.select(
        "timestamp",
        F.struct(
            areas.select("pr_auc").scalar().alias("pr_auc"), best.select("precision").scalar().alias("precision"),
            best.select("recall").scalar().alias("recall"),
        ).alias("performance"),
        F.struct("latency_ms", through.alias("throughput_per_second"), "sample_size").alias("operational"),
        F.struct("missing_data_rate", drift.scalar().alias("data_drift_score")).alias("data_quality"),
    )


def flat_record(record: DataFrame) -> DataFrame:
    return record.select("timestamp", "performance.*", "operational.*", "data_quality.*")


def baseline_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, base_mean, base_std): what later batches are compared with."""
    return long_form(df, cols).groupBy("column").agg(F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"))


def baseline_drift(df: DataFrame, cols: Sequence[str], baseline: DataFrame) -> DataFrame:
    """(column, n, drift): distance of the mean from the stored mean in stored deviations."""
    now = long_form(df, cols).groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    base = baseline.withColumnRenamed("column", "_c")
    rows = now.filter(F.col("n") > MIN_VALUES).join(base, F.col("column") == F.col("_c"))
    return rows.select("column", "n", (F.abs(F.col("mean") - F.col("base_mean")) / (F.col("base_std") + 1e-10)).alias("drift"))


def ks_drift(df: DataFrame, cols: Sequence[str], is_current: str, limit: int = WINDOW_ROWS) -> DataFrame:
    """(column, ks, action) between a baseline window (0) and the current one (1)."""
    out = ks_two_sample(df, cols, is_current, limit).select("column", "ks")
    action = F.when(F.col("ks") > KS_RETRAIN, "retrain").when(F.col("ks") > KS_ALERT, "alert").otherwise("ok")
    return out.withColumn("action", action)


def rules_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rules), "metric string, direction string, threshold double, level string, description string")


def check_alerts(metrics: DataFrame, rules: Sequence[tuple], keys: Sequence[str] = ("timestamp",)) -> DataFrame:
    """One row per broken rule. ``metrics`` is flat; metrics it lacks are not checked."""
    names = [m for m in dict.fromkeys(r[0] for r in rules) if m in metrics.columns]
    values = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), names, "metric", "current_value")
    r = rules_table(metrics.sparkSession, rules).withColumnRenamed("metric", "_m")
    # a handful of fixed rules
    rows = values.join(F.broadcast(r), F.col("metric") == F.col("_m"))
    broken = F.when(F.col("direction") == "below", F.col("current_value") < F.col("threshold")).otherwise(
        F.col("current_value") > F.col("threshold")
    )
    return rows.filter(broken).select(*keys, "level", "metric", "current_value", "threshold", "description")


def health_report(records: DataFrame, alerts: DataFrame, day: Column, last: int = 10) -> DataFrame:
    """Means of the newest records, alerts of the day and the resulting status, in one row."""
    newest = records.orderBy(F.col("timestamp").desc(), *[F.col(c) for c in records.columns if c != "timestamp"]).limit(last)
    means = newest.agg(
        F.max("timestamp").alias("last_update"),
        F.avg("pr_auc").alias("avg_pr_auc"),
        F.avg("latency_ms").alias("avg_latency"),
        F.avg("throughput_per_second").alias("avg_throughput"),
    )
    today = alerts.filter(F.col("timestamp").cast("date") == day).agg(F.count(F.lit(1))).scalar()
    status = F.when(F.col("last_update").isNull(), "no_data").when(F.col("avg_pr_auc") < 0.25, "critical").when(F.col("alerts_today") > 5, "warning").otherwise("healthy")
    return means.withColumn("alerts_today", today).withColumn("status", status)


def window_metrics(events: DataFrame, ts: str, value: str, seconds: int = 300) -> DataFrame:
    """Collection of size, nulls, mean and maximum per time window (batch twin of the stream)."""
    slot = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return events.groupBy(slot.alias("w")).agg(*window_aggregates(value)).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "sample_size", "missing_data_rate", "mean_value", "max_value"
    )


def window_aggregates(value: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(F.col(value).isNull().cast("double")).alias("missing_data_rate"),
        F.avg(value).alias("mean_value"),
        F.max(value).alias("max_value"),
    ]
