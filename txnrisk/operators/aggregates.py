"""Group-by profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.ordering import attach
from txnrisk.operators.quantiles import long_form, quantile_row, quantiles


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """Join exact quantiles of ``value`` per key to a table of group statistics."""
    found = quantiles(df, [value], list(names.values()), keys).select(
        *keys, *[F.col("q")[i].alias(n) for i, n in enumerate(names)]
    )
    return attach(stats, found, keys, "left")


def entity_profile(df: DataFrame, entity: str, amount: str = "amount", label: str = "is_fraud") -> DataFrame:
    return df.groupBy(entity).agg(
        F.count(amount).alias(f"{amount}_count"),
        F.sum(amount).alias(f"{amount}_sum"),
        F.avg(amount).alias(f"{amount}_mean"),
        F.stddev_samp(amount).alias(f"{amount}_std"),
        F.avg(label).alias(f"{label}_mean"),
    )


def amount_profile(df: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    stats = df.groupBy(key).agg(
        F.avg(amount).alias("amount_mean"),
        F.stddev_samp(amount).alias("amount_std"),
        F.min(amount).alias("amount_min"),
        F.max(amount).alias("amount_max"),
    )
    return with_quantiles(stats, df, [key], amount, {"amount_median": 0.5})


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts; Spark spreads one group's values over tasks before counting."""
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def distinct_over(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Number of distinct values over several columns together (one row)."""
    one = df.select(F.col(columns[0]).alias("v"))
    for c in columns[1:]:
        one = one.union(df.select(c))
    return one.distinct().agg(F.count("v").alias(out))


def pattern_summary(df: DataFrame, accounts: Sequence[str], banks: Sequence[str]) -> DataFrame:
    """One row: size, amount range, distinct accounts and banks over both ends, time range."""
    stats = df.agg(
        F.count(F.lit(1)).alias("total_patterns"),
        F.min("amount").alias("amount_min"),
        F.max("amount").alias("amount_max"),
        F.avg("amount").alias("amount_mean"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
    )
    stats = with_quantiles(stats, df, [], "amount", {"amount_median": 0.5})
    return stats.withColumns(
        {
            "unique_accounts": distinct_over(df, accounts, "n").scalar(),
            "unique_banks": distinct_over(df, banks, "n").scalar(),
        }
    )


def rate_by(df: DataFrame, key: Column, name: str, label: str = "is_fraud") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("count"), F.sum(label).alias("fraud_count"), F.avg(label).alias("fraud_rate")
    )


def extremes(rates: DataFrame, name: str, value: str = "fraud_rate") -> DataFrame:
    """The categories with the highest and lowest value; equal values: the first category."""
    rank = F.struct(F.col(value), F.col(name))
    top = F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))
    return rates.agg(
        F.min_by(name, top).alias("highest"),
        F.max(value).alias("highest_value"),
        F.min_by(name, rank).alias("lowest"),
        F.min(value).alias("lowest_value"),
    )


def peak_periods(df: DataFrame, ts: str) -> DataFrame:
    """(peak_hour, peak_day, peak_month): the parts of the time with most rows, the smallest on ties; days from Monday, 0."""
    parts = {"peak_hour": F.hour(ts), "peak_day": F.weekday(ts), "peak_month": F.month(ts)}
    # one scan: a few hundred counts per hour, day and month hold all three tables
    counts = df.filter(F.col(ts).isNotNull()).groupBy(*[p.alias(n) for n, p in parts.items()]).agg(F.count(F.lit(1)).alias("n"))
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("part"), F.col("n")) for n in parts])))
    sums = long.groupBy("name", "part").agg(F.sum("n").alias("n"))
    return sums.agg(*[F.min_by(F.when(F.col("name") == n, F.col("part")), F.when(F.col("name") == n, F.struct(-F.col("n"), F.col("part")))).alias(n) for n in parts])


def hour_by_label(df: DataFrame, hour: Column, label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts per hour and class, 0 where a combination does not occur."""
    pivoted = df.groupBy(hour.alias("hour")).pivot(label, list(classes)).agg(F.count(F.lit(1)))
    return pivoted.select("hour", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"class_{c}") for c in classes])


def contingency(df: DataFrame, bin_col: str, label: str) -> DataFrame:
    return df.groupBy(bin_col).agg(
        F.count_if(F.col(label) == 1).alias("events"), F.count_if(F.col(label) == 0).alias("non_events")
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the non-null values; the total is a scalar subquery."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = df.filter(F.col(column).isNotNull()).agg(F.count(F.lit(1)))
    return counts.withColumn("share", F.col("count") / total.scalar())


def distribution_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, deviation and bias-corrected skewness and kurtosis per column."""
    n = F.count("value").cast("double")
    skew, kurt = F.skewness("value"), F.kurtosis("value")
    rows = long_form(df, cols)
    stats = rows.groupBy("column").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)).alias("kurtosis"),
    )
    medians = quantiles(df, cols, [0.5]).select(F.col("column").alias("_c"), F.col("q")[0].alias("median"))
    return stats.join(medians, F.col("column") == F.col("_c"), "left").drop("_c")


def dataset_summary(df: DataFrame, category: str = "payment_format", label: str = "is_fraud") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.avg(label).alias("fraud_rate"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.countDistinct(category).alias("unique_payment_formats"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("end"),
    )


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )
    total = (F.col("positives") + F.col("negatives")).cast("double")
    return counts.withColumns(
        {
            "rate": F.col("positives") / F.nullif(total, F.lit(0.0)),
            "scale_pos_weight": F.col("negatives") / F.nullif(F.col("positives").cast("double"), F.lit(0.0)),
        }
    )


def split_profile(df: DataFrame, split: str, label: str, ts: str) -> DataFrame:
    return df.filter(F.col(split).isNotNull()).groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )


def daily_ratio(df: DataFrame, ts: str, label: str) -> DataFrame:
    """Per day since the first timestamp: size, illicit ratio, and its share of the total."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    bounds = df.agg(F.min(t).alias("t0"), F.count(F.lit(1)).alias("n"))
    day = F.floor((t - bounds.select("t0").scalar()) / 86_400)
    daily = df.groupBy(day.cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("illicit_ratio"))
    return daily.withColumn("weighted_ratio", F.col("illicit_ratio") * F.col("n") / bounds.select("n").scalar())


def outcome(score: str, label: str, threshold: float) -> Column:
    hit, bad = F.col(score) >= threshold, F.col(label) == 1
    return F.when(hit & bad, "TP").when(hit, "FP").when(bad, "FN").otherwise("TN")


def outcome_stats(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Score statistics of true and false positives and negatives."""
    rows = df.withColumn("outcome", outcome(score, label, threshold))
    s = F.col(score)
    stats = rows.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        (F.avg((s < 0.3).cast("double")) * 100).alias("pct_below_03"),
        (F.avg((s > 0.7).cast("double")) * 100).alias("pct_above_07"),
    )
    return with_quantiles(stats, rows, ["outcome"], score, {"median": 0.5})


def median_segments(df: DataFrame, column: str, out: str = "segment") -> DataFrame:
    """Split the rows at the exact median: ``high`` is at or above it; a missing value is in neither."""
    median = F.lit(quantile_row(df, [column], [0.5]).get(column, [None])[0]).cast("double")
    return df.withColumn(out, F.when(F.col(column) >= median, "high").when(F.col(column) < median, "low"))


def segment_profile(df: DataFrame, segment: str, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, bad = F.col(score) >= threshold, F.col(label) == 1
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("rate"),
        F.avg(score).alias("mean_score"),
        (F.count_if(hit & bad) / F.nullif(F.count_if(bad), F.lit(0))).alias("recall"),
        (F.count_if(hit & ~bad) / F.nullif(F.count_if(~bad), F.lit(0))).alias("fpr"),
    )
