"""Cleaning, validation and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions.dates import seconds
from txnrisk.functions.labels import confidence, flagged, risk_level, status
from txnrisk.functions.numeric import clamped, large_finite, to_number, zero_if_not_finite
from txnrisk.operators.quantiles import long_form, quantile_row

_FLOATS = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def clean_data(df: DataFrame) -> DataFrame:
    """Drop exact duplicates, then nulls, NaN and infinities of numeric columns to zero.

    Text columns keep their nulls: Spark columns have one type, so 0 cannot stand in.
    """
    df = df.dropDuplicates()
    fixed: dict[str, Column] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, _FLOATS):
            fixed[f.name] = zero_if_not_finite(F.col(f.name))
        elif isinstance(f.dataType, T.NumericType):
            fixed[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return df.withColumns(fixed)


def positive_amounts(df: DataFrame, amount: str = "amount", ts: str = "timestamp") -> DataFrame:
    return df.filter(F.col(amount).isNotNull() & F.col(ts).isNotNull() & (F.col(amount) > 0))


def clean_transactions(df: DataFrame, amount: str = "amount", ts: str = "timestamp") -> DataFrame:
    """Drop duplicates, null amounts and times, and amounts that are not positive."""
    return positive_amounts(df.dropDuplicates(), amount, ts)


def clean_transaction_data(df: DataFrame, amount: str = "amount", ts: str = "timestamp") -> DataFrame:
    """Like ``clean_transactions`` for amounts that may be text."""
    unique = df.dropDuplicates()
    return positive_amounts(unique.withColumn(amount, to_number(F.col(amount))), amount, ts)


def validate_compliance(df: DataFrame, required: Sequence[str], amount: str = "amount") -> DataFrame:
    """Required columns or an error; rows with nulls in them or without a positive amount go."""
    require_columns(df, required)
    return df.dropna(subset=list(required)).filter(F.col(amount) > 0)


def quality_report(df: DataFrame, label: str = "is_fraud", ts: str = "timestamp") -> DataFrame:
    """One row: size, label rate, time range, nulls per column."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.avg(label).alias("fraud_rate"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        *nulls,
    )


def validate_frame(df: DataFrame, required: Sequence[str] = (), min_rows: int | None = None) -> DataFrame:
    """One row per finding: (level, finding, column, value). No rows means nothing to report."""
    missing = sorted(set(required) - set(df.columns))
    totals = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).cast("double").alias(c) for c in df.columns]
    )
    n = F.col("n").cast("double")
    all_nulls = sum((F.col(c) for c in df.columns), F.lit(0.0))

    def finding(level: str, what: str, column: Column, value: Column, applies: Column) -> Column:
        row = F.struct(
            F.lit(level).alias("level"), F.lit(what).alias("finding"), column.cast("string").alias("column"),
            value.cast("double").alias("value"),
        )
        return F.when(applies, row)

    nothing = F.lit(None).cast("string")
    found = [finding("error", "empty", nothing, n, F.col("n") == 0)]
    if min_rows:
        found.append(finding("error", "too_few_rows", nothing, n, (F.col("n") > 0) & (F.col("n") < min_rows)))
    found += [finding("error", "missing_column", F.lit(c), F.lit(None), F.lit(True)) for c in missing]
    share = F.when(F.col("n") > 0, all_nulls / F.nullif(n * len(df.columns), F.lit(0.0)) * 100)
    found.append(finding("warning", "null_percentage", nothing, share, all_nulls > 0))
    found += [
        finding("warning", "mostly_null", F.lit(c), F.col(c) / F.nullif(n, F.lit(0.0)), F.col(c) > n * 0.5)
        for c in df.columns
    ]
    return totals.select(F.inline(F.filter(F.array(*found), lambda r: r.isNotNull())))


def validate_class_target(df: DataFrame, label: str, warn_below: float = 0.01) -> DataFrame:
    """Nulls, classes and minority/majority ratio of a class label in one row."""
    sizes = df.groupBy(label).count()
    known = F.col(label).isNotNull()
    counted = sizes.agg(
        F.coalesce(F.sum(F.when(~known, F.col("count"))), F.lit(0)).alias("null_count"),
        F.count_if(known).alias("n_classes"),
        (F.min(F.when(known, F.col("count"))) / F.max(F.when(known, F.col("count")))).alias("minority_ratio"),
    )
    return counted.withColumns(
        {
            "is_valid": (F.col("null_count") == 0) & (F.col("n_classes") >= 2),
            "is_imbalanced": F.coalesce(F.col("minority_ratio") < warn_below, F.lit(False)),
        }
    )


def validate_numeric_target(df: DataFrame, target: str) -> DataFrame:
    """Nulls and variance of a numeric target in one row."""
    stats = df.agg(F.count_if(F.col(target).isNull()).alias("null_count"), F.var_samp(target).alias("variance"))
    return stats.withColumn(
        "is_valid", (F.col("null_count") == 0) & F.coalesce(F.col("variance") != 0, F.lit(True))
    )


def numeric_features(df: DataFrame) -> DataFrame:
    """Timestamps to epoch seconds; other non-numeric columns are left out."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(seconds(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.col(f.name))
    return df.select(*out)


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls of each column to its exact median (0 when the column has no value)."""
    medians = quantile_row(df, cols, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, [0.0])[0])) for c in cols})


def replace_infinite(df: DataFrame, cols: Sequence[str], bound: float = 1e10) -> DataFrame:
    return df.withColumns({c: large_finite(F.col(c), bound) for c in cols})


def coerce_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to numbers, infinities to null, nulls to the median (0 if none), float32."""
    numbers = df.withColumns({c: to_number(F.col(c)) for c in cols})
    filled = impute_median(numbers, cols)
    return filled.withColumns({c: F.col(c).cast("float") for c in cols})


def clamp_features(df: DataFrame, cols: Sequence[str], low: float = -10.0, high: float = 10.0) -> DataFrame:
    return df.withColumns({c: clamped(F.col(c), low, high) for c in cols})


def align_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exactly ``features`` in that order; absent ones are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def decide(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Decision, status text, confidence and risk level of each score."""
    flag = flagged(F.col(score), threshold)
    return df.withColumns(
        {
            "prediction": flag,
            "status": status(flag),
            "confidence": confidence(F.col(score), flag),
            "risk_level": risk_level(F.col(score)),
        }
    )


def suspicious_summary(df: DataFrame, flag: str = "prediction") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(flag) == 1).alias("suspicious"),
        (F.avg((F.col(flag) == 1).cast("double")) * 100).alias("suspicious_pct"),
    )


def sparsity_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null share, zero share, non-zero count, mean and deviation per column, in one pass."""
    rows = long_form(df, cols)
    value = F.col("value")
    return rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(value.isNull().cast("double")) * 100).alias("null_pct"),
        (F.avg(F.coalesce(value == 0, F.lit(False)).cast("double")) * 100).alias("zero_pct"),
        F.count_if(value != 0).alias("non_zero"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def sparsity_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.max("null_pct").alias("max_null_pct"), F.count_if(F.col("zero_pct") > 50).alias("mostly_zero_columns")
    )
