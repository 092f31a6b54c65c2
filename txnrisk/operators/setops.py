"""Set operations on keys and rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, columns: Sequence[str], out: str = "id") -> DataFrame:
    """All distinct values over several columns."""
    parts = [df.select(F.col(c).alias(out)) for c in columns]
    return reduce(DataFrame.union, parts).distinct()


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def missing_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of ``left`` that ``right`` does not have."""
    return left.subtract(right)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and exact duplicates removed, in one aggregation over row groups."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates_removed"),
    )
