"""Sinks. None of them gathers rows: every task writes its own part file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txnrisk.sources.readers import RAW_COLUMNS, RAW_TIME_FORMAT


def save_split(df: DataFrame, base: str, name: str) -> str:
    path = f"{base.rstrip('/')}/split={name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_predictions(df: DataFrame, path: str, batch_date: str, fmt: str = "csv") -> None:
    """Scored rows under ``batch_date=...``; other dates stay as they are."""
    writer = df.withColumn("batch_date", F.lit(batch_date)).write.mode("append").partitionBy("batch_date")
    writer.option("header", True).format(fmt).save(path)


def write_validated(frames: dict[str, DataFrame], base: str) -> dict[str, str]:
    """One parquet table per name."""
    paths = {name: f"{base.rstrip('/')}/{name}" for name in frames}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Globally sorted part files (range partitioned, not coalesced)."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def export_scores(df: DataFrame, path: str, ts: str, val_start: Column, test_start: Column) -> StructType:
    """Scored rows with flags of the time span they fall into; gives the written schema."""
    at = F.col(ts)
    flags = {"is_train": at < val_start, "is_val": (at >= val_start) & (at < test_start), "is_test": at >= test_start}
    out = df.withColumns({name: flag.cast("int") for name, flag in flags.items()})
    out.write.parquet(path)
    return out.schema


def append_json(df: DataFrame, path: str) -> None:
    """Metric, alert, evaluation and report records, one JSON object per line."""
    df.write.mode("append").json(path)


def write_raw_transactions(df: DataFrame, path: str, columns: dict[str, Column]) -> None:
    """Raw transaction layout, for exchange with tools that read it by position."""
    ordered = [columns[c].alias(f"c{i}") for i, c in enumerate(RAW_COLUMNS)]
    df.select(*ordered).write.mode("overwrite").option("header", True).csv(path)


def raw_time(ts: Column) -> Column:
    return F.date_format(ts, RAW_TIME_FORMAT)
