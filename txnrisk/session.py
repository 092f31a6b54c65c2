"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Kinds of columns that files in columns give back as they were.
PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.TimestampNTZType)


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps carry no zone, so every cast to an instant must agree on one."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the cluster's, else a temporary one in local mode only."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="txnrisk-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Used where several later steps read the same shuffled rows, and where a
    partition-dependent column must keep its value if an executor is lost.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``settle`` for tables as large as the input: compressed columns, of which later steps read those they need.

    Checkpoints hold whole rows without compression. Kinds of columns that files could change (times
    with a zone, nested ones) and names that differ by case only are checkpointed all the same.
    """
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or not all(isinstance(f.dataType, PLAIN) for f in df.schema.fields):
        return settle(df)
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Steps that run inside delete their shuffle files when they end, not whenever the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, next to the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
