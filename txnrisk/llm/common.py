"""Stored intermediate tables, size-checked broadcasts and connected components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.session import scratch_path, settle

#: Rows that go to a Python worker at once: texts may be long, and a batch is held whole.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Largest table, in rows, that is sent to every executor.
BROADCAST_ROWS = 2_000_000
#: Narrow rows that are worth a task and a file of their own.
TASK_ROWS = 100_000


#: The folder that holds this library.
_ROOT = str(Path(__file__).resolve().parents[2])


def _reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this library wherever the session was started; on a cluster
    it has to be installed or sent with ``--py-files`` as well."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``; from now on its session sends at most ``rows`` rows at once to Python."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) <= 0 or int(conf.get(_BATCH)) > rows:
        conf.set(_BATCH, rows)
    return df


def stored_in_batches(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``stored`` with at most ``rows`` rows, which are large, at once."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, rows)
    try:
        return stored(df, name)
    finally:
        conf.set(_BATCH, before)


def compact(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows in no more tasks than they are worth; many tasks of a few rows
    cost a file each wherever they shuffle or store."""
    return df.coalesce(max(1, -(-rows // task_rows)))


def stored(df: DataFrame, name: str, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is made once, survives lost
    executors, and Spark knows its size when it plans the joins. ``rows``, if known, is about
    how many rows its last stage works on, or more; ``task_rows`` of them are worth a task."""
    spark = df.sparkSession
    df = df if rows is None else compact(df, rows, task_rows)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows at most ``rows`` narrow rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each connected part; edges: a, b.

    Alternating large and small stars: each round joins every edge with the smallest
    neighbour of its end, so no node's neighbours are gathered anywhere.
    """
    edges = settle(edges.where("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    last = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
        last, rows = tuple(now), now[0]
        edges = compact(edges, rows)
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = compact(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), rows)
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = compact(compact(large, rows).distinct(), rows)
        down = compact(large.groupBy("x").agg(F.min("y").alias("m")), rows)
        small_star = compact(large.join(down, "x"), rows)
        stars = small_star.select("x", F.col("m").alias("y")).union(small_star.where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y")))
        edges = settle(compact(compact(stars, rows).distinct(), rows))
