"""Streaming forms of metric collection and batch scoring.

Both read files as a stream and stop when all input present at the start is processed
(``availableNow``); started without it they keep running. State and progress live in
the query's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from txnrisk.operators.monitor import window_aggregates

# Progress records kept per query: a run of as many batches can't tell whether rows were dropped, and fails.
PROGRESS = 10_000


class LateRows(RuntimeError):
    """Rows came after the watermark had passed them, so they are in no window."""


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """Files of a folder as a stream. Without ``files_per_batch`` the files that are there are one
    batch, so their order in time does not matter."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def window_metric_stream(events: DataFrame, ts: str, value: str, late: str, seconds: int = 300) -> DataFrame:
    """Metrics per time window. A window is emitted once the watermark, ``late`` behind the newest
    row of earlier batches, has passed its end; rows that come after that are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    slot = F.window("_ts", f"{seconds} seconds").alias("w")
    return timed.groupBy(slot).agg(*window_aggregates(value)).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "sample_size", "missing_data_rate", "mean_value", "max_value"
    )


def score_stream(events: DataFrame, scorer: Callable[[DataFrame], DataFrame], needs: Sequence[str] = (), gives: Sequence[str] = ()) -> DataFrame:
    """Apply a batch scoring function (feature expressions and a fitted model) to a stream.

    Fails before the stream starts if a column that the scorer ``needs`` or ``gives`` is missing,
    or if the scorer leaves the stream.
    """
    if missing := [c for c in needs if c not in events.columns]:
        raise ValueError(f"the stream lacks {missing}")
    scored = scorer(events)
    if missing := [c for c in gives if c not in scored.columns]:
        raise ValueError(f"the scorer does not give {missing}")
    if events.isStreaming and not scored.isStreaming:
        raise ValueError("the scorer gives a batch, not a stream")
    return scored


def dropped_rows(query: StreamingQuery) -> int:
    """Rows (partial aggregates, where Spark combines before the state) that came too late."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None, allow_late: bool = False) -> StreamingQuery:
    """Append to parquet until the available input is used up. The file sink is exactly-once.

    Raises ``LateRows`` if the watermark dropped rows, unless ``allow_late``, and ``TimeoutError``
    after stopping the query if it takes longer than ``timeout`` seconds.
    """
    # Spark keeps one record fewer than it is told
    stream.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", PROGRESS + 1)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    ended = query.awaitTermination(timeout)
    if timeout is not None and not ended:
        query.stop()
        raise TimeoutError(f"the stream into {path} did not end in {timeout} s")
    if query.exception() is not None:
        raise query.exception()
    if not allow_late and len(query.recentProgress) >= PROGRESS:
        raise LateRows(f"rows may have been dropped unseen in {PROGRESS} batches or more; read more files per batch or allow late rows")
    if not allow_late and (late := dropped_rows(query)):
        raise LateRows(f"{late} rows came more than the allowed time after newer ones; read more files per batch or allow more")
    return query
