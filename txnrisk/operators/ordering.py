"""Order-dependent building blocks that stay parallel when one key is huge.

A Spark window puts all rows of a partition key into one task. The functions here
count the keys first; keys above a row limit are cut into chunks of a global order,
so no task ever sorts more than about ``limit`` rows of one key. Keys below the limit
take the ordinary window. Both routes give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import settle, stored

# Most rows of one key that an ordinary window may receive.
WINDOW_ROWS = 1_000_000
# A key is hot only above this share of all rows, so there are fewer hot keys than this.
MAX_HOT_KEYS = 100_000
# Rows per task aimed at when rows of hot keys are range partitioned.
RANGE_TASK_ROWS = 2_000_000
# Rows per task aimed at when windows with several sorts follow.
FRAME_TASK_ROWS = 500_000
# Rows of one key that a chunk of the global order holds, if frames are long.
CHUNK_ROWS = 100_000
# Largest table of one narrow row per value, in rows, that is sent to every executor.
BROADCAST_ROWS = 100_000
_LOCAL_BITS = 33  # monotonically_increasing_id: partition id above, row index below

Names = Sequence[str]
Order = Sequence["str | Column"]


def as_columns(order: Order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def same_keys(left: DataFrame, right: DataFrame, keys: Names, prefix: str = "_r_") -> tuple[DataFrame, Column]:
    """Rename the keys of ``right`` and give a null-safe join condition."""
    renamed = right.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(renamed[f"{prefix}{k}"]) for k in keys],
    )
    return renamed, condition


def attach(rows: DataFrame, table: DataFrame, keys: Names, how: str = "inner") -> DataFrame:
    """Add the columns of a per-key table to its rows; without keys the table has one row."""
    if not keys:
        return rows.withColumns({c: table.select(c).scalar() for c in table.columns})
    small, condition = same_keys(rows, table, keys)
    return rows.join(small, condition, how).drop(*[f"_r_{k}" for k in keys])


def sized(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of narrow rows, made once, and broadcast if a count shows at most ``rows`` of them.

    A join with few distinct values would otherwise shuffle all rows onto these values.
    """
    made = settle(table)
    return F.broadcast(made) if made.limit(rows + 1).count() <= rows else made


def largest_group(df: DataFrame, keys: Names) -> int:
    """Rows of the largest group, from a map-side combined count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).agg(F.max("__rows")).first()[0] or 0


class HotKeys(NamedTuple):
    keys: DataFrame | None
    rows: int


def spread(df: DataFrame, keys: Names, rows: int, task_rows: int = FRAME_TASK_ROWS) -> DataFrame:
    """The rows dealt out by ``keys``, about ``task_rows`` to a task at most; few rows, or 0, leave it to Spark.

    Spark puts shuffled rows together by their compressed bytes, which windows unpack and widen.
    """
    if not keys or not task_rows or rows <= task_rows:
        return df
    return df.repartition(max(-(-rows // task_rows), df.sparkSession.sparkContext.defaultParallelism), *keys)


def hot_keys(df: DataFrame, keys: Names, limit: int = WINDOW_ROWS) -> HotKeys | None:
    """Keys with too many rows for one task and the size of the input, or None if there are none.

    There are fewer than ``MAX_HOT_KEYS`` of them by construction (each holds more than
    1/MAX_HOT_KEYS of the input), which is what makes broadcasting them safe.
    """
    found = keys_over(df, keys, limit)
    return None if found.keys is None else found


def keys_over(df: DataFrame, keys: Names, limit: int = WINDOW_ROWS) -> HotKeys:
    """``hot_keys`` with the size of the input in any case; ``keys`` is None if there are no hot ones."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    top, total = sizes.agg(F.max("__rows"), F.sum("__rows")).first()
    cut = max(limit, (total or 0) // MAX_HOT_KEYS)
    if (top or 0) <= cut:
        return HotKeys(None, total or 0)
    return HotKeys(sizes.filter(F.col("__rows") > cut).select(*keys), total)


def split_hot(df: DataFrame, keys: Names, hot: HotKeys) -> tuple[DataFrame | None, DataFrame]:
    """(rows of ordinary keys, rows of hot keys). Without keys every row is hot."""
    if not keys:
        return None, df
    small, condition = same_keys(df, hot.keys, keys)
    small = F.broadcast(small)  # bounded by MAX_HOT_KEYS
    return df.join(small, condition, "left_anti"), df.join(small, condition, "left_semi")


def global_rank(df: DataFrame, order: Order, out: str = "rank", rows: int = 0) -> DataFrame:
    """0-based position of each row in the total order, without a one-task window.

    Range partitioning sorts the rows over all tasks; the position is the row's index
    in its partition plus the sizes of the partitions before it. The partition-based
    id is settled first, since a recomputed range partitioning may cut elsewhere.
    ``rows``, if known, sets the number of tasks above the session's default.
    """
    cols = as_columns(order)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_TASK_ROWS))
    placed = stored(
        df.repartitionByRange(tasks, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("__slot", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__slot", _LOCAL_BITS))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    local = F.col("__slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # one row per range partition: the broadcast does not grow with the rows
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn(out, (F.col("__start") + local).cast("long"))
        .drop("__part", "__slot", "__start")
    )


def ranked(df: DataFrame, keys: Names, order: Order, out: str = "rank", limit: int = WINDOW_ROWS, largest: int | None = None) -> DataFrame:
    """1-based row number within ``keys``. ``largest``, if known, is a bound of a key's rows that spares counting."""
    keys = list(keys)
    cols = as_columns(order)

    def plain(frame: DataFrame) -> DataFrame:
        spec = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*cols)
        return frame.withColumn(out, F.row_number().over(spec).cast("long"))

    hot = hot_keys(df, keys, limit) if largest is None or largest > limit else None
    if hot is None:
        return plain(df)
    cold, warm = split_hot(df, keys, hot)
    placed = global_rank(warm, [*keys, *cols], "__pos", hot.rows)
    if keys:
        firsts = placed.groupBy(*keys).agg(F.min("__pos").alias("__first"))
        small, condition = same_keys(placed, firsts, keys)
        placed = placed.join(F.broadcast(small), condition).drop(*[f"_r_{k}" for k in keys])
    else:
        placed = placed.withColumn("__first", F.lit(0))
    done = placed.withColumn(out, F.col("__pos") - F.col("__first") + 1).drop("__pos", "__first")
    return done if cold is None else plain(cold).unionByName(done)


def largest_groups(df: DataFrame, key_sets: Sequence[Names]) -> list[int]:
    """Rows of the largest group by each of the key sets, in one pass; keys that share a hash count together."""
    each = [F.struct(F.lit(i).alias("__set"), (F.xxhash64(*keys) if keys else F.lit(0).cast("long")).alias("__key")) for i, keys in enumerate(key_sets)]
    sizes = df.select(F.inline(F.array(*each))).groupBy("__set", "__key").agg(F.count(F.lit(1)).alias("__rows"))
    found = {r[0]: r[1] for r in sizes.groupBy("__set").agg(F.max("__rows")).collect()}
    return [found.get(i, 0) for i in range(len(key_sets))]


def framed_by(
    df: DataFrame,
    keys: Names,
    order: Order,
    add: Callable[[DataFrame, Names, Order], DataFrame],
    lookback: int,
    limit: int = WINDOW_ROWS,
    largest: int | None = None,
    rows: int = 0,
    task_rows: int = FRAME_TASK_ROWS,
) -> DataFrame:
    """Add columns that look at most ``lookback`` rows back: ``add(frame, keys, order)`` may gather a key.

    Hot keys are cut into chunks of the global order; each chunk also receives the last
    ``lookback`` rows of the chunk before it, which are dropped afterwards. ``largest``, if known,
    is a bound of a key's rows that spares counting; ``rows`` is then the size of the input. Chunks are
    much smaller than ``limit``, so that tasks get about the same number of rows (see ``spread``).
    """
    keys = list(keys)
    found = keys_over(df, keys, limit) if largest is None or largest > limit else HotKeys(None, rows)
    if found.keys is None:
        return add(spread(df, keys, found.rows, task_rows), keys, order)
    hot = found
    cold, warm = split_hot(df, keys, hot)
    span = max(min(limit, CHUNK_ROWS), 10 * lookback if limit > CHUNK_ROWS else lookback, 1)
    chunk = F.floor(F.col("__pos") / span).cast("long")
    own = F.struct(chunk.alias("__chunk"), F.lit(True).alias("__own"))
    halo = F.struct((chunk + 1).alias("__chunk"), F.lit(False).alias("__own"))
    near_end = F.col("__pos") % span >= span - lookback
    placed = global_rank(warm, [*keys, *as_columns(order)], "__pos", hot.rows).select(
        "*", F.inline(F.when(near_end, F.array(own, halo)).otherwise(F.array(own)))
    )
    by = [*keys, "__chunk"]
    done = add(spread(placed, by, hot.rows, task_rows), by, ["__pos"]).filter("__own").drop("__own", "__chunk", "__pos")
    return done if cold is None else add(spread(cold, keys, hot.rows, task_rows), keys, order).unionByName(done)


def framed(
    df: DataFrame,
    keys: Names,
    order: Order,
    columns: Callable[[Window], dict[str, Column]],
    lookback: int,
    limit: int = WINDOW_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """``framed_by`` for window columns of one window, which sorts once."""

    def add(frame: DataFrame, by: Names, sort: Order) -> DataFrame:
        return frame.withColumns(columns(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*as_columns(sort))))

    return framed_by(df, keys, order, add, lookback, limit, largest, task_rows=0)


def running_sum(
    df: DataFrame,
    keys: Names,
    order: Order,
    sums: dict[str, Column],
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Running totals up to and including each row of a total order within ``keys``.

    Hot keys: totals per chunk are summed up over the chunks (a small table) and added
    to the running totals inside each chunk.
    """
    keys = list(keys)
    cols = as_columns(order)

    def inside(frame: DataFrame, by: list, sort: list) -> DataFrame:
        spec = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return frame.withColumns({name: F.sum(c).over(spec) for name, c in sums.items()})

    hot = hot_keys(df, keys, limit)
    if hot is None:
        return inside(df, keys or [F.lit(0)], cols)
    cold, warm = split_hot(df, keys, hot)
    placed = global_rank(warm, [*keys, *cols], "__pos", hot.rows).withColumn(
        "__chunk", F.floor(F.col("__pos") / max(limit, 1)).cast("long")
    )
    by = [*keys, "__chunk"]
    totals = placed.groupBy(*by).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums])
    done = attach(inside(placed, by, ["__pos"]), offsets, by).withColumns(
        {n: F.coalesce(F.col(n) + F.col(f"__o_{n}"), F.col(n), F.col(f"__o_{n}")) for n in sums}
    )
    done = done.drop("__pos", "__chunk", *[f"__o_{n}" for n in sums])
    return done if cold is None else inside(cold, keys, cols).unionByName(done)
