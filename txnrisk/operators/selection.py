"""Cuts of an order at given places, without ranking the rows.

A place in a total order is found from the order's leading number: a sketch encloses it, one more
aggregation counts exactly below the bracket and keeps the values inside. Then a row's side of each cut
follows from a comparison with a few numbers; only rows that share a cut's leading number are ranked.
No row but those is sorted, shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions.dates import micros
from txnrisk.operators.ordering import WINDOW_ROWS, Names, Order, largest_group, ranked, same_keys, sized
from txnrisk.operators.quantiles import RANK_ERROR, handed, many_quantiles, selected

# Evenly spaced quantiles that the sketch gives: a bracket is about this share of a group.
STEPS = 500


def leading_number(df: DataFrame, column: str, descending: bool = False) -> Column | None:
    """A double that never falls along the sorted column (ties are fine), None for kinds that have none.

    Nulls come first and NaN last, as in Spark's order, or the other way round if ``descending``.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = micros(F.col(column)).cast("double")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(F.col(column)).cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        value = F.col(column).cast("double")
    else:
        return None
    value = F.when(F.isnan(value), float("inf")).otherwise(F.coalesce(value, F.lit(float("-inf"))))
    return -value if descending else value


def hash_number(hashed: Column) -> Column:
    """The leading 52 bits of a hexadecimal text, which follow its order."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double")


def _brackets(narrow: DataFrame, groups: Names, cuts: Sequence[Column]) -> DataFrame:
    """groups..., n, _grid: two bounds per cut."""
    sketch = narrow.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), many_quantiles("value", [i / STEPS for i in range(STEPS + 1)]).alias("_q")
    )
    ends = []
    for cut in cuts:
        share = cut / F.col("n")
        below = F.floor((share - 2 * RANK_ERROR) * STEPS).cast("int") - 1
        above = F.ceil((share + 2 * RANK_ERROR) * STEPS).cast("int") + 1
        ends += [
            F.when(below >= 0, F.get("_q", F.least(below, F.lit(STEPS)))).otherwise(float("-inf")),
            F.when(above <= STEPS, F.get("_q", F.greatest(above, F.lit(0)))).otherwise(float("inf")),
        ]
    return sketch.select(*groups, "n", F.array(*ends).alias("_grid"))


def cut_ranks(
    df: DataFrame,
    keys: Names,
    order: Order,
    lead: Column,
    cuts: Sequence[Column],
    out: str = "cut",
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``out``: how many of the ascending ``cuts`` lie before the row.

    A cut ``c`` lies before a row if the row's 1-based rank within ``keys`` by ``order`` is more than
    ``c``. ``cuts`` are expressions of the group's size ``n``; ``lead`` is a double that never falls
    along ``order`` and is not null. ``order`` should be total; otherwise tied rows fall as they come.
    If no group has more than ``limit`` rows, one window ranks each in a task; the cuts are the same.
    """
    keys = list(keys)
    largest = largest_group(df, keys)
    if largest <= limit:
        whole = Window.partitionBy(*keys) if keys else None
        sized_rows = df.withColumn("n", F.count(F.lit(1)).over(whole) if keys else F.lit(largest))
        placed = ranked(sized_rows, keys, order, "_place", limit, largest)
        return placed.withColumn(out, sum(((F.col("_place") > c).cast("int") for c in cuts), F.lit(0))).drop("_place", "n")
    groups = [*keys, "_all"]
    rows = df.withColumns({"_all": F.lit(0), "_lead": lead + F.lit(0.0)})
    narrow = rows.select(*groups, F.col("_lead").alias("value"))
    brackets = _brackets(narrow, groups, cuts)
    brackets = sized(brackets) if keys else F.broadcast(handed(brackets))
    places = [F.least(F.greatest(c - 1, F.lit(0)), F.col("n") - 1) for c in cuts]
    found = selected(narrow, groups, brackets, places, limit)
    cut = lambda k, c: F.struct(
        F.col("_at")[k]["value"].alias("value"),
        (c.cast("long") - F.col("_at")[k]["before"]).alias("left"),
        F.when(c <= 0, -1).when(c >= F.col("n"), 1).otherwise(0).alias("side"),
    )
    table = found.select(*groups, F.array(*[cut(k, c) for k, c in enumerate(cuts)]).alias("_cuts"))
    if keys:
        small, condition = same_keys(rows, sized(table), groups)
        placed = rows.join(small, condition).drop(*[f"_r_{g}" for g in groups])
    else:
        # one row: a few numbers, as literals
        only = table.first()
        placed = rows
    each = [F.get("_cuts", F.lit(k)) for k in range(len(cuts))] if keys else [{name: F.lit(c[name]) for name in ("value", "left", "side")} for c in only["_cuts"]]
    tied = F.lit(False)
    for c in each:
        tied = tied | ((c["side"] == 0) & (c["value"] == F.col("_lead")))

    def side(before_at_tie: list[Column]) -> Column:
        passed = [
            F.when(c["side"] != 0, (c["side"] < 0).cast("int")).when(c["value"] != F.col("_lead"), (c["value"] < F.col("_lead")).cast("int")).otherwise(t)
            for c, t in zip(each, before_at_tie, strict=True)
        ]
        return sum(passed, F.lit(0)).cast("int")

    spare = ["_all", "_lead", "_cuts"]
    clear = placed.where(~tied).withColumn(out, side([F.lit(0)] * len(each))).drop(*spare)
    # how many rows share a cut's number is known
    largest = found.agg(F.max(F.array_max(F.transform("_at", lambda a: a["times"])))).first()[0] or 0
    close = ranked(placed.where(tied), [*keys, "_lead"], order, "_place", limit, largest)
    close = close.withColumn(out, side([(F.col("_place") > c["left"]).cast("int") for c in each])).drop(*spare, "_place")
    return clear.unionByName(close)
