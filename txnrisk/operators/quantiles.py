"""Exact quantiles that never hold a group's values in one task.

Large groups are bracketed first: a sketch of bounded size, combined map-side, gives for each wanted
position two values that enclose it. One more aggregation counts exactly what lies below each bracket
and keeps the few values inside, which alone are ordered. The counts prove that the bracket holds the
position; a bracket that does not is opened to the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from txnrisk.operators.ordering import WINDOW_ROWS, attach, largest_group, running_sum, same_keys, sized
from txnrisk.session import settle

# Most distinct values per group for which the built-in percentile is used.
MAP_VALUES = 100_000
# The sketch's ranks are off by at most this share of a group.
RANK_ERROR = 1e-4
# Largest table of values inside brackets that is finished on the driver.
DRIVER_CELLS = 20_000
# Rows of a group that are all taken as inside its brackets.
ALL_INSIDE = 20_000


def long_form(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys..., column, value (double): one row per value of the listed columns."""
    picked = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return picked.unpivot(list(keys), list(cols), "column", "value")


def value_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys..., column, value, n over non-null, non-NaN values."""
    rows = long_form(df, cols, keys).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(
    counts: DataFrame, probs: Sequence[float], keys: Sequence[str], limit: int = WINDOW_ROWS
) -> DataFrame:
    """keys..., n, q: array of linearly interpolated quantiles, from (keys, value, n) rows.

    The built-in exact percentile keeps one map entry per distinct value of a group, so
    it serves groups counted to be small. Otherwise: the value at 0-based position i is the smallest one whose running count exceeds i,
    so each quantile needs two minima and no group is ever collected.
    """
    keys = list(keys)
    if largest_group(counts, keys) <= min(limit, MAP_VALUES):
        return counts.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.percentile("value", [float(p) for p in probs], F.col("n")).alias("q")
        )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    running = running_sum(counts, keys, ["value"], {"_seen": F.col("n")}, limit)
    rows = attach(running, totals, keys)

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_seen") > position, F.col("value")))

    found = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        found += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    out = rows.groupBy(*keys).agg(F.first("_total").alias("n"), *found)
    values = [between(F.lit(float(p)) * (F.col("n") - 1), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, p in enumerate(probs)]
    return out.select(*keys, "n", F.array(*values).alias("q"))


def between(place: Column, low: Column, high: Column) -> Column:
    """The value at a fractional position, from the values at the positions around it."""
    # the built-in's two products: infinite values stay infinite and are not subtracted
    mixed = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    return F.when((low == high) | (place == F.floor(place)), low).otherwise(mixed)


def many_quantiles(column: str, probs: Sequence[float], accuracy: int | None = None) -> Column:
    """A sketch's values at many probabilities, as text: a column object for each would take longer than the job."""
    listed = ", ".join(f"{float(p)!r}D" for p in probs)
    return F.expr(f"percentile_approx({column}, array({listed}), {accuracy or round(1 / RANK_ERROR)})")


def sketched(rows: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """groups..., n, _grid: a lower and an upper bound of each quantile's values, in turn."""
    grid = [b for p in probs for b in (max(0.0, p - 2 * RANK_ERROR), min(1.0, p + 2 * RANK_ERROR))]
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), many_quantiles("value", grid).alias("_grid"))


def selected(rows: DataFrame, groups: Sequence[str], brackets: DataFrame, places: Sequence[Column], limit: int) -> DataFrame:
    """groups..., n, _at: per place (from 0) its value, how many values are smaller and how many equal.

    ``rows`` are (groups..., value) without nulls and NaN, ``brackets`` (groups..., n, _grid) with two
    bounds per place, one row per group, a stored table that is marked for broadcast if its size allows;
    ``places`` are expressions of ``n``.
    """
    groups = list(groups)
    # small groups, and places at the ends of a group, are open on that side
    grid = F.transform("_grid", lambda g, i: F.when(F.col("n") > ALL_INSIDE, g).when(i % 2 == 0, float("-inf")).otherwise(float("inf")))
    brackets = brackets.select(*groups, "n", grid.alias("_grid"), F.array(*[p.cast("long") for p in places]).alias("_places"))
    out = _inside(rows, groups, brackets, len(places), limit)
    if out.where(F.exists("_at", lambda a: a.isNull())).limit(1).count():
        wide = F.transform("_grid", lambda g, i: F.when(i % 2 == 0, float("-inf")).otherwise(float("inf")))
        out = _inside(rows, groups, brackets.withColumn("_grid", wide), len(places), limit)
    return out


def _inside(rows: DataFrame, groups: Sequence[str], brackets: DataFrame, count: int, limit: int) -> DataFrame:
    bounds = {f"_{end}{k}": F.col("_grid")[2 * k + i] for k in range(count) for i, end in enumerate(("lo", "hi"))}
    table, condition = same_keys(rows, brackets.select(*groups, *[c.alias(n) for n, c in bounds.items()]), groups)
    joined = rows.join(table, condition)
    value = F.col("value")
    inside = [(value >= F.col(f"_lo{k}")) & (value <= F.col(f"_hi{k}")) for k in range(count)]
    # one row per value in any bracket, one for all other values; both know how many lie below each bracket
    cell = F.when(reduce(lambda a, b: a | b, inside), value)
    below = [F.sum((value < F.col(f"_lo{k}")).cast("long")).alias(f"_b{k}") for k in range(count)]
    counted = settle(joined.groupBy(*groups, cell.alias("value")).agg(F.count(F.lit(1)).alias("_c"), *below))
    few = counted.limit(DRIVER_CELLS + 1).collect()
    if len(few) <= DRIVER_CELLS:
        return _finished(few, groups, brackets, count)
    totals = counted.groupBy(*groups).agg(F.array(*[F.sum(f"_b{k}") for k in range(count)]).alias("_below"))
    totals = attach(brackets, totals, groups, "left")
    held = attach(counted.where("value is not null").select(*groups, "value", "_c"), totals.select(*groups, "_grid", "_below", "_places"), groups)
    probe = [F.struct(F.lit(k).alias("_probe"), F.col("_below")[k].alias("_before"), F.col("_places")[k].alias("_place")) for k in range(count)]
    hits = [F.when((value >= F.col("_grid")[2 * k]) & (value <= F.col("_grid")[2 * k + 1]), probe[k]) for k in range(count)]
    held = held.select(*groups, "value", "_c", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    held = running_sum(held, [*groups, "_probe"], ["value"], {"_seen": F.col("_c")}, limit)
    # the smallest value whose running count passes the place
    passes = (F.col("_before") <= F.col("_place")) & (F.col("_before") + F.col("_seen") > F.col("_place"))
    at = F.struct("value", (F.col("_before") + F.col("_seen") - F.col("_c")).alias("before"), F.col("_c").alias("times"))
    found = held.where(passes).groupBy(*groups).agg(*[F.min(F.when(F.col("_probe") == k, at)).alias(f"_v{k}") for k in range(count)])
    out = attach(totals.select(*groups, "n"), found, groups, "left")
    # one row per group, read by the check and by what follows
    return settle(out.select(*groups, "n", F.array(*[F.col(f"_v{k}") for k in range(count)]).alias("_at")))


def _finished(cells: Sequence[Row], groups: Sequence[str], brackets: DataFrame, count: int) -> DataFrame:
    """``selected`` from counted cells, of which there are few, and so are groups."""
    held: dict[tuple, list[Row]] = {}
    below: dict[tuple, list[int]] = {}
    for r in cells:
        key = tuple(r[g] for g in groups)
        below[key] = [b + r[f"_b{k}"] for k, b in enumerate(below.get(key, [0] * count))]
        if r["value"] is not None:
            held.setdefault(key, []).append(r)
    out = []
    for b in brackets.collect():
        key = tuple(b[g] for g in groups)
        values = sorted(held.get(key, []), key=lambda r: r["value"])
        found: list[tuple | None] = []
        for k in range(count):
            seen = before = below.get(key, [0] * count)[k]
            at = None
            for r in values if before <= b["_places"][k] else ():
                if b["_grid"][2 * k] <= r["value"] <= b["_grid"][2 * k + 1]:
                    seen += r["_c"]
                    if seen > b["_places"][k]:
                        at = (r["value"], seen - r["_c"], r["_c"])
                        break
            found.append(at)
        out.append((*key, b["n"], found))
    kinds = ", ".join(f"`{g}` {brackets.schema[g].dataType.simpleString()}" for g in groups)
    return brackets.sparkSession.createDataFrame(out, f"{kinds}, n long, _at array<struct<value:double,before:long,times:long>>")


def handed(df: DataFrame) -> DataFrame:
    """A table that has few rows by construction, made once and kept on the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    approx: bool = False,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """keys..., column, n, q for all columns and probabilities together; groups without values are left out.

    Groups counted to be small take the built-in percentile, others are bracketed. ``approx=True``
    trades exactness for a bounded sketch per group.
    """
    if approx:
        rows = long_form(df, cols, keys).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        return rows.groupBy(*keys, "column").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("value", list(map(float, probs)), 10_000).alias("q")
        )
    rows = long_form(df, cols, keys).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("value", F.col("value") + F.lit(0.0))
    groups = [*keys, "column"]
    # without keys the sketch has one row per column, and its counts come for free
    sketch = None if keys else handed(sketched(rows, groups, probs))
    largest = largest_group(rows, groups) if sketch is None else sketch.agg(F.max("n")).first()[0] or 0
    if largest <= min(limit, MAP_VALUES):
        return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", [float(p) for p in probs]).alias("q"))
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ends = [end for p in places for end in (F.floor(p), F.ceil(p))]
    sketch = sized(sketched(rows, groups, probs)) if sketch is None else F.broadcast(sketch)
    # both ends of a place share its bracket
    twice = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2 * len(probs) - 1)), lambda i: F.slice("_grid", i - i % 2 + 1, 2)))
    found = selected(rows, groups, sketch.withColumn("_grid", twice), ends, limit)
    values = [between(p, F.col("_at")[2 * i]["value"], F.col("_at")[2 * i + 1]["value"]) for i, p in enumerate(places)]
    return found.select(*groups, "n", F.array(*values).alias("q"))


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = WINDOW_ROWS) -> dict[str, list[float]]:
    """The quantiles of each column on the driver: one small array per column."""
    return {r["column"]: list(r["q"]) for r in quantiles(df, cols, probs, limit=limit).collect()}
