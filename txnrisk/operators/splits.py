"""Splits and folds in time order, by day balance, and stratified by class."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions.dates import micros
from txnrisk.operators.ordering import WINDOW_ROWS, ranked
from txnrisk.operators.selection import cut_ranks, hash_number, leading_number
from txnrisk.session import settle

DAY_SECONDS = 86_400


def ratio_split(
    df: DataFrame, order: Sequence, test_size: float = 0.2, out: str = "split", limit: int = WINDOW_ROWS
) -> DataFrame:
    """The first floor(n * (1 - test_size)) rows of the order train, the rest test."""
    cut = F.floor(F.col("n") * F.lit(1 - test_size))
    lead = leading_number(df, order[0]) if isinstance(order[0], str) else None
    if lead is not None:
        placed = cut_ranks(df, [], order, lead, [cut], "_cut", limit)
        return placed.withColumn(out, F.when(F.col("_cut") == 0, "train").otherwise("test")).drop("_cut")
    n = df.count()
    placed = ranked(df, [], order, "_rank", limit)
    return placed.withColumn(out, F.when(F.col("_rank") <= int(n * (1 - test_size)), "train").otherwise("test")).drop("_rank")


def _moment(us: int) -> Column:
    """Literal for microseconds since the epoch, comparable with a timestamp column."""
    text = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"timestamp_ntz'{text}'")


def time_span_split(
    df: DataFrame,
    ts: str,
    train: float = 0.6,
    val: float = 0.2,
    gap_days: float = 1,
    out: str = "split",
) -> DataFrame:
    """Cut the covered time span by shares; rows inside the gaps get a null split.

    Only the two bounds of the time column reach the driver; the split itself is a
    comparison with literals, which the scan can use as a filter.
    """
    first, last = df.agg(F.min(micros(F.col(ts))), F.max(micros(F.col(ts)))).first()
    if first is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    span = last - first
    train_end = first + math.floor(span * train)
    val_end = train_end + math.floor(span * val)
    t = F.col(ts)
    if span < DAY_SECONDS * 1_000_000:
        role = F.when(t <= _moment(train_end), "train").when(t <= _moment(val_end), "val").otherwise("test")
    else:
        gap = int(gap_days * DAY_SECONDS * 1_000_000)
        role = (
            F.when(t <= _moment(train_end), "train")
            .when((t >= _moment(train_end + gap)) & (t <= _moment(val_end)), "val")
            .when(t >= _moment(val_end + gap), "test")
        )
    return df.withColumn(out, F.when(t.isNotNull(), role))


def validate_splits(df: DataFrame, split: str, ts: str, label: str, max_difference: float = 0.05) -> DataFrame:
    """One row: time order, overlaps, share of the whole period and label rates per split."""
    names = ("train", "val", "test")
    t = micros(F.col(ts))
    per = []
    for s in names:
        own = F.col(split) == s
        per += [
            F.min(F.when(own, t)).alias(f"_{s}_min"),
            F.max(F.when(own, t)).alias(f"_{s}_max"),
            F.avg(F.when(own, F.col(label))).alias(f"{s}_rate"),
            F.count_if(own).alias(f"{s}_rows"),
        ]
    # the bounds of the splits must be known before overlapping rows can be counted
    found = df.agg(*per).first().asDict()
    train_max, val_max = F.lit(found["_train_max"]), F.lit(found["_val_max"])
    overlaps = df.agg(
        F.count_if((F.col(split) == "val") & (t <= train_max)).alias("overlap_val"),
        F.count_if((F.col(split) == "test") & (t <= val_max)).alias("overlap_test"),
    )
    types = {c: "double" if c.endswith("_rate") else "long" for c in found}
    stats = overlaps.withColumns({c: F.lit(v).cast(types[c]) for c, v in found.items()})
    whole = (F.col("_test_max") - F.col("_train_min")).cast("double")
    shares = {f"{s}_share": (F.col(f"_{s}_max") - F.col(f"_{s}_min")) / F.nullif(whole, F.lit(0.0)) for s in names}
    rates = [F.col(f"{s}_rate") for s in names]
    gap = F.greatest(F.abs(rates[0] - rates[1]), F.abs(rates[1] - rates[2]), F.abs(rates[0] - rates[2]))
    ordered = (F.col("_train_max") < F.col("_val_min")) & (F.col("_val_max") < F.col("_test_min"))
    return (
        stats.withColumns(
            {
                "is_ordered": F.coalesce(ordered, F.lit(False)),
                **shares,
                "max_rate_difference": gap,
                "is_similar": F.coalesce(gap < max_difference, F.lit(False)),
            }
        )
        .drop(*[f"_{s}_{e}" for s in names for e in ("min", "max")])
    )


def expanding_bounds(n: int, folds: int, test_size: int, gap: int = 0) -> list[tuple[int, int, int, int]]:
    """(fold, train end, test start, test end), ends exclusive; empty training is skipped.

    The newest ``test_size`` rows belong to no test block.
    """
    if folds < 1 or test_size < 1 or gap < 0:
        raise ValueError(f"folds {folds} and test size {test_size} must be positive, gap {gap} not negative")
    out = []
    for i in range(folds):
        end = max(test_size, n - (folds - i) * test_size)
        start = max(0, end - test_size)
        if start - gap > 0:
            out.append((i, start - gap, start, end))
    return out


def series_bounds(n: int, folds: int) -> list[tuple[int, int, int, int]]:
    """Equal test blocks at the end of the series, each trained on everything before it."""
    size = n // (folds + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    starts = [n - (folds - i) * size for i in range(folds)]
    return [(i, s, s, s + size) for i, s in enumerate(starts)]


def fold_role(at: Column, train_end: int, start: int, end: int) -> Column:
    """'train', 'test' or null of the row at place ``at`` (from 0)."""
    return F.when(at < train_end, "train").when((at >= start) & (at < end), "test")


def assign_folds(
    df: DataFrame, order: Sequence, bounds: Sequence[tuple[int, int, int, int]], limit: int = WINDOW_ROWS
) -> DataFrame:
    """Long form: each row once per fold it takes part in, with ``fold`` and ``role``."""
    lead = leading_number(df, order[0]) if isinstance(order[0], str) else None
    if lead is None:
        placed = ranked(df, [], order, "_rank", limit).withColumn("_at", F.col("_rank") - 1).drop("_rank")
    else:
        # the row's place is known up to the bounds around it: the bound before it stands for it
        ends = sorted({end for _, *rest in bounds for end in rest})
        starts = F.array(*[F.lit(x).cast("long") for x in (-1, *ends)])
        placed = cut_ranks(df, [], order, lead, [F.lit(e) for e in ends], "_cut", limit).withColumn("_at", starts[F.col("_cut")]).drop("_cut")
    parts = []
    for fold, train_end, start, end in bounds:
        role = fold_role(F.col("_at"), train_end, start, end)
        parts.append(F.when(role.isNotNull(), F.struct(F.lit(fold).alias("fold"), role.alias("role"))))
    return placed.select("*", F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull()))).drop("_at")


def day_index(df: DataFrame, ts: str) -> Column:
    """Whole days since the earliest timestamp."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.floor((t - df.agg(F.min(t)).scalar()) / DAY_SECONDS).cast("long")


def day_totals(df: DataFrame, ts: str) -> DataFrame:
    """(day, n, before): rows per day, zero for empty days, and rows of earlier days.

    One row per calendar day of the data: small whatever the number of transactions.
    """
    counted = df.groupBy(day_index(df, ts).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    days = counted.agg(F.max("_d").alias("_last")).select(F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("day"))
    table = days.join(counted, F.col("day") == F.col("_d"), "left").select("day", F.coalesce("_n", F.lit(0)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _cut_error(first: Column, second: Column, n: Column, shares: Sequence[float]) -> Column:
    """Largest relative deviation of the three parts from their target shares."""
    parts = (first / n, (second - first) / n, (n - second) / n)
    return F.greatest(*[F.abs(p - F.lit(s)) / F.lit(s) for p, s in zip(parts, shares)])


def best_day_cuts(df: DataFrame, ts: str, shares: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Days at which validation and test start so that the parts come closest to ``shares``.

    No day pairs are formed. For a fixed first cut the two later errors form a V over
    the second cut, so its best place is one of the two days around one known point;
    both are found by a running maximum and minimum over the sorted day table.
    """
    days = settle(day_totals(df, ts))
    total = days.agg(F.sum("n").cast("double"))
    rows = days.withColumn("_total", total.scalar())
    # where the weighted errors of parts two and three are equal
    s2, s3 = shares[1], shares[2]
    balance = (F.col("_total") * s2 + F.col("before") * s3) / (s2 + s3)
    points = rows.select(
        "day", "before", "_total",
        F.inline(
            F.array(
                F.struct(F.col("before").cast("double").alias("_x"), F.lit(0).alias("_probe")),
                F.struct(balance.alias("_x"), F.lit(1).alias("_probe")),
            )
        ),
    )
    cut = F.when(F.col("_probe") == 0, F.struct(F.col("before").alias("b"), F.col("day").alias("d")))
    everything = Window.partitionBy(F.lit(0))
    below = F.max(cut).over(everything.orderBy("_x", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    above = F.min(cut).over(everything.orderBy(F.col("_x").desc(), F.col("_probe")).rowsBetween(Window.unboundedPreceding, 0))
    later = F.min(cut).over(everything.orderBy("day").rangeBetween(1, Window.unboundedFollowing))
    near = points.select("*", below.alias("_lo"), above.alias("_hi"), later.alias("_next")).filter("_probe = 1")

    def error_at(place: str) -> Column:
        b, d = F.col(f"{place}.b"), F.col(f"{place}.d")
        usable = (d > F.col("day")) | (b > F.col("before"))
        return F.when(usable, _cut_error(F.col("before"), b, F.col("_total"), shares))

    scored = near.withColumn("error", F.least(error_at("_lo"), error_at("_hi"), error_at("_next")))
    best = scored.filter(F.col("error").isNotNull()).agg(F.min(F.struct("error", "day", "before")).alias("b")).first()["b"]
    error = F.lit(best["error"] if best else None).cast("double")
    first_day, first_before = (F.lit(best[c] if best else None).cast("long") for c in ("day", "before"))
    reached = rows.filter(F.col("day") > first_day).withColumn(
        "error", _cut_error(first_before, F.col("before"), F.col("_total"), shares)
    )
    second = reached.filter(F.col("error") <= error + F.lit(1e-12)).agg(F.min("day").alias("test_start_day"))
    return second.select(first_day.alias("val_start_day"), "test_start_day", error.alias("error"))


def day_split(df: DataFrame, ts: str, shares: Sequence[float] = (0.6, 0.2, 0.2), out: str = "split") -> DataFrame:
    """Assign rows to the day ranges found by ``best_day_cuts``."""
    first, second, _ = best_day_cuts(df, ts, shares).first()
    day = day_index(df, ts)
    return df.withColumn("_day", day).withColumn(
        out, F.when(F.col("_day") < first, "train").when(F.col("_day") < second, "val").otherwise("test")
    ).drop("_day")


def cumulative_views(df: DataFrame, split: str, out: str = "view") -> DataFrame:
    """Rows of growing graphs: train, train + val, and everything, in long form."""
    s = F.col(split)
    views = F.when(s == "train", F.array(F.lit("train"), F.lit("train_val"), F.lit("all")))
    views = views.when(s == "val", F.array(F.lit("train_val"), F.lit("all"))).when(s == "test", F.array(F.lit("all")))
    return df.select("*", F.explode(views).alias(out))


def stable_hash(cols: Sequence[str], seed: str = "") -> Column:
    """The same pseudo-random order in every run and on every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def _class_ranks(df: DataFrame, label: str, hash_cols: Sequence[str], order: Sequence, seed: str, limit: int) -> DataFrame:
    shuffled = df.withColumn("_hash", stable_hash(hash_cols, seed))
    return ranked(shuffled, [label], ["_hash", *order], "_rank", limit).drop("_hash")


def stratified_split(
    df: DataFrame,
    label: str,
    hash_cols: Sequence[str],
    order: Sequence = (),
    shares: dict[str, float] | None = None,
    seed: str = "42",
    out: str = "split",
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Shuffle each class and cut it by shares; the last name takes the remainder.

    A class usually holds most rows: its cuts are found by counting, and no row is ranked.
    """
    shares = shares or {"train": 0.6, "val": 0.2, "test": 0.2}
    names = list(shares)
    reached, cuts = 0.0, []
    for name in names[:-1]:
        reached += shares[name]
        cuts.append(F.floor(F.col("n") * F.lit(reached)))
    shuffled = df.withColumn("_hash", stable_hash(hash_cols, seed))
    placed = cut_ranks(shuffled, [label], ["_hash", *order], hash_number(F.col("_hash")), cuts, "_cut", limit) if cuts else shuffled.withColumn("_cut", F.lit(0))
    role = F.array(*[F.lit(name) for name in names])[F.col("_cut")]
    return placed.withColumn(out, role).drop("_hash", "_cut")


def stratified_folds(
    df: DataFrame,
    label: str,
    hash_cols: Sequence[str],
    k: int = 5,
    order: Sequence = (),
    seed: str = "42",
    out: str = "fold",
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    placed = _class_ranks(df, label, hash_cols, order, seed, limit)
    return placed.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
