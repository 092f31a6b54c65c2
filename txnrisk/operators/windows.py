"""Time-series features per account: rolling, lagged and successive-transfer columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions.dates import micros
from txnrisk.functions.numeric import guarded_ratio
from txnrisk.operators.ordering import (
    BROADCAST_ROWS,
    FRAME_TASK_ROWS,
    WINDOW_ROWS,
    Names,
    Order,
    as_columns,
    attach,
    framed,
    framed_by,
    global_rank,
    largest_group,
    largest_groups,
    running_sum,
)
from txnrisk.session import PLAIN, scratch_path, settle, shuffles_freed

DAY_MICROS = 86_400_000_000
# Most rows of one key for which a moving time range is read directly.
RANGE_ROWS = 20_000
# Longest frame of rows that is read again for every row; longer ones are joined from blocks.
READ_AGAIN = 8
# Places to which rows of a key are hashed; tasks hold many of them.
HOMES = 1 << 20


def _moments(values: Names, over: Window, tag: str) -> dict[str, Column]:
    """Count, sum and squared deviations of each column over a window."""
    out: dict[str, Column] = {}
    for v in values:
        n = F.count(v).over(over)
        out |= {f"{tag}_n_{v}": n, f"{tag}_s_{v}": F.sum(v).over(over), f"{tag}_d_{v}": F.var_pop(v).over(over) * n}
    return out


def moving_moments(frame: DataFrame, by: Names, order: Order, values: Names, windows: Sequence[int], spare: Names = ()) -> DataFrame:
    """Add ``_n``, ``_s`` and ``_d`` (count, sum, squared deviations) of the last ``w`` rows as ``_n_{value}_{w}``.

    Short frames are read directly. For a longer one the rows are cut into blocks of ``w``: the last
    ``w`` rows are the beginning of the row's own block and the end of the block before, so two running
    aggregates, one forwards and one backwards, serve every row at a constant cost. They are merged, never
    taken apart: no sum loses digits to amounts outside its rows. Lengths that divide each other share
    their sorts. Sum and deviations are null without a value, as in Spark.
    """
    order = as_columns(order)
    windows = sorted(set(windows))
    spec = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    short = {}
    for w in (w for w in windows if w <= READ_AGAIN):
        short |= {f"{k}_{w}": c for k, c in _moments(values, spec.rowsBetween(-(w - 1), 0), "").items()}
    chains: list[list[int]] = []
    for w in (w for w in windows if w > READ_AGAIN):
        chain = next((c for c in chains if w % c[-1] == 0), None)
        if chain is None:
            chains.append([w])
        else:
            chain.append(w)
    frame = frame.withColumns(short)
    if not chains:
        return frame
    frame = frame.withColumn("_i", F.row_number().over(spec).cast("long") - 1).drop(*spare)
    for chain in chains:
        frame = _block_moments(frame, list(by) or [F.lit(0)], values, chain[::-1])
    return frame.drop("_i")


def _block_moments(frame: DataFrame, by: list, values: Names, sizes: Sequence[int]) -> DataFrame:
    """The moments of frames of ``sizes`` rows; each size is a multiple of the next."""
    frame = frame.withColumns({f"_up{w}": F.floor(F.col("_i") / w) for w in sizes} | {f"_down{w}": -F.floor(F.col("_i") / w) for w in sizes})
    running = (Window.unboundedPreceding, 0)
    for tag, last in (("up", F.col("_i").asc()), ("down", F.col("_i").desc())):
        blocks = [f"_{tag}{w}" for w in sizes]
        made: dict[str, Column] = {}
        for k, w in enumerate(sizes):
            # all these windows ask for the same sort: keys, blocks from the largest on, rows
            spec = Window.partitionBy(*by, *blocks[: k + 1]).orderBy(*blocks[k + 1 :], last).rowsBetween(*running)
            made |= _moments(values, spec, f"_{tag}{w}")
        frame = frame.withColumns(made)
    downs = Window.partitionBy(*by).orderBy(*[f"_down{w}" for w in sizes], F.col("_i").desc())
    before = {f"_before{w}_{m}_{v}": F.lead(f"_down{w}_{m}_{v}", w - 1).over(downs) for w in sizes for m in "nsd" for v in values}
    frame = frame.withColumns(before)
    out: dict[str, Column] = {}
    for w in sizes:
        across = (F.col("_i") >= w) & (F.col("_i") % w != w - 1)
        for v in values:
            n1, s1, d1 = (F.col(f"_up{w}_{m}_{v}") for m in "nsd")
            n0, s0, d0 = (F.when(across, F.col(f"_before{w}_{m}_{v}")) for m in "nsd")
            both = (n0 > 0) & (n1 > 0)
            gap = s1 / F.nullif(n1, F.lit(0)) - s0 / F.nullif(n0, F.lit(0))
            out[f"_n_{v}_{w}"] = n1 + F.coalesce(n0, F.lit(0))
            out[f"_s_{v}_{w}"] = F.when(both, s0 + s1).otherwise(F.coalesce(s1, s0))
            out[f"_d_{v}_{w}"] = F.when(both, d0 + d1 + gap * gap * (n0 * n1 / F.nullif(n0 + n1, F.lit(0)))).otherwise(F.coalesce(d1, d0))
    spare = [c for c in frame.columns if c.startswith(("_up", "_down", "_before"))]
    return frame.withColumns(out).drop(*spare)


def _mean(v: str, w: int, tag: str = "") -> Column:
    return F.col(f"{tag}_s_{v}_{w}") / F.nullif(F.col(f"{tag}_n_{v}_{w}"), F.lit(0))


def _deviation(v: str, w: int, tag: str = "") -> Column:
    """Sample deviation; null below two values."""
    n = F.col(f"{tag}_n_{v}_{w}")
    return F.when(n > 1, F.sqrt(F.col(f"{tag}_d_{v}_{w}") / F.nullif(n - 1, F.lit(0))))


def rolling_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value_cols: Sequence[str],
    windows: Sequence[int] = (7, 30, 90),
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Sum, mean, count and sample deviation over the last ``w`` rows of each key.

    ``w`` counts rows, not days, although the column names end in ``d``. Base value
    columns only: generated columns never feed another window.

    Rows are stored once, numbered in their order. They meet again where the windows of the key with the
    smallest groups are: windows of the other keys move the number, the key and the values there and
    counts, sums and deviations back. One shuffle puts all of this together.
    """
    spark = df.sparkSession
    moments = [f"_{m}_{v}_{w}" for m in "nsd" for v in value_cols for w in windows]
    tags = {key: f"_{i}" for i, key in enumerate(keys)}
    with shuffles_freed(spark):
        count = df.count()
        rows = global_rank(df, order, "_row", count)
        sizes = largest_groups(rows, [[k] for k in keys])
        # if no key and its moments fit a task, rows are dealt out by their number and all keys' moments come to them
        stay = keys[sizes.index(min(sizes))] if min(sizes) * len(keys) <= limit else None
        others = [k for k in keys if k != stay]
        rows = rows.withColumn("_home", F.pmod(F.xxhash64(stay or "_row"), F.lit(HOMES)))
        out = rows.withColumn("_kind", F.lit(0))
        for kind, key in enumerate(others, 1):

            def add(frame: DataFrame, by: Names, sort: Order) -> DataFrame:
                kept = [c for c in ("__own", "__chunk", "__pos") if c in frame.columns]
                return moving_moments(frame, by, sort, value_cols, windows).select("_home", "_row", *kept, F.struct(*moments).alias("_found"))

            narrow = rows.select("_home", "_row", *dict.fromkeys([key, *value_cols]))
            largest = sizes[keys.index(key)]
            found = framed_by(narrow, [key], ["_row"], add, lookback=max(windows) - 1, limit=limit, largest=largest, rows=count)
            out = out.unionByName(found.withColumn("_kind", F.lit(kind)), allowMissingColumns=True)
    total = count * (1 + len(others))
    tasks = max(-(-total // FRAME_TASK_ROWS), spark.sparkContext.defaultParallelism)
    out = out.repartition(tasks, "_home") if total > FRAME_TASK_ROWS else out.repartition("_home")
    if others:
        # a row is followed by its moments, one row a key
        after = Window.partitionBy("_home").orderBy("_row", "_kind")
        out = out.withColumns({tags[key]: F.lead("_found", kind).over(after) for kind, key in enumerate(others, 1)})
        out = out.filter("_kind = 0").drop("_found")
    out = out.drop("_kind")
    if stay is not None:
        out = moving_moments(out, ["_home", stay], ["_row"], value_cols, windows).withColumn(tags[stay], F.struct(*moments)).drop(*moments)
    made: dict[str, Column] = {}
    for key, tag in tags.items():
        for w in windows:
            for v in value_cols:
                name = f"{key}_{v}"
                made[f"{name}_sum_{w}d"] = F.coalesce(f"{tag}._s_{v}_{w}", F.lit(0.0))
                made[f"{name}_mean_{w}d"] = F.coalesce(_mean(v, w, f"{tag}."), F.lit(0.0))
                made[f"{name}_count_{w}d"] = F.col(f"{tag}._n_{v}_{w}")
                made[f"{name}_std_{w}d"] = F.coalesce(_deviation(v, w, f"{tag}."), F.lit(0.0))
    return out.withColumns(made).drop("_row", "_home", *tags.values())


def rolling_days(
    df: DataFrame,
    key: str,
    ts: str = "timestamp",
    value: str = "amount",
    days: Sequence[int] = (7, 30),
    names: str = "{key}_{value}_{stat}_{days}d",
    tie_mode: str = "peers",
    tiebreak: Sequence[str] = (),
    limit: int = RANGE_ROWS,
    chunk_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Sum, mean and count over the time range (t - days, t] of each key.

    ``tie_mode='peers'``: rows with equal timestamps see each other. ``'rows'``: a row
    sees only the equal-time rows before it by ``tiebreak``. Rows without a time see each
    other, or those before them.

    Spark re-reads a moving range for every row, so as soon as one key has more than ``limit``
    rows (and always in ``rows`` mode) the range is joined from two blocks of ``days``: the
    beginning of the row's own block and the end of the one before. Each is a running sum, so the
    cost per row does not depend on the rows in the range, and nothing is ever subtracted: only
    amounts of the range enter its sum. Beyond ``chunk_rows`` rows a key is spread over tasks.
    """
    if tie_mode not in ("peers", "rows"):
        raise ValueError("tie_mode is 'peers' or 'rows'")

    def name(stat: str, d: int) -> str:
        return names.format(key=key, value=value, stat=stat, days=d)

    def finish(frame: DataFrame) -> DataFrame:
        out: dict[str, Column] = {}
        for d in days:
            total, n = F.col(f"_sum_{d}"), F.col(f"_cnt_{d}")
            out[name("sum", d)] = F.coalesce(total, F.lit(0.0))
            out[name("mean", d)] = F.when(n > 0, total / F.nullif(n, F.lit(0))).otherwise(0.0)
            out[name("count", d)] = n
        return frame.withColumns(out).drop("_t", *[f"_{s}_{d}" for s in ("sum", "cnt") for d in days])

    def plain(frame: DataFrame) -> DataFrame:
        spec = Window.partitionBy(key).orderBy("_t")
        out: dict[str, Column] = {}
        for d in days:
            span = spec.rangeBetween(-(d * DAY_MICROS) + 1, 0)
            out[f"_sum_{d}"] = F.sum(value).over(span)
            out[f"_cnt_{d}"] = F.count(value).over(span)
        return frame.withColumns(out)

    df = df.withColumn("_t", micros(F.col(ts)))
    largest = largest_group(df, [key])
    if tie_mode == "peers" and largest <= limit:
        return finish(plain(df))
    order = ["_t", *tiebreak] if tie_mode == "rows" else ["_t"]
    names_in = df.columns
    rows = df.select(
        key, "_t", F.col(value).cast("double").alias("_v"), F.col(value).isNotNull().cast("long").alias("_n"),
        *(tiebreak if tie_mode == "rows" else []), F.struct(*names_in).alias("_row"),
    )
    sums = [f"_{s}_{d}" for d in days for s in ("sum", "cnt")]
    if largest <= chunk_rows:
        # all blocks of a key stay where one shuffle puts them
        found = _joined_blocks(rows.repartition(key), key, days, order, partial(_running, rows=tie_mode == "rows"))
        return finish(found.select("_row.*", *sums))
    running = partial(running_sum, limit=chunk_rows)
    if tie_mode == "rows":
        return finish(_joined_blocks(settle(rows), key, days, order, running).select("_row.*", *sums))
    per_time = settle(rows.groupBy(key, "_t").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n")))
    return finish(attach(df, _joined_blocks(per_time, key, days, order, running).select(key, "_t", *sums), [key, "_t"]))


def _running(frame: DataFrame, by: Names, order: Order, sums: dict[str, Column], rows: bool) -> DataFrame:
    spec = Window.partitionBy(*by).orderBy(*order)
    spec = spec.rowsBetween(Window.unboundedPreceding, 0) if rows else spec.rangeBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({name: F.sum(c).over(spec) for name, c in sums.items()})


def _joined_blocks(rows: DataFrame, key: str, days: Sequence[int], order: Order, running: Callable[..., DataFrame]) -> DataFrame:
    """Add ``_sum_d`` and ``_cnt_d`` of ``_v`` and ``_n`` over (t - d, t].

    With time cut into blocks of ``d`` days, t - d lies in the block before t's. What that block has
    after t - d is the running sum, backwards from its end, that a mark at t - d meets.
    """
    carried = list(rows.columns)
    for d in days:
        span = d * DAY_MICROS
        rows = rows.withColumn("_block", F.col("_t") - F.pmod("_t", F.lit(span)))
        rows = running(rows, [key, "_block"], order, {"_own": F.coalesce("_v", F.lit(0.0)), "_own_n": F.col("_n")})
        moves = F.array(
            F.struct(F.col("_block").alias("_in"), F.col("_t").alias("_at"), F.lit(False).alias("_mark")),
            F.struct((F.col("_block") - span).alias("_in"), (F.col("_t") - span).alias("_at"), F.lit(True).alias("_mark")),
        )
        others = [c for c in carried if c not in (key, "_v", "_n")] + ["_own", "_own_n"]
        events = rows.select(key, "_v", "_n", *others, F.inline(moves))
        # rows that only give their amount need no other column
        events = events.withColumns({c: F.when(F.col("_mark"), F.col(c)) for c in others})
        given = {"_end": F.when(F.col("_mark") | F.col("_v").isNull(), 0.0).otherwise(F.col("_v")), "_end_n": F.when(F.col("_mark"), 0).otherwise(F.col("_n"))}
        # backwards in time, marks first: amounts at t - d itself are out of the range
        swept = running(events, [key, "_in"], [F.col("_at").desc(), F.col("_mark").desc()], given).filter("_mark")
        rows = swept.select(*carried, (F.col("_own") + F.col("_end")).alias(f"_sum_{d}"), (F.col("_own_n") + F.col("_end_n")).cast("long").alias(f"_cnt_{d}"))
        carried += [f"_sum_{d}", f"_cnt_{d}"]
    return rows


def short_run_features(
    df: DataFrame, key: str, order: Sequence[str], value: str = "amount", size: int = 3, limit: int = WINDOW_ROWS, base: DataFrame | None = None
) -> DataFrame:
    """Mean, deviation and variation over the last ``size`` rows; null until the window is full.

    ``base``, if given, has the same keys and is cheaper to read for counting.
    """
    largest = None if base is None else largest_group(base, [key])

    def columns(spec: Window) -> dict[str, Column]:
        frame = spec.rowsBetween(-(size - 1), 0)
        full = F.count(value).over(frame) == size
        return {
            f"rolling_{value}_mean_{size}": F.when(full, F.avg(value).over(frame)),
            f"rolling_{value}_std_{size}": F.when(full, F.stddev_samp(value).over(frame)),
        }

    out = framed(df, [key], order, columns, lookback=size - 1, limit=limit, largest=largest)
    mean, std = F.col(f"rolling_{value}_mean_{size}"), F.col(f"rolling_{value}_std_{size}")
    return out.withColumn(f"{value}_cv_{size}", guarded_ratio(std, mean, 1e-6))


def lags(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    periods: Sequence[int] = (1, 7, 14, 30),
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Earlier values of a column; ``keys=[]`` follows one global time order."""

    def columns(spec: Window) -> dict[str, Column]:
        return {f"{value}_lag_{p}": F.lag(value, p).over(spec) for p in periods}

    return framed(df, keys, order, columns, lookback=max(periods), limit=limit)


def rolling_target(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    windows: Sequence[int] = (7, 14, 30),
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Rolling mean and deviation of a column over rows; deviation is null for one row."""

    def add(frame: DataFrame, by: Names, sort: Order) -> DataFrame:
        out: dict[str, Column] = {}
        for w in windows:
            out[f"{value}_rolling_mean_{w}"] = _mean(value, w)
            out[f"{value}_rolling_std_{w}"] = _deviation(value, w)
        return moving_moments(frame, by, sort, [value], windows).withColumns(out).drop(*[f"_{m}_{value}_{w}" for m in "nsd" for w in windows])

    return framed_by(df, keys, order, add, lookback=max(windows) - 1, limit=limit)


def is_time_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, limit: int = WINDOW_ROWS) -> DataFrame:
    """Does ``ts`` never fall along ``order``? One row per key (one row without keys)."""

    def columns(spec: Window) -> dict[str, Column]:
        return {"_before": F.lag(ts).over(spec)}

    steps = framed(df, keys, order, columns, lookback=1, limit=limit)
    broken = F.col("_before").isNotNull() & (F.col("_before") > F.col(ts))
    return steps.groupBy(*keys).agg(
        (F.sum(broken.cast("int")) == 0).alias("is_ordered"), F.sum(broken.cast("int")).alias("n_breaks")
    )


def time_deltas(
    df: DataFrame,
    src: str = "source",
    dst: str = "target",
    ts: str = "timestamp",
    tiebreak: Sequence[str] = (),
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Seconds since the receiver's last incoming and the sender's last outgoing transfer."""
    df = df.withColumn("_t", micros(F.col(ts)))

    for key, out in ((dst, "in_time_delta"), (src, "out_time_delta")):

        def columns(spec: Window, out: str = out) -> dict[str, Column]:
            gap = (F.col("_t") - F.lag("_t").over(spec)) / F.lit(1_000_000)
            return {out: F.coalesce(gap, F.lit(0.0))}

        df = framed(df, [key], ["_t", *tiebreak], columns, lookback=1, limit=limit)
    return df.drop("_t")


def group_size(df: DataFrame, keys: Sequence[str], out: str, counted: str | None = None) -> DataFrame:
    """Number of rows (or non-null values) of the row's group.

    A map-side combined count joined back: unlike a window it never gathers a group,
    and AQE can split the row side of the join when a key is skewed.
    """
    what = F.count(F.lit(1)) if counted is None else F.count(counted)
    sizes = df.groupBy(*keys).agg(what.alias(out))
    return attach(df, sizes, keys, "left")


def group_sizes(df: DataFrame, sizes: dict[str, tuple[Names, str | None]], base: DataFrame | None = None) -> DataFrame:
    """``group_size`` for several key sets, as {out: (keys, counted)}, with one aggregation for all of them.

    Every row gives one (key set, key) per output, which are combined map-side and stored, a key set's table
    in a folder of its own; it is broadcast if it has few keys. ``base``, if given, has the same keys and
    counted columns and is cheaper to read.
    """
    base = df if base is None else base
    kinds = {f.name: f.dataType for f in base.schema.fields}
    used = list(dict.fromkeys(k for keys, _ in sizes.values() for k in keys))
    key = {k: F.col(k) if isinstance(kinds[k], PLAIN) else F.col(k).cast("string") for k in used}
    spots = []
    for i, (keys, counted) in enumerate(sizes.values()):
        one = F.lit(1) if counted is None else F.col(counted).isNotNull().cast("int")
        own = [F.when(F.lit(k in keys), key[k]).alias(f"_k{j}") for j, k in enumerate(used)]
        spots.append(F.struct(F.lit(i).alias("keyset"), *own, one.alias("_one")))
    by = ["keyset", *[f"_k{j}" for j in range(len(used))]]
    counts = base.select(F.inline(F.array(*spots))).groupBy(*by).agg(F.sum("_one").alias("_size"))
    path = scratch_path(df.sparkSession, "sizes")
    counts.write.partitionBy("keyset").parquet(path)
    shape = counts.drop("keyset").schema
    found = {r["keyset"]: r["count"] for r in df.sparkSession.read.schema(counts.schema).parquet(path).groupBy("keyset").count().collect()}
    for i, (out, (keys, _)) in enumerate(sizes.items()):
        if not found.get(i):
            df = df.withColumn(out, F.lit(None).cast("long"))
            continue
        spot = {k: f"_k{used.index(k)}" for k in keys}
        table = df.sparkSession.read.schema(shape).parquet(f"{path}/keyset={i}").select(*spot.values(), F.col("_size").alias("_found"))
        lone = None
        if len(keys) == 1:
            # one number for rows without the key: the rest is an equality, whose shuffle later steps can use
            first = table.where(F.col(spot[keys[0]]).isNull()).first()
            lone = F.when(key[keys[0]].isNull(), F.lit(first["_found"] if first else None).cast("long"))
            table = table.where(F.col(spot[keys[0]]).isNotNull())
            condition = key[keys[0]] == F.col(spot[keys[0]])
        else:
            condition = reduce(lambda a, b: a & b, [key[k].eqNullSafe(F.col(c)) for k, c in spot.items()])
        table = F.broadcast(table) if found[i] <= BROADCAST_ROWS else table
        size = F.col("_found") if lone is None else F.coalesce("_found", lone)
        df = df.join(table, condition, "left").withColumn(out, size).drop(*spot.values(), "_found")
    return df


def first_drop(df: DataFrame, keys: Sequence[str], order: str, value: str, share: float = 0.95) -> DataFrame:
    """Ratio of each period's value to the first period's, and the first period below ``share``.

    Aggregates of a per-period table, added back to it; no window.
    """
    keys = list(keys)
    df = settle(df)
    base = df.groupBy(*keys).agg(F.min_by(value, order).alias("base_value"))
    rated = attach(df, base, keys).withColumn("ratio", F.col(value) / F.nullif(F.col("base_value"), F.lit(0.0)))
    low = rated.groupBy(*keys).agg(F.min(F.when(F.col("ratio") < share, F.col(order))).alias("first_drop"))
    return attach(rated, low, keys)

