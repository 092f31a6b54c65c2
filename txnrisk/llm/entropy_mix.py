"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet each source's token target and stay at 2 or less, entropy
balancing takes the one closest to rate 1: rate = min(2, exp(tilt * size)), with one tilt per
source. The convex dual is solved by Newton iterations, each one aggregation over all sources'
size counts. Rates are then rounded into copies by a hash of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnrisk.llm.common import small, stored
from txnrisk.session import settle

CYCLE = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
TOLERANCE = 1e-9
#: Bins per pass and passes of the search for a source's rounding threshold.
BINS, PASSES = 256, 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float = BUDGET, most: float = MOST, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``cycle`` gives the weights in
    code point order of the sources, null last; no target exceeds ``most`` times its source's
    size, and what is over is shared again by weight until none is above.

    The sources are ordered by one running number over all of them: one narrow row per source.
    """
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("place") % len(cycle) + 1).cast("int"))
    rows = settle(ordered.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")))
    total = budget * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        taken, open_weight = rows.agg(
            F.coalesce(F.sum(F.when(F.col("full"), most * F.col("source_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)),
        ).first()
        each = (total - taken) / open_weight if open_weight else 0.0
        goal = F.when(F.col("full"), most * F.col("source_size")).otherwise(F.col("weight") * each)
        over = ~F.col("full") & (goal > most * F.col("source_size"))
        if not open_weight or not rows.where(over).limit(1).count():
            return rows.select("source", "source_size", goal.alias("target"))
        rows = settle(rows.withColumn("full", F.col("full") | over))


def tilts(counts: DataFrame, goals: DataFrame, most: float = MOST, rounds: int = 60) -> DataFrame:
    """(source, tilt, scale, all_of) that solve the dual; counts: source, size, docs.

    Each iteration takes a Newton step on the logarithm of the source's tokens and halves the
    bracket instead if the step leaves it. Sources whose target is all they may give (or nothing)
    need no tilt: all_of is then their rate.
    """
    sums = counts.where("size > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("tokens"), F.sum("docs").alias("docs"), F.min("size").alias("least"))
    state = goals.join(sums, goals["source"].eqNullSafe(sums["source"]), "left").select(goals["source"], "target", "tokens", "docs", "least")
    share = F.col("target") / F.col("tokens")
    all_of = F.when(F.col("tokens").isNull(), 1.0).when(share >= most * (1 - 1e-12), most).when(share <= 0, 0.0)
    scale = F.col("tokens") / F.col("docs")
    unit = scale / F.col("least")
    state = state.select(
        "source", "target", all_of.alias("all_of"), scale.alias("scale"), F.lit(0.0).alias("tilt"), F.when(share > 1, 0.0).otherwise(F.log(share) * unit).alias("low"), F.when(share > 1, F.log(F.lit(most)) * unit).otherwise(0.0).alias("high"), F.lit(1.0).alias("miss")
    )
    state = settle(state)
    own = counts.where("size > 0").withColumnRenamed("source", "of")
    for _ in range(rounds):
        going = state.where(f"all_of is null and miss > {TOLERANCE}")
        if not going.limit(1).count():
            break
        z = F.col("size") / F.col("scale")
        rate = F.least(F.lit(most), F.exp(F.least(F.lit(700.0), F.col("tilt") * z)))
        mass = F.col("docs") * F.col("size") * rate
        rows = own.join(small(going), F.col("of").eqNullSafe(F.col("source")))
        now = rows.groupBy("source").agg(F.sum(mass).alias("got"), F.sum(F.when(rate < most, mass * z).otherwise(0.0)).alias("slope"))
        now = now.withColumnRenamed("source", "of")
        both = state.join(small(now), state["source"].eqNullSafe(F.col("of")), "left")
        high = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        low = F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        step = F.col("tilt") + F.log(F.try_divide("target", "got")) * F.try_divide("got", "slope")
        to = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        miss = F.abs(F.col("got") / F.col("target") - 1)
        moved = F.col("got").isNotNull()
        state = settle(
            both.select(
                "source", "target", "all_of", "scale",
                F.when(moved & (miss > TOLERANCE), to).otherwise(F.col("tilt")).alias("tilt"),
                F.when(moved, low).otherwise(F.col("low")).alias("low"),
                F.when(moved, high).otherwise(F.col("high")).alias("high"),
                F.coalesce(miss, F.col("miss")).alias("miss"),
            )
        )
    return state.select("source", "tilt", "scale", "all_of")


def _thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(of, cut): with the rows of smaller ``lag`` rounded up, each source's tokens are nearest its target.

    rows: source, size, low (rate rounded down), lag in [-1, 1). Each pass bins the lags of all
    rows, finds the bin in which the target falls and looks closer into that one.
    """
    base = rows.groupBy("source").agg(F.sum(F.col("low") * F.col("size")).alias("sure"))
    state = goals.join(base, goals["source"].eqNullSafe(base["source"])).select(
        goals["source"].alias("of"), (F.col("target") - F.col("sure")).alias("need"), F.lit(-1.0).alias("start"), F.lit(2.0).alias("width")
    )
    state = settle(state)
    for k in range(PASSES):
        step = F.col("width") / BINS
        found = rows.where("low < 2").join(small(state), F.col("source").eqNullSafe(F.col("of"))).where("lag >= start and lag < start + width")
        bins = found.groupBy("of", F.floor((F.col("lag") - F.col("start")) / step).alias("bin")).agg(F.sum("size").alias("tokens"))
        order = Window.partitionBy("of").orderBy("bin")
        run = bins.withColumn("upto", F.sum("tokens").over(order)).withColumn("before", F.col("upto") - F.col("tokens")).withColumnRenamed("of", "bin_of")
        met = run.join(small(state), F.col("bin_of").eqNullSafe(F.col("of"))).where("upto >= need or need is null")
        first = met.groupBy("of").agg(F.min("bin").alias("bin"), F.min_by("before", "bin").alias("before"), F.min_by("upto", "bin").alias("upto")).withColumnRenamed("of", "first_of")
        both = state.join(small(first), state["of"].eqNullSafe(F.col("first_of")), "left")
        start = F.col("start") + F.coalesce(F.col("bin"), F.lit(BINS)) * step
        if k == PASSES - 1:
            # the bin in which the target falls is taken if that ends nearer to it
            extra = F.when((F.col("upto") - F.col("need")) < (F.col("need") - F.col("before")), step).otherwise(0.0)
            return settle(both.select("of", (start + F.coalesce(extra, F.lit(0.0))).alias("cut")))
        state = settle(both.select("of", (F.col("need") - F.coalesce(F.col("before"), F.lit(0))).alias("need"), start.alias("start"), step.alias("width")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, size, source_size, target, copies): row is the document's row as a struct.

    copies is 0, 1 or 2. A null source is a source of its own, last in order; a null text, or one
    without words, has size 0 and is kept once. The rounding hash takes the id and the text, so
    reruns agree and equal rows get equal copies. An empty table gives an empty result.
    """

    def col(c: str) -> Column:
        return F.col(f"`{c}`")

    rows = docs.select(
        F.struct(*(col(c) for c in docs.columns)).alias("row"),
        col(source_col).cast("string").alias("source"),
        words_in(col(text_col)).alias("size"),
        F.xxhash64(col(id_col), col(text_col)).alias("dice"),
    )
    narrow = stored(rows.select("source", "size", "dice"), "sizes")
    counts = stored(narrow.groupBy("source", "size").agg(F.count("*").alias("docs")), "size-counts")
    goals = stored(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))), "targets")
    solved = stored(tilts(counts, goals), "tilts").withColumnRenamed("source", "solved_of")

    def rated(of: DataFrame) -> DataFrame:
        joined = of.join(small(solved), F.col("source").eqNullSafe(F.col("solved_of")))
        rate = F.coalesce("all_of", F.least(F.lit(MOST), F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale")))))
        low = F.floor(rate).cast("int")
        lag = F.shiftrightunsigned("dice", 11) / float(1 << 53) - (rate - low)
        return joined.withColumns({"low": low, "lag": lag}).drop("solved_of", "tilt", "scale", "all_of")

    cuts = _thresholds(rated(narrow.where("size > 0")), goals)
    whole = rated(rows).join(small(cuts), F.col("source").eqNullSafe(F.col("of")), "left")
    goal = goals.withColumnRenamed("source", "goal_of")
    whole = whole.join(small(goal), F.col("source").eqNullSafe(F.col("goal_of")))
    up = ((F.col("low") < 2) & (F.col("lag") < F.col("cut"))).cast("int")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("low") + F.coalesce(up, F.lit(0)))
    return whole.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))
