"""Account graph: codes, degrees, ports, neighbour aggregates, pattern similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions.dates import seconds
from txnrisk.functions.labels import same_value
from txnrisk.functions.numeric import gaussian_similarity, guarded_ratio, row_max, row_mean
from txnrisk.operators.aggregates import value_shares
from txnrisk.operators.ordering import BROADCAST_ROWS, FRAME_TASK_ROWS, WINDOW_ROWS, as_columns, global_rank, largest_groups, ranked, sized, spread
from txnrisk.operators.windows import group_sizes, short_run_features
from txnrisk.session import settle, stored


# Most pattern types, each of which is a column of its own.
PATTERN_TYPES = 1000
# Most values of a dictionary that become literals.
LITERAL_CODES = 200


def dictionary(df: DataFrame, column: str, order: Sequence, limit: int = WINDOW_ROWS) -> DataFrame:
    """(value, code): dense codes from 0 in the order in which values are first seen.

    First places are a combinable minimum; only the distinct values are ranked.
    """
    firsts = df.groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*as_columns(order))).alias("_first"))
    return ranked(firsts, [], ["_first"], "_rank", limit).select("value", (F.col("_rank") - 1).alias("code"))


def both_ends(df: DataFrame, first: Column, second: Column, order: Sequence) -> DataFrame:
    """(value, order..., _pos): the two columns of each row as two rows, in that order."""
    kept = [F.col(c) for c in order]
    pair = F.array(
        F.struct(F.lit(0).alias("_pos"), first.alias("value")), F.struct(F.lit(1).alias("_pos"), second.alias("value"))
    )
    return df.select(*kept, F.inline(pair))


def first_seen_codes(df: DataFrame, first: Column, second: Column, order: Sequence[str], limit: int = WINDOW_ROWS) -> DataFrame:
    """One dictionary for two columns, ``first`` before ``second`` within a row."""
    return dictionary(both_ends(df, first, second, order), "value", [*order, "_pos"], limit)


def account_key(bank: Column, account: Column, sep: str = "") -> Column:
    """Bank and account as one id. Without a separator 1|23 and 12|3 are the same id."""
    return F.concat(bank.cast("string"), F.lit(sep), account.cast("string"))


def edge_table(
    df: DataFrame,
    order: Sequence[str],
    amount_sent: str = "amount",
    amount_received: str = "amount",
    sent_currency: Column | None = None,
    received_currency: Column | None = None,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Edges with dense account, currency and format codes and relative seconds.

    ``order`` is the arrival order of the rows: it numbers the edges and the codes.
    """
    sent = sent_currency if sent_currency is not None else F.lit("Euro")
    received = received_currency if received_currency is not None else F.lit("Euro")
    # every column once; texts are made of them after the sort
    used = [*order, "from_bank", "source", "to_bank", "target", "timestamp", amount_sent, amount_received, "payment_format", "is_fraud"]
    at = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys(used))}
    narrow = df.select(*[F.col(c).alias(n) for c, n in at.items()], sent.cast("string").alias("_sent"), received.cast("string").alias("_received"))
    # numbered by sorted partitions, which are stored once; everything else reads them
    placed = global_rank(narrow, [at[c] for c in order], "edge_id", df.count())
    col = lambda c: F.col(at[c])
    rows = placed.select(
        account_key(col("from_bank"), col("source")).alias("_from"), account_key(col("to_bank"), col("target")).alias("_to"),
        col("timestamp").alias("_at"), col(amount_sent).alias("amount_sent"), "_sent", col(amount_received).alias("amount_received"),
        "_received", col("payment_format").cast("string").alias("_format"), col("is_fraud").alias("is_fraud"), "edge_id",
    )
    firsts = settle(_first_places(rows))
    start = rows.agg(F.min_by(seconds(F.date_trunc("day", F.col("_at").cast("timestamp"))), "edge_id")).scalar()
    # an unknown bank, account, currency or format has a code too
    accounts = ranked(firsts.where("kind = 'account'").select("value", "place"), [], ["place"], "_rank", limit)
    accounts = accounts.select(F.col("value").alias("_v"), (F.col("_rank") - 1).alias("_code"))
    few = firsts.where("kind = 'account'").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    codes = F.broadcast(accounts) if few else settle(accounts)
    # the few codes first: the joins then shuffle numbers instead of texts
    for kind, columns in (("currency", {"_sent": "sent_currency", "_received": "received_currency"}), ("format", {"_format": "payment_format"})):
        rows = _coded(rows, firsts.where(F.col("kind") == kind).select("value", "place"), columns, limit)
    for column, out in (("_from", "from_id"), ("_to", "to_id")):
        rows = rows.join(codes, F.col(column).eqNullSafe(F.col("_v"))).drop("_v", column).withColumnRenamed("_code", out)
    rows = rows.withColumn("seconds", seconds(F.col("_at")) - start + 10)
    return rows.select(
        "amount_sent", "amount_received", "is_fraud", "edge_id", "from_id", "to_id", "sent_currency", "received_currency", "payment_format", "seconds"
    )


def _first_places(rows: DataFrame) -> DataFrame:
    """(kind, value, place): the first place of each account, currency and format, in one aggregation.

    Within a row the sender comes before the receiver, but the received currency before the sent one.
    """
    spots = [("account", "_from", 0), ("account", "_to", 1), ("currency", "_received", 0), ("currency", "_sent", 1), ("format", "_format", 0)]
    each = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"), (F.col("edge_id") * 2 + i).alias("place")) for k, c, i in spots]
    return rows.select(F.inline(F.array(*each))).groupBy("kind", "value").agg(F.min("place").alias("place"))


def _coded(rows: DataFrame, firsts: DataFrame, columns: dict[str, str], limit: int) -> DataFrame:
    """Replace columns by their codes in the order of first places: literals if there are few values, else a join."""
    found = firsts.orderBy("place").limit(LITERAL_CODES + 1).collect()
    if len(found) <= LITERAL_CODES:
        known = [F.lit(x) for i, r in enumerate(found) if r["value"] is not None for x in (r["value"], i)]
        missing = next((i for i, r in enumerate(found) if r["value"] is None), None)
        for column, out in columns.items():
            code = F.try_element_at(F.create_map(*known), F.col(column)) if known else F.lit(None)
            rows = rows.withColumn(out, F.coalesce(code, F.lit(missing)).cast("long")).drop(column)
        return rows
    codes = sized(ranked(firsts, [], ["place"], "_rank", limit).select(F.col("value").alias("_v"), (F.col("_rank") - 1).alias("_code")))
    for column, out in columns.items():
        rows = rows.join(codes, F.col(column).eqNullSafe(F.col("_v"))).drop("_v", column).withColumnRenamed("_code", out)
    return rows


def network_counts(df: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Transactions of the row's sender, of its receiver, and of the pair."""
    return group_sizes(df, {"source_degree": ([src], None), "target_degree": ([dst], None), "pair_frequency": ([src, dst], None)})


def _degrees(edges: DataFrame, src: str, dst: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys..., node, in_degree, out_degree in one aggregation over both ends."""
    ends = edges.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(src).alias("node"), F.lit(0).alias("_in"), F.lit(1).alias("_out")),
                F.struct(F.col(dst).alias("node"), F.lit(1).alias("_in"), F.lit(0).alias("_out")),
            )
        ),
    )
    return ends.groupBy(*keys, "node").agg(F.sum("_in").alias("in_degree"), F.sum("_out").alias("out_degree"))


def degree_table(df: DataFrame, src: str = "source", dst: str = "target", distinct: bool = True) -> DataFrame:
    """Degrees and degree centralities of every account.

    ``distinct``: parallel edges count once and centrality divides by n - 1;
    otherwise every transfer counts and it divides by n. A self-loop counts twice.
    """
    edges = df.select(src, dst)
    if distinct:
        edges = edges.distinct()
    # one row per account, read again for the number of accounts
    nodes = settle(_degrees(edges, src, dst)).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    n = nodes.agg(F.count(F.lit(1))).scalar()
    divisor = (n - 1) if distinct else n

    def centrality(c: str) -> Column:
        return F.when(divisor < 1, F.lit(1.0)).otherwise(F.col(c) / F.nullif(divisor, F.lit(0)))

    return nodes.withColumns(
        {
            "degree_centrality": centrality("degree"),
            "in_degree_centrality": centrality("in_degree"),
            "out_degree_centrality": centrality("out_degree"),
        }
    )


def fan_degrees(df: DataFrame, src: str = "source", dst: str = "target", base: DataFrame | None = None) -> DataFrame:
    """Distinct receivers of the row's sender and distinct senders to its receiver.

    An unknown end is no counterparty, and its own degree is null; every row is kept. ``base``, if given,
    has the same ends and is cheaper to read.
    """
    pairs = stored((df if base is None else base).select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct())
    out = pairs.filter("_s IS NOT NULL").groupBy("_s").agg(F.count("_d").alias("fan_out_degree"))
    into = pairs.filter("_d IS NOT NULL").groupBy("_d").agg(F.count("_s").alias("fan_in_degree"))
    return df.join(out, F.col(src) == F.col("_s"), "left").join(into, F.col(dst) == F.col("_d"), "left").drop("_s", "_d")


def degree_ratio(df: DataFrame, src: str = "source", dst: str = "target", base: DataFrame | None = None) -> DataFrame:
    """Transfers of the sender over transfers to the receiver plus one."""
    # the sender last: what follows by sender needs no other shuffle
    df = group_sizes(df, {"account_in_degree": ([dst], src), "account_out_degree": ([src], dst)}, base)
    return df.withColumns(
        {
            "account_degree_centrality": F.col("account_out_degree"),
            "degree_ratio": guarded_ratio(F.col("account_out_degree"), F.col("account_in_degree"), 1.0),
        }
    )


def bank_concentration(
    df: DataFrame, from_bank: str = "from_bank", to_bank: str = "to_bank", rare: float = 0.01, base: DataFrame | None = None
) -> DataFrame:
    """Share of all rows per bank, rare-bank flags and the same-bank flag."""
    total = (df if base is None else base).agg(F.count(F.lit(1))).scalar()
    banks = {f"_n_{bank}": ([bank], bank) for bank in dict.fromkeys((from_bank, to_bank))}
    df = group_sizes(df, banks, base)
    for bank in (from_bank, to_bank):
        df = df.withColumn(f"{bank}_frequency", F.col(f"_n_{bank}") / total)
        df = df.withColumn(f"{bank}_is_rare", (F.col(f"{bank}_frequency") < rare).cast("int"))
    return df.withColumn("same_bank_transfer", same_value(F.col(from_bank), F.col(to_bank))).drop(*banks)


def amount_similarity(df: DataFrame, patterns: DataFrame, amount: str = "amount") -> DataFrame:
    """Gaussian closeness of the amount to each pattern type's typical amount.

    One column per type, so the types (a handful) are read to the driver as literals.
    """
    stats = patterns.groupBy("pattern_type").agg(F.round(F.avg(amount), 2).alias("m"), F.round(F.stddev_samp(amount), 2).alias("s"))
    out: dict[str, Column] = {}
    similar: dict[str, Column] = {}
    types = stats.limit(PATTERN_TYPES + 1).collect()
    if len(types) > PATTERN_TYPES:
        raise ValueError(f"more than {PATTERN_TYPES} pattern types can't be a column each")
    for r in sorted(types, key=lambda r: r["pattern_type"]):
        name = r["pattern_type"].lower()
        if r["s"] is not None and r["s"] > 0:
            z = (F.col(amount) - F.lit(r["m"])) / F.lit(r["s"])
            out[f"amount_zscore_{name}"] = z
            similar[f"amount_similarity_{name}"] = gaussian_similarity(z)
        else:
            similar[f"amount_similarity_{name}"] = (F.col(amount) == F.lit(r["m"])).cast("double")
    if not similar:
        return df
    df = df.withColumns(out | similar)
    cols = [F.col(c) for c in similar]
    return df.withColumns({"amount_pattern_similarity_max": row_max(cols), "amount_pattern_similarity_mean": row_mean(cols)})


def hour_similarity(
    df: DataFrame, patterns: DataFrame, ts: str = "timestamp", pattern_ts: str = "timestamp", base: DataFrame | None = None
) -> DataFrame:
    """Overlap of the two hour-of-day histograms, the same number on every row."""
    a = value_shares((df if base is None else base).select(F.hour(ts).alias("h")), "h").select("h", F.col("share").alias("_a"))
    b = value_shares(patterns.select(F.hour(pattern_ts).alias("_h")), "_h").select("_h", F.col("share").alias("_b"))
    overlap = a.join(b, F.col("h") == F.col("_h")).agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0.0)))
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "is_weekend": (F.weekday(ts) >= 5).cast("int"),
            "hour_pattern_similarity": overlap.scalar(),
        }
    )


def pattern_graph_metrics(patterns: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Nodes, distinct edges, density and degree centrality of each pattern type's graph."""
    edges = patterns.select("pattern_type", src, dst).distinct()
    nodes = _degrees(edges, src, dst, ["pattern_type"]).withColumn("_deg", F.col("in_degree") + F.col("out_degree"))
    per = nodes.groupBy("pattern_type").agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.sum("out_degree").alias("num_edges"),
        F.sum("_deg").alias("_sum"),
        F.max("_deg").alias("_max"),
    )
    n = F.col("num_nodes").cast("double")
    pairs = F.nullif(n * (n - 1), F.lit(0.0))
    return per.select(
        "pattern_type",
        "num_nodes",
        "num_edges",
        F.when(n > 1, F.col("_sum") / pairs).otherwise(1.0).alias("avg_degree"),
        F.when(n > 1, F.col("_max") / F.nullif(n - 1, F.lit(0.0))).otherwise(1.0).alias("max_degree"),
        F.when(n > 1, F.col("num_edges") / pairs).otherwise(0.0).alias("network_density"),
    )


def pattern_features(df: DataFrame, patterns: DataFrame, order: Sequence[str], limit: int = WINDOW_ROWS) -> DataFrame:
    """All pattern features in sequence.

    The rows are stored once. What a step counts it counts on them, not on the steps before; steps by
    sender follow each other.
    """
    base = stored(df)
    return (
        base.transform(amount_similarity, patterns)
        .transform(hour_similarity, patterns, base=base)
        .transform(bank_concentration, base=base)
        .transform(degree_ratio, base=base)
        .transform(short_run_features, "source", order, limit=limit, base=base)
        .transform(fan_degrees, base=base)
    )


def ports(
    df: DataFrame, src: str = "source", dst: str = "target", ts: str = "timestamp", tiebreak: Sequence[str] = (),
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Order of first appearance of the sender at the receiver, and the reverse.

    If no account has more than ``limit`` rows, each is numbered where one shuffle per end puts its rows.
    """
    sizes = largest_groups(df, [[src], [dst], []])
    if max(sizes) and max(sizes[:2]) <= limit:
        first = F.min(F.struct(F.col(ts), *as_columns(tiebreak))).over(Window.partitionBy(src, dst))
        for end, other, port in ((dst, src, "in_port"), (src, dst, "out_port")):
            own = Window.partitionBy(end).orderBy("_first", other)
            dealt = spread(df, [end], sizes[2]) if sizes[2] > FRAME_TASK_ROWS else df.repartition(end)
            df = dealt.withColumn("_first", first)
            df = df.withColumn(port, (F.dense_rank().over(own) - 1).cast("long")).drop("_first")
        return df
    pairs = df.groupBy(F.col(src).alias("_s"), F.col(dst).alias("_d")).agg(
        F.min(F.struct(F.col(ts), *as_columns(tiebreak))).alias("_first")
    )
    pairs = ranked(pairs, ["_d"], ["_first", "_s"], "in_port", limit)
    pairs = ranked(pairs, ["_s"], ["_first", "_d"], "out_port", limit)
    numbered = pairs.select("_s", "_d", *[(F.col(p) - 1).alias(p) for p in ("in_port", "out_port")])
    return df.join(numbered, F.col(src).eqNullSafe(F.col("_s")) & F.col(dst).eqNullSafe(F.col("_d"))).drop("_s", "_d")


def with_reverse(
    edges: DataFrame, src: str, dst: str, edge_id: str | None = None, in_port: str | None = None, out_port: str | None = None, count: int | None = None
) -> DataFrame:
    """Each edge in both directions; ports swap, reverse ids continue after the forward ones.

    ``count``, if known, is the number of edges.
    """
    flip: dict[str, Column] = {src: F.col(dst), dst: F.col(src), "direction": F.lit("rev_to")}
    if in_port and out_port:
        flip |= {in_port: F.col(out_port), out_port: F.col(in_port)}
    if edge_id:
        flip[edge_id] = F.col(edge_id) + (edges.agg(F.count(F.lit(1))).scalar() if count is None else F.lit(count).cast("long"))
    forward = F.struct(*[F.col(c) for c in edges.columns], F.lit("to").alias("direction"))
    backward = F.struct(*[flip.get(c, F.col(c)).alias(c) for c in edges.columns], flip["direction"].alias("direction"))
    return edges.select(F.inline(F.array(forward, backward)))


def ego_flags(nodes: DataFrame, node: str, seeds: DataFrame, src: str, dst: str) -> DataFrame:
    """1 for accounts on either end of a seed edge."""
    ends = seeds.select(F.col(src).alias("_e")).union(seeds.select(dst)).distinct().withColumn("_is", F.lit(1))
    joined = nodes.join(ends, F.col(node) == F.col("_e"), "left")
    return joined.withColumn("ego", F.coalesce("_is", F.lit(0))).drop("_e", "_is")


def neighbour_stats(edges: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """Per receiver: size, mean, min, max and deviation of an edge attribute, plus degree scalers."""
    stats = edges.groupBy(F.col(dst).alias("node")).agg(
        F.count(F.lit(1)).alias("degree"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"),
    )
    log_degree = F.log(F.col("degree") + 1)
    average = stats.agg(F.avg(F.log(F.col("degree") + 1))).scalar()
    return stats.withColumns({"amplification": log_degree / average, "attenuation": average / log_degree})


def neighbour_mean(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str, value: str) -> DataFrame:
    """Mean of a sender attribute over incoming edges: one hop; repeat for more hops."""
    attrs = nodes.select(F.col(node).alias("_n"), F.col(value).alias("_v"))
    return edges.join(attrs, F.col(src) == F.col("_n")).groupBy(F.col(dst).alias(node)).agg(F.avg("_v").alias(value))


def degree_histogram(edges: DataFrame, dst: str) -> DataFrame:
    return edges.groupBy(dst).agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))

