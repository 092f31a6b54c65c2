"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each virtual node has a place among 64-bit hashes and owns the arc up to it. A key goes clockwise to the
first virtual node whose shard still has room. The driver sees counts only: the keys per cell, a cell
being the part of an arc in one of equal ranges of hashes. Cells keep the ranking of keys inside them
small; how many there are changes no key's shard, as cells are gone through in the order of hashes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
VNODES = 64
#: Keys per range of hashes that are aimed at; a larger table has more ranges.
PER_SLOT = 100_000
#: Repeats of one row that are written by one step of an explode.
CHUNK = 10_000


def vnodes(shards: int, per_shard: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise. A node depends on its shard's number alone."""
    return sorted((int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big"), shard) for shard in range(shards) for v in range(per_shard))


def place(counts: Iterable[tuple[int, int, int]], capacity: list[int], per_shard: int = VNODES) -> list[tuple[int, int, int, int, int, int]]:
    """(range, arc, from rank, to rank, shard, first slot of the shard) for all keys, cell by cell.

    ``counts`` are (range, arc, keys); arc ``a`` belongs to node ``a``, the one after the last to the first.
    Keys that overflow a full shard continue clockwise. capacity must hold all keys.
    """
    ring = vnodes(len(capacity), per_shard)
    room, used = list(capacity), [0] * len(capacity)
    # the next virtual node with room, by halving paths over full ones
    ahead = list(range(len(ring)))

    def free(i: int) -> int:
        path = []
        for _ in range(len(ring) + 1):
            i %= len(ring)
            if room[ring[i][1]]:
                break
            path.append(i)
            i = ahead[i] if ahead[i] != i else i + 1
        for p in path:
            ahead[p] = i
        return i

    out = []
    for cell, arc, left in sorted(counts):
        done, at = 0, arc
        while left:
            at = free(at)
            shard = ring[at][1]
            take = min(left, room[shard])
            out.append((cell, arc, done, done + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            done, left = done + take, left - take
    return out


def even(rows: int, shards: int) -> list[int]:
    """Capacities that hold exactly ``rows`` keys and differ by one at most."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _range(ranges: int) -> Column:
    return F.shiftrightunsigned("ring_hash", 64 - (ranges - 1).bit_length()).cast("int")


def _with_arcs(rows: DataFrame, shards: int, per_shard: int) -> DataFrame:
    """Adds ring_arc: how many nodes stand before the row's hash, all 64 bits compared."""
    places = [p for p, _ in vnodes(shards, per_shard)]
    edges = [bisect.bisect_left(places, k << 52) for k in range(SLOTS + 1)]
    # unsigned places as signed numbers of the same order
    table = [(k, edges[k], [p - (1 << 63) for p in places[edges[k] : edges[k + 1]]]) for k in range(SLOTS)]
    near = rows.sparkSession.createDataFrame(table, "ring_near int, ring_before int, ring_inside array<long>")
    turned = F.col("ring_hash").bitwiseXOR(F.lit(-(1 << 63)))
    joined = rows.join(F.broadcast(near), F.shiftrightunsigned("ring_hash", 52).cast("int") == F.col("ring_near"))
    arc = F.col("ring_before") + F.size(F.filter("ring_inside", lambda p: p < turned))
    return joined.withColumn("ring_arc", arc).drop("ring_near", "ring_before", "ring_inside")


def _per_cell(rows: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in rows.groupBy(_range(ranges), "ring_arc").count().collect()]


def ring_shards(df: DataFrame, key: list[Column], shards: int = 16, slack: float = 0.0, per_shard: int = VNODES) -> DataFrame:
    """Columns of ``df`` with shard and slot (gapless from 0 in each shard).

    ``df`` must hold only what the result needs: equal rows are counted together and written out
    again, so repeated rows, ties and null keys cost nothing more, whatever share of the table
    they make up. slack 0 gives shards whose counts differ by one at most; slack 0.1 lets a shard
    hold 10 % more than the mean, and then fewer keys move when keys or shards are added. An empty
    table gives an empty result. Columns named like the result's are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    names = df.columns
    rows = _with_arcs(df.withColumn("ring_hash", F.xxhash64(*key)), shards, per_shard)
    ranges = SLOTS
    counts = _per_cell(rows, ranges)
    total = sum(n for _, _, n in counts)
    while total / ranges > PER_SLOT:
        ranges *= 2
    if ranges > SLOTS:
        counts = _per_cell(rows, ranges)
    rows = rows.withColumn("ring_range", _range(ranges))
    capacity = even(total, shards) if not slack else [int(total / shards * (1 + slack)) + 1] * shards
    runs = place(counts, capacity, per_shard)
    plan = spark.createDataFrame(runs, "ring_range int, ring_arc int, run_from long, run_to long, shard int, run_first long")
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("ring_times"))
    order = Window.partitionBy("ring_range", "ring_arc").orderBy("ring_hash", *(F.col(f"`{n}`") for n in names))
    same = same.withColumn("ring_rank", F.sum("ring_times").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ring_times"))
    many = same.withColumn("ring_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("ring_times") / CHUNK) - 1)))
    within = F.least(F.lit(CHUNK) - 1, F.col("ring_times") - F.col("ring_part") * CHUNK - 1)
    each = many.withColumn("ring_one", F.explode(F.sequence(F.lit(0), within.cast("int"))))
    rank = F.col("ring_rank") + F.col("ring_part") * CHUNK + F.col("ring_one")
    each = each.withColumn("ring_rank", rank)
    # at most one run per cell and shard change: a few thousand rows, as there are cells
    joined = each.join(F.broadcast(plan), ["ring_range", "ring_arc"]).where("ring_rank >= run_from and ring_rank < run_to")
    return joined.select(*(F.col(f"`{n}`") for n in names), "shard", (F.col("run_first") + F.col("ring_rank") - F.col("run_from")).alias("slot"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, slack: float = 0.0) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of all documents under the law of rows.

    The ring's key is the id with the text's size and checksum, so that documents without an id, or
    with one that many share, spread over the ring. A null text has size 1 and checksum 0.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = ring_shards(rows, [F.col(c) for c in rows.columns], shards, slack)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
