"""Near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are collapsed first. Then independent trees branch
the sets: at each level of a tree a set follows the branch of its minwise token there, so two sets
of similarity s stay together with probability s per level. Small nodes are compared exhaustively;
larger ones branch again. Nodes that stay large on the last level hold sets that hardly differ:
their members are compared with pivots and in small random blocks, and members that are then not in
the main component are compared with all members, block by block. All candidate links are confirmed on
the full shingle sets, and confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import components, compact, in_batches, small, stored, stored_in_batches
from txnrisk.llm.words import Words, mix, pieces, run_hash

TREES = 10
LEVELS = 4
#: Nodes with at most this many sets are compared exhaustively.
LEAF = 16
#: Documents to which the members of a large node are compared, per tree.
PIVOTS = 2
#: Sets that are compared with as many others in one step, where a large node needs it.
BLOCK = 128
#: Links that one task confirms on full sets.
LINKS_PER_TASK = 4_000
#: Blocks of a large group that one task compares with a block of left-over members.
BLOCKS_PER_TASK = 16
#: A link is a candidate if the agreement of the two sketches is at most this much below the threshold.
SLACK = 0.25
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(1, 2**63, TREES * LEVELS, dtype=np.uint64) | np.uint64(1)
_SECOND = np.uint64(int(_RNG.integers(1, 2**63)))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text of fewer words has its whole word sequence as the only one; without words it has none.
    """
    words = Words(texts)
    hashes, _, owner = words.windows(width)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, count in enumerate(words.counts.tolist()):
        if count >= width:
            yield np.unique(hashes[cut[i] : cut[i + 1]])
        elif count:
            yield run_hash(words.hash, words.first[i : i + 1], count)
        else:
            yield np.zeros(0, np.uint64)


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two fingerprints of the sets; equal sets have equal ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    prints = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        prints[0, full] = np.add.reduceat(mix(every), begin)
        prints[1, full] = np.add.reduceat(mix(every ^ _SECOND), begin)
    return sizes, prints[0].view(np.int64), prints[1].view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, batch.column(1)):
            sets = list(shingle_sets(texts, width))
            sizes, fp1, fp2 = _prints(sets)
            full = np.flatnonzero(sizes)
            sketch = np.zeros((len(sets), len(_FACTORS)), np.int32)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, factor in enumerate(_FACTORS):
                    turned = ((every * factor) >> np.uint64(32)).astype(np.uint32)
                    sketch[full, k] = np.minimum.reduceat(turned, begin).view(np.int32)
            flat = pa.array(sketch.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * len(_FACTORS)), flat)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(fp1), pa.array(fp2), lists],
                names=["doc", "n", "fp1", "fp2", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, batch.column(1)):
            sets = list(shingle_sets(texts, width))
            places = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            sizes, fp1, fp2 = _prints(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes), pa.array(fp1), pa.array(fp2), pa.ListArray.from_arrays(pa.array(places), pa.array(flat))], names=["n", "fp1", "fp2", "tokens"]
            )


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_FACTORS))


def _close(sizes: np.ndarray, sketch: np.ndarray, size: np.ndarray, one: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Agreement of the sketches with ``one``, and whether a link is possible."""
    agree = (sketch == one).mean(1)
    low, high = np.minimum(sizes, size), np.maximum(sizes, size)
    return agree, (agree >= percent / 100 - SLACK) & (100 * low >= percent * high)


def _leaves(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate links of each small node. Links of a spanning tree come with tree = true."""
    for batch in batches:
        members = batch.column(0)
        ids, sizes, sketches = (members.flatten().field(k) for k in range(3))
        ids, sizes, sketches = ids.to_numpy(), sizes.to_numpy(), _matrix(sketches)
        places = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
        out: list[tuple[int, int, bool]] = []
        for a, b in zip(places[:-1], places[1:], strict=True):
            order = a + np.argsort(ids[a:b])
            reached = np.zeros(len(order), bool)
            for i in range(len(order) - 1):
                rest = order[i + 1 :]
                _, fits = _close(sizes[rest], sketches[rest], sizes[order[i]], sketches[order[i]], percent)
                for j in np.flatnonzero(fits).tolist():
                    out.append((int(ids[order[i]]), int(ids[rest[j]]), not reached[i + 1 + j]))
                    reached[i + 1 + j] = True
        a, b, tree = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(tree, pa.bool_())], names=["a", "b", "tree"])


def _against(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate links of each row's set to the listed ones: id, n, sketch, others."""
    for batch in batches:
        ids, sizes, sketch, others = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)), batch.column(3)
        flat = others.flatten()
        ids2, sizes2, sketch2 = flat.field(0).to_numpy(), flat.field(1).to_numpy(), _matrix(flat.field(2))
        places = np.concatenate([[0], np.cumsum(others.value_lengths().to_numpy())])
        a, b = [], []
        for i in range(len(ids)):
            part = slice(places[i], places[i + 1])
            _, fits = _close(sizes2[part], sketch2[part], sizes[i], sketch[i], percent)
            found = ids2[part][fits & (ids2[part] != ids[i])]
            a.append(np.minimum(found, ids[i]))
            b.append(np.maximum(found, ids[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), bool))], names=["a", "b", "tree"])


_LINKS = "a long, b long, tree boolean"


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right"))
    return joined.select("a", "b", shared.alias("i"), (F.size("left") + F.size("right") - shared).alias("u")).where(f"100 * i >= {percent} * u").select("a", "b")


def _nodes(reps: DataFrame, trees: int, sets: int) -> tuple[DataFrame, DataFrame]:
    """(leaf members, members of nodes still large on the last level): node, id and size of node."""
    keys = []
    for t in range(trees):
        path = [F.xxhash64(F.lit(t), F.col("sketch")[t * LEVELS])]
        for level in range(1, LEVELS):
            path.append(F.xxhash64(path[-1], F.col("sketch")[t * LEVELS + level]))
        keys.append(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(path))))
    rows = stored(reps.select("id", F.explode(F.array(*keys)).alias("k")).select("id", "k.*"), "paths", rows=trees * sets)
    leaves = []
    for level in range(LEVELS):
        key = f"k{level}"
        counts = rows.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
        rows = rows.join(counts, key)
        leaves.append(rows.where(f"members <= {LEAF}").select(F.col(key).alias("node"), "id", "members"))
        rows = rows.where(f"members > {LEAF}")
        if level < LEVELS - 1:
            rows = stored(rows.drop("members"), "paths", rows=trees * sets)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out, rows.select(F.col(f"k{LEVELS - 1}").alias("node"), "id", "members")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, trees: int = TREES) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if 100 * shared >= percent * union of their distinct ``width``-word
    shingles; component_id is the smallest id reachable over links. Rows without words (null or
    empty text too) are linked with nothing. Rows with a null id take part, and so does each text
    of an id that has several; a component that has only null ids has a null component_id. Repeated
    rows are links like other equal texts, and rows that repeat the component's id are all kept.
    Other columns are ignored; an empty table gives an empty one.

    A link is missed only if the sketches (40 minwise tokens) differ by far more than the sets do,
    or if no tree keeps the two together: at the threshold below 1 in 1,000 where nodes get small
    early, and about 0.5 % for a pair that stays in large nodes to the last level.
    """
    source = in_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    seen = stored(source.mapInArrow(partial(_describe, width=width), "doc long, n long, fp1 long, fp2 long, sketch array<int>"), "sets")
    total = seen.count()
    # a distinct set is a node; its number only has to be its own
    reps = seen.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch"))
    reps = stored(compact(reps, total).withColumn("id", F.monotonically_increasing_id()), "representatives")
    known = reps.select("id", "n", "sketch")
    nodes = known.count()
    leaves, heavy = _nodes(known, trees, nodes)
    heavy = stored(heavy.join(known, "id").select("node", "id", "members", "n", "sketch"), "large", rows=trees * nodes)
    blocks = heavy.select(F.xxhash64("node", F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("members") / LEAF))).alias("node"), "id", "n", "sketch")
    one = F.struct("id", "n", "sketch").alias("one")
    leaf_rows = leaves.select("node", "id").join(known, "id").select("node", "id", "n", "sketch")
    links = _grouped(leaf_rows.union(blocks), one, percent)
    pivots = heavy.groupBy("node").agg(F.array(*(F.min_by(F.struct("id", "n", "sketch"), F.xxhash64("id", "node", F.lit(p))) for p in range(PIVOTS))).alias("others"))
    links = links.union(heavy.join(pivots, "node").select("id", "n", "sketch", "others").mapInArrow(partial(_against, percent=percent), _LINKS))
    links = stored(links.groupBy("a", "b").agg(F.max("tree").alias("tree")), "links", rows=trees * nodes)
    sets = stored(_tokens(source, reps, links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width), "tokens")
    found = links.groupBy("tree").count().collect()
    trees_links, other_links = (sum(r["count"] for r in found if r["tree"] == t) for t in (True, False))
    edges = stored(_confirmed(links.where("tree"), sets, percent), "edges", trees_links, LINKS_PER_TASK)
    parts = stored(components(edges), "parts", rows=nodes)
    more = _across(links.where("not tree"), parts)
    edges = edges.union(stored(_confirmed(more, sets, percent), "edges", other_links, LINKS_PER_TASK))
    parts = stored(components(edges), "parts", rows=nodes)
    groups = _groups(heavy, parts, nodes)
    if groups.where("left_over").limit(1).count():
        own = stored(_tokens(source, reps, groups.select("id"), width).join(groups, "id"), "group-tokens")
        edges = edges.union(_late_links(own, percent))
        parts = stored(components(edges), "parts", rows=nodes)
    # the smallest document of a component stands for it
    named = reps.select("fp1", "fp2", "n", "doc", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    least = named.groupBy("part").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "part").select("fp1", "fp2", "n", "component_id")
    found = seen.select("doc", "n", "fp1", "fp2").join(named, ["fp1", "fp2", "n"], "left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return found.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.col("doc").eqNullSafe(whole).alias("kept"))


def _tokens(source: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, tokens) of the wanted representatives, from the texts of the documents that stand for them."""
    asked = reps.select("id", "doc", "fp1", "fp2", "n").join(small(wanted), "id", "left_semi")
    docs = small(asked.select(F.col("doc").alias("wanted")).distinct())
    texts = source.join(docs, F.col("doc").eqNullSafe(F.col("wanted")), "left_semi")
    found = texts.mapInArrow(partial(_sets, width=width), "n long, fp1 long, fp2 long, tokens array<long>")
    named = found.join(asked.select("id", "fp1", "fp2", "n"), ["fp1", "fp2", "n"]).select("id", "tokens")
    # rows without an id, and equal rows, give a set more than once
    return named.groupBy("id").agg(F.first("tokens").alias("tokens")) if _repeats(source) else named


def _grouped(rows: DataFrame, one, percent: int) -> DataFrame:
    """Compare the members of each node; a node has about LEAF members."""
    members = rows.groupBy("node").agg(F.collect_list(one).alias("members")).where("size(members) > 1")
    return members.select("members").mapInArrow(partial(_leaves, percent=percent), _LINKS)


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    for end in ("a", "b"):
        named = parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
        pairs = pairs.join(named, end, "left").withColumn(f"{end}_part", F.coalesce(f"{end}_part", end))
    return pairs.where("a_part != b_part").select("a", "b")


def _groups(heavy: DataFrame, parts: DataFrame, nodes: int) -> DataFrame:
    """(id, group, component, left_over, members, rest) of the members of large nodes.

    Large nodes that share members are one group, so that no two members are compared twice;
    left_over are those outside the group's largest component; members and rest count both.
    """
    least = heavy.groupBy("node").agg(F.min("id").alias("least"))
    ties = stored(heavy.select("node", "id").join(least, "node").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct(), "ties", rows=nodes)
    joined = components(ties).select(F.col("node").alias("id"), F.col("component").alias("group"))
    named = ties.select(F.col("a").alias("id")).distinct().join(joined, "id", "left").withColumn("group", F.coalesce("group", "id"))
    named = stored(named.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "members", rows=nodes)
    sizes = named.groupBy("group", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("group").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("members")).where("most < members")
    left_over = (F.col("component") != F.col("main")).alias("left_over")
    return stored(named.join(main, "group").select("id", "group", "component", left_over, "members", (F.col("members") - F.col("most")).alias("rest")), "groups", rows=nodes)


def _late_links(own: DataFrame, percent: int) -> DataFrame:
    """Links of left-over members to all members of their group, block by block.

    own: the groups with tokens. Of the links of a member to one component one is given.
    """
    one = F.collect_list(F.struct("id", "component", "tokens"))

    def packed(df: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK))
        return df.groupBy("group", block.alias(name)).agg(one.alias(f"{name}_sets"))

    # a group's blocks are dealt over tasks; its left-over blocks go to each of these tasks
    late = packed(own.where("left_over"), "rest", "late")
    every = packed(own, "members", "all").withColumn("share", F.floor(F.col("all") / BLOCKS_PER_TASK))
    shares = own.groupBy("group").agg(F.max(F.floor((F.ceil(F.col("members") / BLOCK) - 1) / BLOCKS_PER_TASK)).alias("last"))
    late = late.join(shares, "group").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))))
    pairs = late.join(every, ["group", "share"])
    found = pairs.select("late_sets", "all_sets").mapInArrow(partial(_compared, percent=percent), "a long, b long")
    return stored_in_batches(found.distinct(), "late", 4)


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each set of the first list to those of the second in other components."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for row in range(batch.num_rows):
            (ids, parts, tokens), (ids2, parts2, tokens2) = ([v.field(k) for k in range(3)] for v in (batch.column(c)[row].values for c in (0, 1)))
            sizes2 = tokens2.value_lengths().to_numpy()
            flat, of = tokens2.flatten().to_numpy(), np.repeat(np.arange(len(ids2)), sizes2)
            parts2, ids2 = parts2.to_numpy(), ids2.to_numpy()
            for k in range(len(ids)):
                mine = np.sort(tokens[k].values.to_numpy())
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                shared = np.bincount(of[mine[at] == flat], minlength=len(ids2))
                linked = np.flatnonzero((100 * shared >= percent * (len(mine) + sizes2 - shared)) & (parts2 != parts[k].as_py()))
                for j in linked[np.unique(parts2[linked], return_index=True)[1]].tolist():
                    x, y = int(ids[k].as_py()), int(ids2[j])
                    out.append((min(x, y), max(x, y)))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _repeats(source: DataFrame) -> bool:
    """Whether an id is missing or occurs more than once."""
    return source.groupBy("doc").agg(F.count("*").alias("c")).where("doc is null or c > 1").limit(1).count() > 0
