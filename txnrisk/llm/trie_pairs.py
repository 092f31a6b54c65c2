"""Spelling variants by a dictionary of trie-node pairs.

All words are paths in a trie, and backwards in a second one, whose nodes are numbered. A word without
its letter at one place is the pair (node of what stands before, node of what stands after), and so is
a word cut at one place. Two words with the same pair around a left-out letter differ in that letter;
a word whose pair around a left-out letter is another's pair at a cut is that one with a letter more.
So equal pairs of integers are exactly the near words, however long the words are, and a pair's group
has at most one word per letter of the alphabet and one that is cut there.

The numbering is distributed: words are sorted over all tasks, a node belongs to the first word that
passes it, and paths that cross the border of two tasks are settled from the last word of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import stored

#: Runs that may be words, and the bounds of the dictionary.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Letters of words whose pairs are made at once.
CELLS = 1 << 18
#: One in so many runs loses a letter.
EVERY = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, of which one in ``every`` has lost a letter.

    The unsigned crc32 of ``<id>:<run>`` decides which runs lose a letter and which letter; a null id
    decides for none. Words have ``shortest`` letters and ``least`` occurrences in all texts, at least.
    """
    # a longer run has no match that begins inside it, so matches are whole runs
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(0))
    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _common(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the beginning that each string shares with the one before it; the first shares nothing."""
    sizes = np.diff(at)
    shared = np.zeros(len(sizes), np.int64)
    live, depth = np.arange(1, len(sizes)), 0
    while len(live):
        live = live[(sizes[live] > depth) & (sizes[live - 1] > depth)]
        live = live[data[at[live] + depth] == data[at[live - 1] + depth]]
        depth += 1
        shared[live] = depth
    return shared


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the numbers of each string's nodes as if the task's strings were all, and the length of the
    beginning shared with the task's first string. The strings, in the first column, come sorted."""
    last, nodes, shared_first, offset = None, np.zeros(0, np.int64), 0, 0
    for batch in batches:
        if not len(batch):
            continue
        texts = batch.column(0).to_pylist()
        own = texts if last is None else [last, *texts]
        skip = len(own) - len(texts)
        at = np.concatenate([[0], np.cumsum([len(t) for t in own])])
        data = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        common, sizes = _common(data, at), np.diff(at)
        if not skip:
            shared_first = int(sizes[0])
        first = np.minimum.accumulate(np.concatenate([[shared_first], common[1:]]))
        # a string's own numbers: its offset plus the depth, one more than its letters in all
        start = np.concatenate([[0], np.cumsum(sizes[skip:] + 1)])[:-1] + offset
        offset += int((sizes[skip:] + 1).sum())
        places = np.concatenate([[0], np.cumsum(sizes + 1)])
        cells = np.arange(places[-1]) - np.repeat(places[:-1], sizes + 1)
        out = cells + np.repeat(np.concatenate([np.zeros(skip, np.int64), start]), sizes + 1)
        if skip:
            out[: places[1]] = nodes
        for depth in range(int(common.max()) + 1):
            rows = np.flatnonzero(sizes >= depth)
            fresh = (common[rows] < depth) if depth else np.zeros(len(rows), bool)
            fresh[0] = True
            source = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
            out[places[rows] + depth] = out[places[source] + depth]
        last, nodes, shared_first = own[-1], out[places[-2] :].copy(), int(first[-1])
        lists = pa.ListArray.from_arrays(pa.array(places[skip:] - places[skip], pa.int32()), pa.array(out[places[skip] :]))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(first[skip:])], names=[*batch.schema.names, "nodes", "shared"])


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def with_nodes(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the trie's node numbers on the path of ``text``, one per length of its beginning from 0 on.

    Equal beginnings have equal numbers and others have not, over all rows. The last number of a path
    grows with the text, by code points. The driver holds one text and path per task.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != text]
    ordered = rows.select(text, *others).repartitionByRange(text).sortWithinPartitions(text).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
    placed = stored(ordered.mapInArrow(_paths, f"{schema}, nodes array<long>, shared long"), "paths")
    ends = placed.groupBy("part").agg(
        F.min(text).alias("first"), F.max_by(F.struct(text, "nodes", "shared"), text).alias("last"), F.sum(F.length(text) + 1).alias("size")
    )
    base, before, borders = 0, None, []
    for e in sorted(ends.collect(), key=lambda r: r["part"]):
        known = before[1][: _shared(before[0], e["first"]) + 1] if before else []
        borders.append((e["part"], base, known))
        final = [x + base for x in e["last"]["nodes"]]
        across = min(e["last"]["shared"] + 1, len(known))
        before = (e["last"][text], known[:across] + final[across:])
        base += e["size"]
    table = spark.createDataFrame(borders, "part int, base long, known array<long>")
    across = F.least(F.col("shared") + 1, F.size("known")).cast("int")
    own = F.transform(F.slice("nodes", across + 1, F.size("nodes")), lambda x: x + F.col("base"))
    return placed.join(F.broadcast(table), "part").select(text, *others, F.concat(F.slice("known", F.lit(1), across), own).alias(out))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each word (word, n, p, s); about ``CELLS`` letters at once, of one word all."""
    for batch in batches:
        sizes = np.diff(_flat(batch.column(2))[1])
        cuts, held = [0], 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > CELLS:
                cuts.append(k)
                held = 0
            held += size
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            if b > a:
                yield from _pairs_of(batch.slice(a, b - a))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), at - at[0]


def _pairs_of(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    (p, at), (s, _) = _flat(part.column(2)), _flat(part.column(3))
    sizes = np.diff(at)
    letters = np.frombuffer("".join(part.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(at[-1]) - at[owner]
    back = at[owner] + sizes[owner] - 1 - depth
    n, ends = part.column(1).to_numpy(), p[at[1:] - 1]
    # a path has one node more than the word has letters
    around = np.flatnonzero(depth < sizes[owner] - 1)
    first = np.ones(len(letters), bool)
    first[1:] = letters[1:] != letters[:-1]
    first[depth[around] == 0] = True
    for where, behind, kind in ((np.arange(at[-1]), back, np.zeros(at[-1], np.int8)), (around, back - 1, 1 + first.astype(np.int8))):
        own = owner[where]
        yield pa.RecordBatch.from_pydict({"p": p[where], "s": s[behind[where]], "n": n[own], "word_id": ends[own], "kind": kind})


def _pairs(tries: DataFrame) -> DataFrame:
    """(p, s, n, word_id, kind): kind 0 at a cut, 1 around a letter, 2 around the first of a run of equal letters."""
    return tries.select("word", "n", "p", "s").mapInArrow(_exploded, "p long, s long, n long, word_id long, kind byte")


def _best(*parts: Column) -> Column:
    return F.array_min(F.concat(*parts))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(word_id, n_near, best): near words in number, and the one that occurs most as (-n, word_id)."""
    member = F.struct((-F.col("n")).alias("m"), "word_id", "kind")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)
    groups = groups.select(F.sort_array("all").alias("all")).select(
        F.filter("all", lambda x: x["kind"] > 0).alias("around"),
        F.filter("all", lambda x: x["kind"] == 2).alias("longer"),
        F.filter("all", lambda x: x["kind"] == 0).alias("cut"),
    )
    key = lambda x: F.struct(x["m"].alias("m"), x["word_id"].alias("word_id"))

    def of_letter(x: Column) -> Column:
        # sorted: the best other one is the first or, for the first itself, the second
        other = F.when(F.get("around", F.lit(0))["word_id"] == x["word_id"], F.slice("around", 2, 1)).otherwise(F.slice("around", 1, 1))
        shorter = F.when(x["kind"] == 2, F.col("cut")).otherwise(F.slice("cut", 1, 0))
        return F.struct(
            x["word_id"].alias("word_id"),
            (F.size("around") - 1 + F.size(shorter)).alias("near"),
            _best(F.transform(other, key), F.transform(shorter, key)).alias("best"),
        )

    def of_cut(x: Column) -> Column:
        return F.struct(x["word_id"].alias("word_id"), F.size("longer").alias("near"), _best(F.transform(F.slice("longer", 1, 1), key)).alias("best"))

    found = groups.select(F.inline(F.concat(F.transform("around", of_letter), F.transform("cut", of_cut)))).where("near > 0")
    return found.groupBy("word_id").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word_id, root_id): where the chain of forms ends. n grows ``TIMES`` fold a step, so chains are short; rounds double them."""
    found = stored(forms.select("word_id", F.col("form_id").alias("root_id")), "roots")
    while True:
        step = found.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next"))
        moved = found.join(step, "root_id", "left")
        if not moved.where("next IS NOT NULL").limit(1).count():
            return found
        found = stored(moved.select("word_id", F.coalesce("next", "root_id").alias("root_id")), "roots")


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    Words are near if one inserted, deleted or replaced code point makes one the other. A word's form is
    its near word of the largest n (of equal ones the smallest by code points) if that n is at least
    ``times`` its own, else null; its root is where its chain of forms ends, itself without a form.
    ``n_near`` counts all near words. Empty and null words are left out; words may be of any length.
    """
    counts = counts.where("word <> ''").select("word", F.col("n").cast("long").alias("n"))
    tries = with_nodes(counts, "word", "p")
    tries = with_nodes(tries.withColumn("back", F.reverse("word")), "back", "s").drop("back")
    tries = stored(tries, "tries")
    near = neighbours(_pairs(tries))
    rows = tries.select("word", "n", F.element_at("p", -1).alias("word_id"))
    joined = rows.join(near, "word_id", "left").withColumn("form_n", -F.col("best.m"))
    is_form = F.col("form_n") >= times * F.col("n")
    rows = stored(
        joined.select(
            "word", "n", "word_id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.word_id")).alias("form_id"), F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "near",
    )
    names = rows.select("word_id", "word")
    roots = _roots(rows.where("form_id IS NOT NULL"))
    ends = roots.join(names.withColumnsRenamed({"word_id": "root_id", "word": "root"}), "root_id").drop("root_id")
    varied = rows.where("form_id IS NOT NULL").join(names.withColumnsRenamed({"word_id": "form_id", "word": "form"}), "form_id").join(ends, "word_id")
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    plain = rows.where("form_id IS NULL").withColumns({"form": F.lit(None).cast("string"), "root": F.col("word")})
    return plain.select(*columns).unionByName(varied.select(*columns))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the ``words`` of all texts.

    Null and empty texts have no words; a null id deletes no letters; repeated rows count each time;
    texts and words of any length are taken whole; other columns are ignored; an empty table, or one
    without words, gives an empty one.
    """
    return variants(stored(words(docs, id_col, text_col), "words"))
