"""Benchmark decontamination by a prefix-filtered set join of item windows with documents.

Each window of an item is a set of word shingles. A document holds the window only if it holds all
of them, so one shingle of each window, the rarest over all documents, is a sufficient prefix.
Documents are searched for prefix shingles; a hit at word p of a shingle that stands at offset k of
its window can only be the window at p - k (positional bound), which must lie inside the text
(length bound); the window's words are then compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches, stored
from txnrisk.llm.words import LETTERS, Words, pieces, run_hash

WINDOW = 13
SHINGLE = 4
#: Distinct windows that are sent to the executors at once; more are searched in further blocks.
BLOCK = 200_000


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """item, words (hashes of each window's words) of all items."""
    for batch in batches:
        items, lists = [], []
        words = Words(batch.column(1), LETTERS)
        for i, count in enumerate(words.counts.tolist()):
            own = words.hash[words.first[i] : words.first[i] + count].view(np.int64)
            for k in range(max(1, count - window + 1) if count else 0):
                items.append(i)
                lists.append(own[k : k + window].tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(items, pa.int64())), pa.array(lists, pa.list_(pa.int64()))], names=["item", "words"])


class Index:
    """Windows by their prefix shingle. windows: list of word hash arrays; prefixes: (hash, width, offset)."""

    def __init__(self, windows: list[np.ndarray], hashes: np.ndarray, offsets: np.ndarray):
        self.size = np.array([len(w) for w in windows])
        width = int(self.size.max()) if len(windows) else 0
        self.words = np.zeros((len(windows), width), np.uint64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = w
        self.width = np.minimum(self.size, SHINGLE)
        order = np.lexsort((hashes, self.width))
        self.by_width = {}
        for w in np.unique(self.width).tolist():
            own = order[self.width[order] == w]
            self.by_width[w] = (hashes[own], own)
        self.offsets = offsets

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of all occurrences of windows in the texts."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        owner = words.owner
        for width, (hashes, own) in self.by_width.items():
            seen, where, _ = words.windows(width)
            low, high = np.searchsorted(hashes, seen, "left"), np.searchsorted(hashes, seen, "right")
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            entry = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            window = own[entry]
            start = np.repeat(where[hit], times) - self.offsets[window]
            text = np.repeat(owner[where[hit]], times)
            fits = (start >= words.first[text]) & (start + self.size[window] <= words.first[text + 1])
            start, window = start[fits], window[fits]
            same = np.ones(len(start), bool)
            for j in range(self.words.shape[1]):
                within = self.size[window] > j
                at = np.minimum(start + j, len(words.hash) - 1)
                same &= ~within | (words.hash[at] == self.words[window, j])
            starts.append(start[same])
            found.append(window[same])
        return np.concatenate(starts), np.concatenate(found)


def _counted(batches: Iterator[pa.RecordBatch], wanted: dict) -> Iterator[pa.RecordBatch]:
    """Occurrences in the documents of each wanted shingle, summed over a task."""
    widths = {w: np.sort(np.array(h, np.int64).view(np.uint64)) for w, h in wanted.value.items()}
    totals = {w: np.zeros(len(h), np.int64) for w, h in widths.items()}
    for batch in batches:
        for _, texts in pieces(batch, batch.column(0)):
            words = Words(texts, LETTERS)
            for w, hashes in widths.items():
                seen, _, _ = words.windows(w)
                at = np.minimum(np.searchsorted(hashes, seen), len(hashes) - 1)
                totals[w] += np.bincount(at[hashes[at] == seen], minlength=len(hashes))
    for w, hashes in widths.items():
        some = totals[w] > 0
        yield pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(totals[w][some])], names=["shingle", "seen"])


def _searched(batches: Iterator[pa.RecordBatch], index, first: bool) -> Iterator[pa.RecordBatch]:
    """Add the found items and hit words of one block of windows to each row: row, places, items."""
    if index is not None:
        index, owners = index.value
    for batch in batches:
        text = pc.struct_field(batch.column(0), [1])
        for part, texts in pieces(batch, text):
            words = Words(texts, LETTERS)
            n = len(texts)
            if index is None:
                start = window = np.zeros(0, np.int64)
            else:
                start, window = index.search(words)
            text_of = np.searchsorted(words.first, start, "right") - 1 if len(start) else start
            # of equal entries of ``first`` (texts without words) the search gives the last, which owns the word
            places: list[list[int]] = [[] for _ in range(n)] if first else part.column(2).to_pylist()
            items: list[list] = [[] for _ in range(n)] if first else part.column(3).to_pylist()
            for i in np.unique(text_of).tolist():
                mine = text_of == i
                hit = np.zeros(int(words.counts[i]) + 1, np.int64)
                at = start[mine] - words.first[i]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + index.size[window[mine]], -1)
                places[i] = sorted({*places[i], *np.flatnonzero(np.cumsum(hit)[:-1]).tolist()})
                items[i] = sorted({*items[i], *(x for w in np.unique(window[mine]).tolist() for x in owners[w])})
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts.astype(np.int64)), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["row", "n_words", "places", "items"],
            )


def _blocks(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, window: int, block: int) -> Iterator[tuple[bool, Broadcast]]:
    """Broadcast indexes over all distinct windows, about ``block`` windows each, made one after the other:
    (whether it is the last, index)."""
    spark = bench.sparkSession
    texts = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    windows = texts.mapInArrow(partial(_item_windows, window=window), "item string, words array<long>")
    windows = windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = stored(windows.withColumn("block", F.xxhash64("words")), "windows")
    count = max(1, -(-windows.count() // block))
    for b in range(count):
        rows = windows.where(F.pmod(F.col("block"), F.lit(count)) == b).select("words", "items").toArrow()
        lists = [np.array(w, np.int64).view(np.uint64) for w in rows.column(0).to_pylist()]
        parts = [run_hash(w, np.arange(max(1, len(w) - SHINGLE + 1)), min(len(w), SHINGLE)) for w in lists]
        wanted: dict[int, set] = {}
        for w, p in zip(lists, parts, strict=True):
            wanted.setdefault(min(len(w), SHINGLE), set()).update(p.view(np.int64).tolist())
        sent = spark.sparkContext.broadcast({w: sorted(h) for w, h in wanted.items()})
        counted = docs.select("text").mapInArrow(partial(_counted, wanted=sent), "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen")).toArrow()
        sent.unpersist()
        seen = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True))
        # the rarest shingle of each window; ties go to the first
        best = [min(range(len(p)), key=lambda k, p=p: (seen.get(int(p[k : k + 1].view(np.int64)[0]), 0), k)) for p in parts]
        hashes = np.array([p[k] for p, k in zip(parts, best, strict=True)], np.uint64)
        yield b == count - 1, spark.sparkContext.broadcast((Index(lists, hashes, np.array(best, np.int64)), rows.column(1).to_pylist()))


def contamination(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, block: int = BLOCK
) -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256, contaminated): row is the document's row as a struct.

    A document word inside any occurrence of a window of ``window`` consecutive item words is hit;
    items of fewer words are one window. contaminated: n_hit > 0 and share * n_hit >= n_words. A
    null or empty text has no words and is clean; items without words, text or id have no windows;
    equal items and repeated rows count each; an empty benchmark hits nothing. Words are compared
    by 64-bit hashes. The windows are sent to the executors in blocks of about ``block`` distinct
    ones. Only one block is on the driver and the executors at a time: what earlier ones have found
    is written with the rows before the next is made.
    """
    own = in_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["all"].dataType.simpleString()
    kind = f"row struct<all:{kind},text:string>, n_words bigint, places array<int>, items array<string>"
    rows = own.select(F.struct("all", "text").alias("row"))
    for k, (last, index) in enumerate(_blocks(own, bench, item_col, item_text_col, window, block)):
        rows = rows.mapInArrow(partial(_searched, index=index, first=k == 0), kind)
        if not last:
            rows = in_batches(stored(rows, "searched"))
            index.destroy()
    hit, n = F.size("places").cast("long"), F.col("n_words")
    return rows.select(
        F.col("row.all").alias("row"),
        n,
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= n)).alias("contaminated"),
    )
