"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback tokenises every text. Characters per token, the share of
byte-fallback tokens and the entropy of the text's tokens are compared with bands per language and
script, which are taken from all texts that pass the base rules.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches, small, stored
from txnrisk.llm.words import SPACED, Words, mix, pieces, spans_hash

VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
MIN_WORDS = 50
#: A text is rejected only if a figure lies so many times the distance of the quartiles outside them.
REACH = 3.0
#: With fewer distinct texts than this a language and script has its language's band, and a language the band of all.
LEAST_TEXTS, LEAST_LANG = 100, 20
METRICS = ("chars_per_token", "byte_share", "entropy")
#: Least distance of the quartiles that is reckoned with, by metric: figures that hardly vary get no zero-width band.
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.01, "entropy": 0.05}

# Lead bytes of UTF-8 by script.
_SCRIPTS = {"latin": [(0xC3, 0xCA)], "greek": [(0xCD, 0xCF)], "cyrillic": [(0xD0, 0xD4)], "hebrew": [(0xD6, 0xD7)], "arabic": [(0xD8, 0xDB)], "indic": [(0xE0, 0xE0)], "cjk": [(0xE3, 0xE9)], "hangul": [(0xEA, 0xED)]}
_NAMES = ["none", *_SCRIPTS, "other"]
_SCRIPT_OF = np.zeros(256, np.int64)
_SCRIPT_OF[0xC0:] = len(_NAMES) - 1
for _k, _ranges in enumerate(_SCRIPTS.values(), 1):
    for _a, _b in _ranges:
        _SCRIPT_OF[_a : _b + 1] = _k
_SCRIPT_OF[65:91] = _SCRIPT_OF[97:123] = 1

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

_MODELS: dict[str, tuple] = {}


def _model(path: str):
    """The tokenizer, and which of its tokens are bytes; once per worker."""
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = (model, np.array([model.is_byte(i) for i in range(model.get_piece_size())]))
    return _MODELS[path]


class _Tokens:
    """Token ids of words. Words seen before come from a table, which starts anew when it is full."""

    MOST = 200_000

    def __init__(self, path: str):
        self.model, self.is_byte = _model(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths, self.ids, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its tokens, and the ids of all tokens in order."""
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.MOST:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            data = words.data.tobytes()
            fresh = [data[words.start[i] : words.end[i]].decode("utf-8", "replace") for i in first[new].tolist()]
            coded = self.model.encode(fresh, num_threads=1)
            lengths = np.array([len(c) for c in coded], np.int64)
            flat = np.concatenate([np.array(c, np.int32) for c in coded])
            rows = len(self.lengths) + np.arange(len(fresh))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.ids = np.concatenate([self.ids, flat])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, rows])[order]
            at = np.searchsorted(self.keys, distinct)
        row = self.rows[at][back]
        lengths = self.lengths[row]
        total = int(lengths.sum())
        place = np.repeat(self.starts[row] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        return lengths, self.ids[place]


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _repeated(words: Words, width: int = 3) -> np.ndarray:
    """Words of each text that lie in a ``width``-word window found twice or more in it."""
    n = len(words.at) - 1
    hashes, where, owner = words.windows(width)
    if not len(where):
        return np.zeros(n, np.int64)
    _, back, times = np.unique(hashes ^ mix(owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    marks = np.zeros(len(words.hash) + 1, np.int64)
    again = where[times[back] > 1]
    np.add.at(marks, again, 1)
    np.add.at(marks, again + width, -1)
    return np.bincount(words.owner[np.cumsum(marks)[:-1] > 0], minlength=n)


def _repeated_lines(words: Words) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    n = len(words.at) - 1
    data, at = words.data, words.at
    if not len(words.start):
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    owner = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.concatenate([begin[1:], [len(data)]]), at[owner + 1])
    stop = stop - (data[stop - 1] == 10)
    has = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop, owner = begin[has], stop[has], owner[has]
    # bytes outside the kept lines hash as nothing: breaks, lines without a word, the next text's first lines
    marks = np.zeros(len(data) + 1, np.int8)
    marks[begin] += 1
    marks[stop] -= 1
    hashes = spans_hash(data, begin, stop, np.cumsum(marks[:-1]) > 0)
    _, one = np.unique(hashes ^ mix(owner.astype(np.uint64)), return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[one], minlength=n)


def _measured(batches: Iterator[pa.RecordBatch], text_at: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    tokens = _Tokens(vocabulary)
    for batch in batches:
        for part, texts in pieces(batch, pc.struct_field(batch.column(0), [text_at])):
            words = Words(texts, SPACED, lower=False)
            n, owner = len(texts), words.owner
            counts = words.counts
            lead = np.cumsum(np.concatenate([[0], words.inside & ((words.data & 0xC0) != 0x80)]))
            marks = np.cumsum(np.concatenate([[0], _SYMBOLS[words.data]]))
            chars = lead[words.at[1:]] - lead[words.at[:-1]]
            lengths, ids = tokens.of(words)
            of = np.repeat(owner, lengths)
            total = np.bincount(of, minlength=n)
            byte = np.bincount(of[tokens.is_byte[ids]], minlength=n)
            pair, times = np.unique(of * np.int64(1 << 20) + ids, return_counts=True)
            mine = pair >> 20
            with np.errstate(divide="ignore", invalid="ignore"):
                entropy = np.log2(total) - _per_text(times * np.log2(times), mine, n) / total
                figures = [np.where(total > 0, x, 0.0) for x in (chars / total, byte / total, entropy)]
            position = np.searchsorted(words.at, np.flatnonzero(_SCRIPT_OF[words.data]), "right") - 1
            script = np.bincount(position * len(_NAMES) + _SCRIPT_OF[words.data][_SCRIPT_OF[words.data] > 0], minlength=n * len(_NAMES)).reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array(x.astype(np.int64)) for x in (counts, chars, marks[words.at[1:]] - marks[words.at[:-1]], _repeated_lines(words), _repeated(words))),
                    *(pa.array(np.asarray(x, np.float64)) for x in figures),
                    pa.array([_NAMES[k] for k in script.argmax(1)], pa.string()),
                ],
                names=["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *METRICS, "script"],
            )


def measures(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Each row as the struct ``row``, with its counts, fertility figures and main script."""
    kind = docs.schema.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"row {kind}, {counts}, {', '.join(f'{m} double' for m in METRICS)}, script string"
    rows = in_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(partial(_measured, text_at=docs.columns.index(text_col), vocabulary=vocabulary), schema)


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, reach: float = REACH) -> DataFrame:
    """``measures`` with base_failed, the band's group (lang, script) and kept.

    kept is false for rows that fail the base rules (fewer than 50 words, or more than half of the
    words in repeated 3-word windows) and for rows with a figure outside its band. A null language
    is a group of its own; a null or empty text has no words and fails the base rules; repeated
    rows get equal verdicts; extra columns pass through inside ``row``. The bands come from all
    distinct texts that pass the base rules; a small group is judged by its language's band or the
    band of all texts. An empty table gives an empty result.
    """
    seen = stored(measures(docs, text_col, vocabulary), "measured")
    lang = F.coalesce(F.col(f"row.`{lang_col}`").cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    seen = seen.withColumns({"lang": lang, "base_failed": base_failed()})
    # exact quantiles of figures rounded to thousandths: the same bands in any partitioning, from a few thousand counts
    figures = [F.round(m, 3).alias(m) for m in METRICS]
    # copies of a text count once
    once = seen.where("not base_failed").select("lang", "script", F.xxhash64(F.col(f"row.`{text_col}`")).alias("text"), *figures).distinct()
    long = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    counts = stored(once.select("lang", "script", F.inline(long)).groupBy("lang", "script", "metric", "value").agg(F.count("*").alias("texts")), "figures")

    def fences(keys: list[str], least: int) -> DataFrame:
        points = [F.percentile(F.when(F.col("metric") == m, F.col("value")), [0.25, 0.75], F.col("texts")).alias(m) for m in METRICS]
        own = F.sum(F.when(F.col("metric") == METRICS[0], F.col("texts"))).alias("texts")
        edges = []
        for m in METRICS:
            low, high = (F.col(m)[k] for k in range(2))
            spread = F.greatest(high - low, F.lit(LEAST_SPREAD[m]))
            edges += [(low - reach * spread).alias(f"{m}_low"), (high + reach * spread).alias(f"{m}_high")]
        return counts.groupBy(*keys).agg(own, *points).where(F.col("texts") >= least).select(*keys, F.struct(*edges).alias("_".join(["by", *keys])))

    groups = counts.select("lang", "script").distinct().join(fences(["lang", "script"], LEAST_TEXTS), ["lang", "script"], "left")
    groups = groups.join(fences(["lang"], LEAST_LANG), "lang", "left").join(F.broadcast(fences([], 1)), F.lit(True), "left")
    bands = small(groups.select("lang", "script", F.coalesce("by_lang_script", "by_lang", "by").alias("band")).select("lang", "script", "band.*"))
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.coalesce(F.col(m).between(F.col(f"{m}_low") - 1e-9, F.col(f"{m}_high") + 1e-9), F.lit(True))
    return seen.join(bands, ["lang", "script"], "left").withColumn("kept", ~F.col("base_failed") & inside)
