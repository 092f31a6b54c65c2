"""Quality classifier: naive Bayes support vectors.

Texts become sets of hashed n-grams (words, word pairs, byte triples). Each n-gram indicator is
scaled by its class log-count ratio over all training texts; a linear hinge-loss model over these
is fitted by dual coordinate descent; a logistic curve over held-back margins gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches, small, stored
from txnrisk.llm.words import SPACED, Words, mix, pieces

BITS = 17
#: The model is fitted on at most so many training texts (those with the smallest hashes); the class counts use all.
FIT_ROWS = 12_000
#: Hashes above this share of the fit rows only place the logistic curve.
CALIBRATION = 0.2
EPOCHS = 10
COST = 1.0
SMOOTHING = 1.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of the texts end to end, and the offsets of each text."""
    words = Words(texts, SPACED, lower=False)
    n = len(texts)
    owner = words.owner
    single = mix(words.hash)
    pair, first, of = words.windows(2)
    pair = np.where(words.hash[first] == words.hash[first + 1], np.uint64(1), pair)
    parts = [(single, owner), (pair, of)]
    data, at = words.data, words.at
    if len(data) > 2:
        triple = data[:-2].astype(np.uint64) << np.uint64(16) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:]
        text = np.repeat(np.arange(n), np.diff(at))
        inside = text[:-2] == text[2:]
        parts.append((mix(triple[inside] + np.uint64(1 << 40)), text[:-2][inside]))
    keys = np.concatenate([(o.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for h, o in parts])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(n + 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a feature, summed over a task."""
    totals = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        done = 0
        for _, texts in pieces(batch, batch.column(0)):
            found, at = features(texts)
            of = np.repeat(labels[done : done + len(texts)], np.diff(at))
            for c in (0, 1):
                totals[c] += np.bincount(found[of == c], minlength=1 << BITS)
            done += len(texts)
    some = np.flatnonzero(totals.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[0][some]), pa.array(totals[1][some])], names=["feature", "n0", "n1"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, batch.column(0)):
            found, at = features(texts)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found))], names=["label", "dice", "features"])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over scaled, unit-length rows, by dual coordinate descent."""
    signs = np.where(labels == 1, 1.0, -1.0)
    weights, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    n1 = max(1, int((labels == 1).sum()))
    bound = np.where(labels == 1, cost * len(rows) / (2 * n1), cost * len(rows) / (2 * max(1, len(rows) - n1)))
    values = [scaled(r, ratio) for r in rows]
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)).tolist():
            x, y = values[i], signs[i]
            gradient = y * (weights[rows[i]] @ x + bias) - 1.0
            old = alpha[i]
            # the length of a row is 1, and 1 more for the bias
            new = min(max(old - gradient / (x @ x + 1.0), 0.0), bound[i])
            if new != old:
                weights[rows[i]] += (new - old) * y * x
                bias += (new - old) * y
                alpha[i] = new
                most = max(most, abs(new - old))
        if most < 1e-4:
            break
    return weights, bias


def scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[row]
    return x / max(np.sqrt(x @ x), 1e-12)


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve 1 / (1 + exp(-(slope * margin + offset))), by Newton steps."""
    slope, offset = 1.0, 0.0
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    if not n1 or not n0:
        return slope, offset
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((goal - p) * margins).sum() - 1e-3 * slope, (goal - p).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 1e-3), float(offset)


def fit(counts: pa.Table, sample: pa.Table, seen: tuple[int, int]) -> dict:
    """The model of class counts over all training texts and a bounded sample of them."""
    both = np.full((2, 1 << BITS), SMOOTHING)
    at = counts.column("feature").to_numpy()
    for c in (0, 1):
        both[c][at] += counts.column(f"n{c}").to_numpy()
    ratio = np.log(both[1] / (seen[1] + 2 * SMOOTHING)) - np.log(both[0] / (seen[0] + 2 * SMOOTHING))
    order = np.argsort(sample.column("dice").to_numpy(), kind="stable")
    labels = sample.column("label").to_numpy()[order]
    lists = sample.column("features").combine_chunks()
    flat, places = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    rows = [flat[places[i] : places[i + 1]] for i in order.tolist()]
    # where every CALIBRATION-th row is held back, the order being by hash
    back = np.arange(len(rows)) % round(1 / CALIBRATION) == 0
    kept = [r for r, b in zip(rows, back, strict=True) if not b]
    weights, bias = descend(kept, labels[~back], ratio)
    margins = np.array([weights[r] @ scaled(r, ratio) + bias for r, b in zip(rows, back, strict=True) if b])
    slope, offset = logistic(margins, labels[back])
    return {"weights": weights * ratio, "square": ratio**2, "bias": bias, "slope": slope, "offset": offset}


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        for part, texts in pieces(batch, batch.column(1)):
            found, at = features(texts)
            # sums of weights and of squared lengths per text, by differences of running sums
            margin = _sums(m["weights"][found], at) / np.maximum(np.sqrt(_sums(m["square"][found], at)), 1e-12) + m["bias"]
            score = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["id", "score"])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out


def _fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of ``docs``.

    Labels count only for ids whose crc32 as text mod 4 is not 2, and only 0 and 1; an id with
    both is label 0. The score is a function of the text alone. A null or empty text has no
    features and gets the score of the bias. Null ids are not held out and never trained on.
    Without labels of both classes all scores are 0.5. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = in_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("label_of"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and label_of is not null")
    marked = marked.where(_fold(F.col("label_of")) != 2).groupBy("label_of").agg(F.min("label").alias("label"))
    marked = stored(marked, "labels")
    train = rows.join(small(marked), F.col("id") == F.col("label_of")).select("text", "label", F.xxhash64("id", F.lit(3)).alias("dice"))
    seen = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    model = {"weights": np.zeros(1 << BITS), "square": np.zeros(1 << BITS), "bias": 0.0, "slope": 1.0, "offset": 0.0}
    if len(seen) == 2:
        counts = train.select("text", "label").mapInArrow(_counted, "feature int, n0 long, n1 long")
        counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        total = sum(seen.values())
        # the share of hashes that gives about fit_rows; the exact bound is the limit
        cut = 2.0 * min(1.0, 1.2 * fit_rows / total) - 1.0
        chosen = train.where(F.col("dice") <= F.lit(int(cut * (2**63 - 1)))).orderBy("dice").limit(fit_rows) if total > fit_rows else train
        sample = chosen.mapInArrow(_sampled, "label int, dice long, features array<int>").toArrow()
        model = fit(counts, sample, (seen[0], seen[1]))
    sent = spark.sparkContext.broadcast(model)
    scored = rows.select("id", "text").mapInArrow(partial(_scored, model=sent), "id long, score double")
    held = F.col("id").isNotNull() & (_fold(F.col("id")) == 2)
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
