"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Spark tasks add up exact sums and then products of centred entries; what reaches the driver is one
matrix of the dimension per group of tasks. Of its pivoted factor L, with P'VP = LL', rotations of
pairs of columns make all columns orthogonal; their squared norms are then the eigenvalues of V and
the normalised columns, with the pivoting undone, its eigenvectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import stored

SCALE, SHIFT = 1024, 100_000
#: Vectors that a task works on at once.
ROWS = 4096
#: Largest product of two longs that is computed in longs; beyond it Python integers take over.
_SAFE = 2**62


class Whitening(NamedTuple):
    """``rows`` vectors with the exact ``sums`` per dimension; components by falling eigenvalue, one a row."""

    rows: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def _finite(vector: str) -> Column:
    c = F.col(vector)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row per task: its rows and the exact sum of each dimension, as text since sums may pass a long."""
    rows, total, most = 0, [0] * width, 0
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            x = _matrix(batch.column(0).slice(k, ROWS), width)
            rows += len(x)
            top = int(max(-int(x.min()), int(x.max())))
            most = max(most, top)
            own = (x if top * len(x) < _SAFE else x.astype(object)).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, own, strict=True)]
    if rows:
        yield pa.RecordBatch.from_pydict({"rows": [rows], "sums": [[str(t) for t in total]], "most": [str(most)]})


def _merged_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows, total, most = 0, [0] * width, 0
    for batch in batches:
        for row in batch.to_pylist():
            rows += row["rows"]
            total = [a + int(b) for a, b in zip(total, row["sums"], strict=True)]
            most = max(most, int(row["most"]))
    if rows:
        yield pa.RecordBatch.from_pydict({"rows": [rows], "sums": [[str(t) for t in total]], "most": [str(most)]})


def _numerators(x: np.ndarray, rows: int, sums: list[int], most: int) -> np.ndarray:
    """rows * x - sums, exact: longs where they are sure to fit."""
    if rows * (2 * most + 1) < _SAFE:
        return rows * x - np.array(sums, np.int64)
    return rows * x.astype(object) - np.array(sums, object)


def _scatter(batches: Iterator[pa.RecordBatch], rows: int, sums: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """The task's products of centred entries, one row per dimension."""
    width, total = len(sums), None
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            x = (_numerators(_matrix(batch.column(0).slice(k, ROWS), width), rows, sums, most) / rows).astype(np.float64)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": list(range(width)), "row": list(total)}, schema=pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))]))


def _merged_scatter(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width))
    seen = False
    for batch in batches:
        seen = seen or len(batch) > 0
        np.add.at(total, batch.column(0).to_numpy(), _matrix(batch.column(1), width))
    if seen:
        yield pa.RecordBatch.from_pydict({"i": list(range(width)), "row": list(total)}, schema=pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))]))


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L'; L has as many columns as ``v`` has rank, up to rounding."""
    a, n = v.astype(np.float64).copy(), len(v)
    order, rank = np.arange(n), n
    first = float(np.max(np.diag(a), initial=0.0))
    for k in range(n):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= first * n * np.finfo(float).eps:
            rank = k
            break
        if p != k:
            a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        a[k, k] = math.sqrt(a[k, k])
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k])
    return np.tril(a)[:, :rank], order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of the factor's columns once they are orthogonal, by falling norm.

    Each sweep rotates every pair once: a round of a tournament rotates disjoint pairs together.
    """
    g = factor.copy()
    m = g.shape[1]
    players = list(range(m + m % 2))
    for _ in range(sweeps if m else 0):
        off = 0.0
        for _ in range(max(1, len(players) - 1)):
            half = len(players) // 2
            pairs = [(a, b) for a, b in zip(players[:half], players[half:][::-1], strict=True) if max(a, b) < m]
            if pairs:
                p, q = (np.array(x) for x in zip(*pairs, strict=True))
                x, y = g[:, p], g[:, q]
                alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                size = np.sqrt(alpha * beta)
                off = max(off, float(np.max(np.abs(gamma) / np.where(size > 0, size, 1.0))))
                turn = np.abs(gamma) > np.finfo(float).eps * size
                zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
                s = np.where(turn, c * t, 0.0)
                g[:, p], g[:, q] = c * x - s * y, s * x + c * y
            players = [players[0], players[-1], *players[1:-1]]
        if off <= 4 * np.finfo(float).eps:
            break
    values = (g * g).sum(0)
    by = np.argsort(-values, kind="stable")
    values, g = values[by], g[:, by]
    return values, g / np.sqrt(np.where(values > 0, values, 1.0))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero eigenvalues of ``v`` by falling size, and their unit eigenvectors, one a row."""
    factor, order = pivoted_cholesky(v)
    values, columns = jacobi(factor)
    vectors = np.zeros((columns.shape[1], len(v)))
    vectors[:, order] = columns.T
    return values, vectors


def usable(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that take part, and their dimension."""
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(_finite("v"))
    found = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = found[0] if found else 0
    # a double's floor beyond a long is the long's end, and adding stays inside it
    x = F.transform("v", lambda c: F.least(F.greatest(F.floor(c * SCALE).cast("double"), F.lit(-9.0e18)), F.lit(9.0e18)).cast("long") + F.lit(SHIFT))
    return rows.where(F.size("v") == width).select("id", x.alias("x")), width


def fitted(x: DataFrame, width: int) -> tuple[Whitening, int] | None:
    """The whitening of a table (id, x), and the largest size of an entry; None without rows."""
    tasks = max(1, math.isqrt(x.rdd.getNumPartitions()))
    schema = "rows long, sums array<string>, most string"
    parts = x.select("x").mapInArrow(partial(_sums, width=width), schema).repartition(tasks).mapInArrow(partial(_merged_sums, width=width), schema).collect()
    if not parts:
        return None
    rows = sum(p["rows"] for p in parts)
    sums = [sum(map(int, column)) for column in zip(*(p["sums"] for p in parts), strict=True)]
    most = max(int(p["most"]) for p in parts)
    schema = "i long, row array<double>"
    scatter = x.select("x").mapInArrow(partial(_scatter, rows=rows, sums=sums, most=most), schema)
    # square root of the tasks in matrices reach the driver
    v = np.zeros((width, width))
    for r in scatter.repartition(tasks).mapInArrow(partial(_merged_scatter, width=width), schema).toLocalIterator():
        v[r["i"]] += np.array(r["row"])
    v /= rows
    values, components = eigen(v)
    return Whitening(rows, sums, values, components, float(np.trace(v))), most


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening, most: int, count: int) -> Iterator[pa.RecordBatch]:
    """id, deviation (exact) and whitened values of each vector."""
    width = len(model.sums)
    axes = (model.components[:count] / np.sqrt(model.values[:count])[:, None]).T
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            part = batch.slice(k, ROWS)
            top = _numerators(_matrix(part.column(1), width), model.rows, model.sums, most)
            wide = top.dtype != object and float(np.abs(top).max(initial=0)) ** 2 * width < float(_SAFE)
            squares = (top if wide else top.astype(object)) ** 2
            deviation = [str(d) for d in squares.sum(axis=1).tolist()]
            scores = (top / model.rows).astype(np.float64) @ axes
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(deviation), pa.array(list(scores), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"]
            )


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most_components: int = 8) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Entries c count as x = floor(1024 * c) + 100000. Vectors that are null, empty, or hold a null or a
    non-finite entry are left out, and of the others those that have not the most common length (the
    larger one, if two are as common). Every other row counts, repeated ones and null ids as well.
    There are as many components as dimensions, ``most_components`` at most, and each row has them all.
    Components without variance (few or equal vectors) have explained 0 and a null ``whitened``, and
    don't count in ``identity_error``; that is null if there is no other. Of equal eigenvalues any
    basis may come out. ``deviation`` is null where it is no long; ``deviation_exact`` has its digits.
    An empty table gives an empty one; other columns are ignored.

    The driver holds matrices of the dimension, no rows.
    """
    x, width = usable(table, id_col, vector_col)
    kind = x.schema["id"].dataType.simpleString()
    names = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    x = stored(x, "vectors")
    found = fitted(x, width) if width else None
    if found is None:
        return table.sparkSession.createDataFrame([], names)
    model, most = found
    count = min(most_components, len(model.values))
    rows = stored(x.mapInArrow(partial(_projected, model=model, most=most, count=count), f"id {kind}, deviation string, whitened array<double>"), "whitened")
    shares = [float(v / model.trace) for v in model.values[:count]] + [0.0] * (min(most_components, width) - count)
    each = F.posexplode(F.array(*[F.struct(F.get("whitened", F.lit(k)).alias("w"), F.lit(s).alias("s")) for k, s in enumerate(shares)]))
    flat = rows.select("id", "deviation", each.alias("component", "c"))
    return flat.select(
        F.col("id").alias(id_col),
        (F.col("component") + 1).cast("int").alias("component"),
        F.lit(model.rows).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("c.w").alias("whitened"),
        F.col("c.s").alias("explained"),
        F.lit(_identity_error(rows, count)).cast("double").alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


def _identity_error(rows: DataFrame, count: int) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity; centred before multiplying."""
    if not count:
        return None
    w = [F.col("whitened")[k] for k in range(count)]
    means = rows.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    products = rows.agg(*[F.avg((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, products, strict=True))
