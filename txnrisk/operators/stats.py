"""Correlations, outliers and two-sample statistics per feature.

The two-sample statistics work on counts per distinct value (see ``class_counts``), so
they need one aggregation of the rows and running totals over the distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions.labels import effect_label
from txnrisk.operators.encoding import standard_scale
from txnrisk.operators.ordering import WINDOW_ROWS, running_sum
from txnrisk.operators.quantiles import long_form, quantiles
from txnrisk.session import settle, stored


def safe_corr(a: str, b: str) -> Column:
    """Correlation over rows where both are known; null instead of an error for a constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def correlations_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(variable, r): correlation of each column with one target, in one aggregation."""
    row = df.agg(*[safe_corr(c, target).alias(c) for c in cols])
    return row.unpivot([], list(cols), "variable", "r")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Rows of values as matrices; a null is NaN with its place in the mask: (values, known)."""
    for batch in batches:
        values = batch.column(0).flatten()
        known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
        yield values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), known


def _column_moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row per task and column: finite values, their mean, squared deviations, least and largest."""
    n, mean, squares = np.zeros(width), np.zeros(width), np.zeros(width)
    low, high = np.full(width, np.inf), np.full(width, -np.inf)
    for x, known in _blocks(batches, width):
        fit = known & np.isfinite(x)
        own = fit.sum(0)
        some = np.maximum(own, 1)
        x = np.where(fit, x, 0.0)
        m = x.sum(0) / some
        d = (np.where(fit, x - m, 0.0) ** 2).sum(0)
        total = np.maximum(n + own, 1)
        squares += d + (m - mean) ** 2 * n * own / total
        mean += (m - mean) * own / total
        n += own
        low, high = np.minimum(low, np.where(fit, x, np.inf).min(0, initial=np.inf)), np.maximum(high, np.where(fit, x, -np.inf).max(0, initial=-np.inf))
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(width), n, mean, squares, low, high)], names=["i", "n", "mean", "squares", "low", "high"])


_GRAM = "part long, i long, cells array<double>"


def _gram_rows(parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    count, width, _ = parts.shape
    kinds, at = np.repeat(np.arange(count), width), np.tile(np.arange(width), count)
    cells = pa.array(list(parts.reshape(-1, width)), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at), cells], names=["part", "i", "cells"])


def _gram(batches: Iterator[pa.RecordBatch], shift: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums over rows where both of two columns are known and finite: rows, rows known at all,
    values, squares and products, a matrix each."""
    width = len(shift)
    total = np.zeros((5, width, width))
    for x, known in _blocks(batches, width):
        fit = known & np.isfinite(x)
        z = np.where(fit, (np.where(fit, x, 0.0) - shift) / scale, 0.0)
        mask, seen = fit.astype(np.float64), known.astype(np.float64)
        total += np.stack([mask.T @ mask, seen.T @ seen, z.T @ mask, (z * z).T @ mask, z.T @ z])
    yield from _gram_rows(total)


def _added(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((5, width, width))
    for batch in batches:
        cells = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        np.add.at(total, (batch.column(0).to_numpy(), batch.column(1).to_numpy()), cells)
    yield from _gram_rows(total)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns over their pairwise complete rows.

    Values and masks are multiplied as blocks: a few matrices of the columns' number per task hold the
    moments of all pairs, whether they have nulls or not, and are added up over the tasks. Values are
    shifted and scaled by one first pass. r is null for a column that is constant on a pair's rows, and
    NaN if one of these rows has a value that is not finite.
    """
    cols = list(cols)
    width = len(cols)
    if width < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    # both passes read stored columns, numbered, since names may repeat
    values = stored(df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]))
    rows = values.select(F.array(*values.columns).alias("x"))
    tasks = rows.mapInArrow(partial(_column_moments, width=width), "i long, n double, mean double, squares double, low double, high double")
    n, middle = F.col("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0.0))
    first = tasks.groupBy("i").agg(middle.alias("mean"), F.sum(n).alias("n"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
    by_column = {r["i"]: r for r in first.collect()}
    nothing = {"mean": 0.0, "n": 0.0, "squares": 0.0, "low": 0.0, "high": 0.0}
    found = [by_column.get(i, nothing) for i in range(width)]
    shift = np.array([r["mean"] or 0.0 for r in found])
    scale = np.array([math.sqrt(r["squares"] / r["n"]) if r["n"] and r["squares"] > 0 else 1.0 for r in found])
    parts = rows.mapInArrow(partial(_gram, shift=shift, scale=scale), _GRAM)
    merged = parts.repartition(max(1, math.isqrt(rows.rdd.getNumPartitions()))).mapInArrow(partial(_added, width=width), _GRAM)
    total = np.zeros((5, width, width))
    for r in merged.toLocalIterator():
        total[r["part"], r["i"]] += np.array(r["cells"])
    both, known, sums, squares, products = total
    with np.errstate(divide="ignore", invalid="ignore"):
        covariance = products - sums * sums.T / both
        own = squares - sums**2 / both
        r = covariance / np.sqrt(own * own.T)
    # what rounding alone leaves of a constant
    noise = both * (8 * np.finfo(float).eps * (1 + np.abs(shift) / scale))[:, None] ** 2
    flat = (own <= noise) | np.array([f["low"] == f["high"] for f in found])[:, None] | (both < 2)
    r = np.where(known > both, np.nan, np.clip(r, -1.0, 1.0))
    r = np.where((flat | flat.T) & (known == both), None, r.astype(object))
    pairs = [(cols[i], cols[j], None if r[i, j] is None else float(r[i, j])) for i, j in combinations(range(width), 2)]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, r double")


def strong_pairs(matrix: DataFrame, above: float = 0.8) -> DataFrame:
    return matrix.filter(F.abs("r") > above)


def iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, limit: int = WINDOW_ROWS) -> DataFrame:
    """Bounds, number and share of values outside the quartiles by ``factor`` ranges."""
    q = quantiles(df, cols, [0.25, 0.75], limit=limit)
    spread = F.col("q")[1] - F.col("q")[0]
    bounds = q.select(
        F.col("column").alias("_c"),
        (F.col("q")[0] - factor * spread).alias("lower"),
        (F.col("q")[1] + factor * spread).alias("upper"),
    )
    rows = long_form(df, cols).join(F.broadcast(bounds), F.col("column") == F.col("_c"))  # one row per column
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return rows.groupBy("column").agg(
        F.first("lower").alias("lower"),
        F.first("upper").alias("upper"),
        F.count_if(outside).alias("outliers"),
        (F.avg(F.coalesce(outside, F.lit(False)).cast("double")) * 100).alias("outlier_pct"),
    )


def extreme_amounts(df: DataFrame, amount: str, a: str, b: str, p: float = 0.999, limit: int = WINDOW_ROWS) -> DataFrame:
    """Rows above the p-quantile of the amount, and rows whose two banks are equal."""
    threshold = quantiles(df, [amount], [p], limit=limit).select(F.col("q")[0]).scalar()
    rows = df.select(F.col(amount).alias("_v"), (F.col(a) == F.col(b)).alias("_same"), threshold.alias("_t"))
    return rows.agg(
        F.first("_t").alias("threshold"),
        F.count_if(F.col("_v") > F.col("_t")).alias("large_count"),
        (F.avg((F.col("_v") > F.col("_t")).cast("double")) * 100).alias("large_pct"),
        F.count_if("_same").alias("same_bank_count"),
        (F.avg(F.coalesce("_same", F.lit(False)).cast("double")) * 100).alias("same_bank_pct"),
    )


def class_counts(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(column, value, n1, n0) over non-null values; NaN counts as missing."""
    rows = long_form(df, cols, [label]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return settle(
        rows.groupBy("column", "value").agg(
            F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
        )
    )


def _with_running(counts: DataFrame, limit: int) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    run = running_sum(counts, ["column"], ["value"], {"c1": F.col("n1"), "c0": F.col("n0")}, limit)
    t = totals.withColumnRenamed("column", "_c")
    return run.join(F.broadcast(t), F.col("column") == F.col("_c")).drop("_c")  # one row per column


def ks_of_counts(counts: DataFrame, limit: int = WINDOW_ROWS) -> DataFrame:
    """(column, n1, n0, ks, p_value): largest distance of the two distribution functions.

    The p-value is the asymptotic Kolmogorov series.
    """
    rows = _with_running(counts, limit)
    gap = F.abs(F.col("c1") / F.nullif(F.col("t1"), F.lit(0)) - F.col("c0") / F.nullif(F.col("t0"), F.lit(0)))
    out = rows.groupBy("column").agg(F.first("t1").alias("n1"), F.first("t0").alias("n0"), F.max(gap).alias("ks"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    lam2 = F.col("ks") * F.col("ks") * n1 * n0 / F.nullif(n1 + n0, F.lit(0.0))
    terms = [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam2) for k in range(1, 101)]
    series = reduce(lambda a, b: a + b, terms)
    p = F.when(lam2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return out.withColumn("p_value", p)


def ks_two_sample(df: DataFrame, cols: Sequence[str], label: str, limit: int = WINDOW_ROWS) -> DataFrame:
    return ks_of_counts(class_counts(df, cols, label), limit)


@F.pandas_udf(T.DoubleType())
def _two_sided(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Normal two-sided p-value; runs on result rows, one per feature."""
    for z in batches:
        yield z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else None)


def mann_whitney(df: DataFrame, cols: Sequence[str], label: str, limit: int = WINDOW_ROWS, p_value: bool = True) -> DataFrame:
    """(column, u, z, p_value): rank-sum test with tie correction and continuity correction.

    A value's average rank follows from the counts below it, so no row is ranked.
    """
    rows = _with_running(class_counts(df, cols, label), limit)
    ties = (F.col("n1") + F.col("n0")).cast("double")
    below = (F.col("c1") + F.col("c0")).cast("double") - ties
    stats = rows.groupBy("column").agg(
        F.first("t1").cast("double").alias("_n1"),
        F.first("t0").cast("double").alias("_n0"),
        F.sum(F.col("n1") * (below + (ties + 1) / 2)).alias("_rank_sum"),
        F.sum(ties * ties * ties - ties).alias("_tie"),
    )
    n1, n0 = F.col("_n1"), F.col("_n0")
    n = n1 + n0
    u = F.col("_rank_sum") - n1 * (n1 + 1) / 2
    variance = n1 * n0 / 12 * ((n + 1) - F.col("_tie") / F.nullif(n * (n - 1), F.lit(0.0)))
    off = u - n1 * n0 / 2
    z = F.when(variance > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(F.nullif(variance, F.lit(0.0))))
    out = stats.select("column", u.alias("u"), z.alias("z"))
    return out.withColumn("p_value", _two_sided("z")) if p_value else out


def cohens_d(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(column, mean1, mean0, d, effect): standardised difference of the class means."""

    def of(c: int) -> Column:
        return F.when(F.col(label) == c, F.col("value"))

    stats = long_form(df, cols, [label]).groupBy("column").agg(
        F.avg(of(1)).alias("mean1"), F.avg(of(0)).alias("mean0"),
        F.stddev_samp(of(1)).alias("_s1"), F.stddev_samp(of(0)).alias("_s0"),
    )
    pooled = F.sqrt((F.col("_s1") * F.col("_s1") + F.col("_s0") * F.col("_s0")) / 2)
    d = F.when(pooled > 0, (F.col("mean1") - F.col("mean0")) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)
    return stats.withColumn("d", d).withColumn("effect", effect_label(F.col("d"))).drop("_s1", "_s0")


def class_histogram(df: DataFrame, column: str, label: str, buckets: int = 20) -> DataFrame:
    """(label, bucket, low, count, density): equal-width histogram per class.

    Rows without a label are a class of their own; a column without values has no buckets.
    """
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    width = ((high - low) / buckets) or 1.0
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col(column) - low) / width)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(label, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(F.col(label).alias("_l")).agg(F.sum("count").alias("_t"))
    return counts.join(totals, F.col(label).eqNullSafe(F.col("_l"))).select(
        label, "bucket", (F.lit(low) + F.col("bucket") * width).alias("low"), "count",
        (F.col("count") / F.col("_t") / width).alias("density"),
    )


def principal_components(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(component, explained, cumulative, class1_mean, class0_mean) on standardised columns.

    Missing values count as 0, so every row takes part.
    """
    k = len(cols)
    # read by the means, the fit's passes and the projection
    rows = stored(df.select(label, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols]))
    scaled = standard_scale(rows, cols)
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(scaled).select(label, "_x")
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vectors)
    share = [float(v) for v in model.explainedVariance.toArray()]
    projected = model.transform(vectors).select(label, F.posexplode(vector_to_array("_pc")).alias("component", "value"))
    means = projected.groupBy("component").agg(
        F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("class1_mean"),
        F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("class0_mean"),
    )
    explained = F.array(*[F.lit(v) for v in share])
    cumulative = F.array(*[F.lit(sum(share[: i + 1])) for i in range(k)])
    return means.select(
        (F.col("component") + 1).alias("component"),
        F.element_at(explained, F.col("component") + 1).alias("explained"),
        F.element_at(cumulative, F.col("component") + 1).alias("cumulative"),
        "class1_mean",
        "class0_mean",
    )


def outcome_differences(df: DataFrame, cols: Sequence[str], outcome: str, a: str, b: str) -> DataFrame:
    """(column, mean and deviation in ``a`` and ``b``, absolute and percentage difference)."""

    def of(name: str) -> Column:
        return F.when(F.col(outcome) == name, F.col("value"))

    stats = long_form(df, cols, [outcome]).groupBy("column").agg(
        F.avg(of(a)).alias("mean_a"), F.avg(of(b)).alias("mean_b"),
        F.stddev_samp(of(a)).alias("std_a"), F.stddev_samp(of(b)).alias("std_b"),
    )
    diff = F.col("mean_a") - F.col("mean_b")
    pct = F.when(F.col("mean_b") != 0, diff / F.nullif(F.abs("mean_b"), F.lit(0.0)) * 100).otherwise(0.0)
    return stats.withColumns({"abs_diff": F.abs(diff), "pct_diff": pct}).orderBy(F.col("abs_diff").desc(), "column")


def leakage_screen(df: DataFrame, cols: Sequence[str], split: str, threshold: float = 0.1, limit: int = WINDOW_ROWS) -> DataFrame:
    """Distribution distance of each feature between test and train, flagged above ``threshold``."""
    marked = df.filter(F.col(split).isin("train", "test")).withColumn("_is_test", (F.col(split) == "test").cast("int"))
    out = ks_two_sample(marked, cols, "_is_test", limit)
    return out.select("column", "ks", (F.col("ks") > threshold).alias("is_leaky"))
