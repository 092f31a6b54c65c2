"""Sorting, top-k reports and sampling operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.ordering import WINDOW_ROWS, as_columns, ranked
from txnrisk.operators.selection import cut_ranks, hash_number
from txnrisk.operators.splits import stable_hash

# Up to this k Spark cuts each task's rows to k before the shuffle of a ranked window.
GROUP_LIMIT = 1000


def sort_by_time(df: DataFrame, order: Sequence, out: str | None = None, limit: int = WINDOW_ROWS) -> DataFrame:
    """Rows in time order, optionally numbered from 0 in that order."""
    if out is None:
        return df.orderBy(*as_columns(order))
    placed = ranked(df, [], order, out, limit)
    return placed.withColumn(out, F.col(out) - 1)


def top_k(df: DataFrame, score: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """The k highest scores; equal scores in the order of ``tiebreak``."""
    return df.orderBy(F.col(score).desc(), *tiebreak).limit(k)


def top_values(df: DataFrame, column: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k most frequent values among the rows that satisfy ``where``."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), column).limit(k)


def rank_features(stats: DataFrame, by: str, n: int, name: str = "variable") -> DataFrame:
    """The n features with the largest absolute statistic."""
    return stats.orderBy(F.abs(by).desc(), name).limit(n)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank", limit: int = WINDOW_ROWS
) -> DataFrame:
    """The first k rows of each group. Small k uses Spark's group limit, which reduces
    every task to k rows per key before the shuffle; large k uses distributed ranks."""
    if k <= GROUP_LIMIT:
        spec = Window.partitionBy(*keys).orderBy(*as_columns(order))
        return df.withColumn(out, F.row_number().over(spec)).filter(F.col(out) <= k)
    return ranked(df, keys, order, out, limit).filter(F.col(out) <= k)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: str = "42") -> DataFrame:
    """Repeatable uniform sample of n rows: the n smallest hashes (a distributed top-n)."""
    hashed = df.withColumn("_hash", stable_hash(key, seed))
    return hashed.orderBy("_hash", *key).limit(n).drop("_hash")


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: str = "42") -> DataFrame:
    """Repeatable Bernoulli sample: keeps a row when its hash falls below the fraction."""
    place = F.conv(F.substring(stable_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.filter(place < fraction)


def stratified_sample(
    df: DataFrame, label: str, fraction: float, key: Sequence[str], order: Sequence = (), seed: str = "42",
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """floor(fraction * size) rows of every class, so the class ratio stays."""
    shuffled = df.withColumn("_hash", stable_hash(key, seed))
    cut = F.floor(F.col("n") * F.lit(fraction))
    placed = cut_ranks(shuffled, [label], ["_hash", *order], hash_number(F.col("_hash")), [cut], "_cut", limit)
    return placed.filter("_cut = 0").drop("_cut", "_hash")


def sampling_report(before: DataFrame, after: DataFrame, label: str, amount: str) -> DataFrame:
    """Sizes, label rates and mean amounts before and after sampling, in one row."""

    def stats(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            F.avg(label).alias(f"{name}_rate"),
            F.avg(amount).alias(f"{name}_amount_mean"),
        )

    late = stats(after, "sampled")
    return stats(before, "original").withColumns({c: late.select(c).scalar() for c in late.columns})


def poisson_steps(mean: float) -> list[float]:
    """Probabilities of at most 0, 1, 2, .. events, up to the last that a 32-bit share can tell from 1."""
    out, term, k = [], math.exp(-mean), 0
    total = term
    while total < 1 - 2.0**-33 and k < 1000:
        out.append(total)
        k += 1
        term *= mean / k
        total += term
    return out


def bootstrap_positives(df: DataFrame, label: str, key: Sequence[str], times: float = 2.0, seed: str = "42") -> DataFrame:
    """Positives drawn with replacement and appended to all rows.

    How often a row is drawn follows from the hash of ``key``, Poisson with mean ``times``, so the
    draw is the same in any partitioning.
    """
    place = F.conv(F.substring(stable_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    copies = sum(((place >= p).cast("int") for p in poisson_steps(times)), F.lit(0))
    drawn = df.filter(F.col(label) == 1).withColumn("_copies", copies).filter("_copies > 0")
    drawn = drawn.select(*df.columns, F.explode(F.sequence(F.lit(1), "_copies"))).drop("col")
    return df.unionByName(drawn)
