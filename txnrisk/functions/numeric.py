"""Arithmetic helpers with explicit null, zero and infinity handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def null_if_not_finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), None).otherwise(c)


def zero_if_not_finite(c: Column) -> Column:
    return F.coalesce(null_if_not_finite(c), F.lit(0.0))


def to_number(c: Column) -> Column:
    """Text that is no number becomes null; so do NaN and infinities."""
    return null_if_not_finite(c.try_cast("double"))


def large_finite(c: Column, bound: float = 1e10) -> Column:
    """Infinities to +-bound, nulls and NaN to zero."""
    return (
        F.when(c.isNull() | F.isnan(c), 0.0)
        .when(c == F.lit(INF), bound)
        .when(c == F.lit(-INF), -bound)
        .otherwise(c)
    )


def clamped(c: Column, low: float, high: float) -> Column:
    """Nulls and NaN to zero, the rest into [low, high]."""
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(n / F.nullif(d.cast("double"), F.lit(0.0)))


def guarded_ratio(n: Column, d: Column, guard: float) -> Column:
    return n / (d + F.lit(guard))


def row_max(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def row_mean(cols: list[Column]) -> Column:
    """Mean over the non-null values of a row; null when all are null."""
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(present > 0, total / F.nullif(present, F.lit(0)))


def gaussian_similarity(z: Column) -> Column:
    return F.exp(F.lit(-0.5) * z * z)


def log_odds(events: Column, others: Column, all_events: Column, all_others: Column, bound: float = 5.0) -> Column:
    """Weight of evidence with half-count smoothing, clipped to +-bound."""
    share_e = (events + F.lit(0.5)) / (all_events + F.lit(1.0))
    share_o = (others + F.lit(0.5)) / (all_others + F.lit(1.0))
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.log(share_e / share_o)))
