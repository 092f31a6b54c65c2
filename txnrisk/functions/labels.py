"""Decisions and text labels derived from scores and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) of the risk levels; above the last is CRITICAL.
RISK_LEVELS = [(0.3, "LOW"), (0.6, "MEDIUM"), (0.85, "HIGH")]
RISK_TOP = "CRITICAL"
# Upper bounds (exclusive) of the information value classes.
IV_CLASSES = [(0.02, "Not predictive"), (0.1, "Weak"), (0.3, "Medium"), (0.5, "Strong")]
IV_TOP = "Very strong"
# Effect sizes above which Cohen's d counts as strong or medium.
EFFECTS = [(0.8, "Strong"), (0.5, "Medium")]
EFFECT_REST = "Weak"
# Status texts of a flagged and an unflagged transaction.
STATUS_FLAGGED, STATUS_CLEAR = "SUSPEITA", "APROVADA"


def _ladder(c: Column, steps: list[tuple[float, str]], top: str) -> Column:
    out = F.when(c < steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(c < bound, name)
    return F.when(c.isNotNull(), out.otherwise(top))


def flagged(score: Column, threshold: float) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def risk_level(score: Column) -> Column:
    return _ladder(score, RISK_LEVELS, RISK_TOP)


def iv_strength(iv: Column) -> Column:
    return _ladder(iv, IV_CLASSES, IV_TOP)


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size > EFFECTS[0][0], EFFECTS[0][1]).when(size > EFFECTS[1][0], EFFECTS[1][1]).otherwise(EFFECT_REST)


def status(flag: Column) -> Column:
    return F.when(flag == 1, STATUS_FLAGGED).otherwise(STATUS_CLEAR)


def confidence(score: Column, flag: Column) -> Column:
    return F.when(flag == 1, score).otherwise(F.lit(1.0) - score)


def same_value(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("int")
