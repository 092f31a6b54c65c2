"""Calendar features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meteorological season of each month, January first.
SEASONS = ["winter", "winter", "spring", "spring", "spring", "summer",
           "summer", "summer", "fall", "fall", "fall", "winter"]

# Period of each cyclical date part.
CYCLES = {"month": 12, "dayofyear": 365.25, "weekday": 7, "hour": 24}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the zone-less timestamp is read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def date_parts(ts: Column, prefix: str = "") -> dict[str, Column]:
    """Weekday counts from Monday = 0; week is the ISO week."""
    parts = {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "dayofyear": F.dayofyear(ts),
        "weekday": F.weekday(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "quarter": F.quarter(ts),
        "weekofyear": F.weekofyear(ts),
    }
    return {f"{prefix}{name}": c.cast("int") for name, c in parts.items()}


def date_flags(ts: Column, prefix: str = "") -> dict[str, Column]:
    day = ts.cast("date")
    return {
        f"{prefix}is_weekend": F.weekday(ts) >= 5,
        f"{prefix}is_month_start": F.dayofmonth(ts) == 1,
        f"{prefix}is_month_end": day == F.last_day(day),
    }


def season(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.month(ts))


def cyclical(ts: Column, prefix: str = "") -> dict[str, Column]:
    """Sine and cosine of the position in the year, week and day."""
    parts = date_parts(ts)
    out: dict[str, Column] = {}
    for name, period in CYCLES.items():
        angle = parts[name] * F.lit(2 * math.pi) / F.lit(float(period))
        out[f"{prefix}{name}_sin"] = F.sin(angle)
        out[f"{prefix}{name}_cos"] = F.cos(angle)
    return out


def business_hours(ts: Column) -> Column:
    """Hours 9 to 17, both included."""
    return F.hour(ts).between(9, 17).cast("int")


def risk_period_flags(ts: Column) -> dict[str, Column]:
    """Late night wraps around midnight (22..4), which ``between(22, 4)`` cannot express."""
    return {
        "is_late_night": ((F.hour(ts) >= 22) | (F.hour(ts) <= 4)).cast("int"),
        "is_high_risk_day": F.weekday(ts).isin(2, 3).cast("int"),
        "is_peak_month": F.month(ts).isin(11, 12).cast("int"),
    }
