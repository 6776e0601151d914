"""Rounding, clamps, decay and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def round_half_up(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go towards positive infinity."""
    scale = 10**digits
    return F.floor(c * scale + F.lit(0.5)) / scale if digits else F.floor(c + F.lit(0.5))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, default: float | None = None) -> Column:
    """part / whole, `default` (or null) where whole is 0."""
    r = F.when(whole != 0, part / whole)
    return r if default is None else F.coalesce(r, F.lit(default))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone (then in the session's, which is UTC here)."""
    return F.unix_micros(ts.cast("timestamp"))


def age_days(as_of: str, at: Column) -> Column:
    """Fractional days between a timestamp column and as_of (UTC literal)."""
    return (micros(F.lit(as_of)) - micros(at)) / DAY


def half_life_weight(age: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def linear_decay(days: Column, a_day: int = 5, most: int = 50) -> Column:
    return F.least(F.floor(days) * a_day, F.lit(most))


def week_key(ts: Column) -> Column:
    """Year and week as `YYYY-Www`, the week being ceil((days since 1 January + weekday of 1 January + 1) / 7) with Sunday as 0."""
    start = F.trunc(ts, "year")
    days = (micros(ts) - micros(start)) / DAY
    week = F.ceil((days + (F.dayofweek(start) - 1) + 1) / 7)
    return F.concat(F.year(ts), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def iso_week_key(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
