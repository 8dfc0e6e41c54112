"""Rounding rules, deviations and time-of-day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled binary value."""
    scale = float(10**digits)
    return F.round(x * scale) / F.lit(scale)


def js_round(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def floor_to(x: Column, step: int) -> Column:
    """The largest multiple of step that is not above x, below zero too."""
    return x - F.pmod(x, F.lit(step))


def boost_percent(base: Column, more: Column) -> Column:
    """Rounded gain of more over base in percent; 0 where base is 0."""
    return F.when(base > 0, js_round((more - base) / base * 100.0)).otherwise(F.lit(0))


def clock(seconds: Column, wrap: bool = True, pad: bool = True) -> Column:
    """HH:MM of seconds since the service day began; wrapped at 24 hours or counting on."""
    hour = F.floor(seconds / 3600)
    hour = F.pmod(hour, F.lit(24)) if wrap else hour
    minute = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    text = hour.cast("long").cast("string")
    return F.concat(F.lpad(text, 2, "0") if pad else text, F.lit(":"), F.lpad(minute.cast("long").cast("string"), 2, "0"))


def clock_seconds(text: Column, default: int = 8 * 3600, step: int = 300) -> Column:
    """Seconds of an HH:MM text, at the nearest step; the default where it is not a time of day."""
    hour, minute = F.regexp_extract(text, r"^(\d+):", 1).try_cast("int"), F.regexp_extract(text, r":(\d+)$", 1).try_cast("int")
    good = text.rlike(r"^\d{1,2}:\d{2}$") & (hour < 24) & (minute < 60)
    return F.when(good, (F.round((hour * 3600 + minute * 60) / step) * step).cast("long")).otherwise(F.lit(default).cast("long"))


def gaps(times: Column) -> Column:
    """Differences of neighbours in a sorted array."""
    return F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b - a)


def mean(values: Column) -> Column:
    """Mean of a numeric array, null if empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation of a numeric array, null if empty."""
    m = mean(values)
    return F.when(F.size(values) > 0, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values)))


def ticks(low: Column, high: Column, count: int) -> Column:
    """count + 1 times in milliseconds, evenly from low to high (seconds), cut to whole milliseconds."""
    at = lambda i: low + i.cast("double") / F.lit(float(count)) * (high - low)
    return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: (at(i) * 1000).cast("long"))
