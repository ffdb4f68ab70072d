"""Instants, wall clocks and buckets as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}
HOUR = MICROS["hour"]
DAY = MICROS["day"]


def span(text: str | int) -> int:
    """``'15 minutes'`` -> microseconds; integers pass through."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m[2] not in MICROS:
        raise ValueError(f"not a fixed duration: {text!r}")
    return int(m[1]) * MICROS[m[2]]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """UTC microseconds of a timestamp (NTZ values are read as UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def plus(c: str | Column, duration: str | int | Column) -> Column:
    """Instant moved by a fixed duration (or a Column of microseconds)."""
    step = duration if isinstance(duration, Column) else F.lit(span(duration))
    return from_micros(micros(c) + step)


def floor_div(a: Column, width: int | Column) -> Column:
    """Exact floor division of two BIGINTs."""
    w = width if isinstance(width, Column) else F.lit(width).cast("long")
    return F.call_function("div", a - F.pmod(a, w), w)


def floor_time(c: str | Column, step: str | int) -> Column:
    us = micros(c)
    return from_micros(us - F.pmod(us, F.lit(span(step))))


def ceil_time(c: str | Column, step: str | int) -> Column:
    us = micros(c)
    return from_micros(us + F.pmod(-us, F.lit(span(step))))


def order_key(df: DataFrame, name: str) -> Column:
    """BIGINT position on the ordering axis of a timestamp, date or integer column; other types have no exact one."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long")
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name!r} orders by {kind.simpleString()}; use a timestamp, date or integer column")
    return F.col(name).cast("long")


def key_width(df: DataFrame, name: str, chunk: str | int) -> int:
    """Chunk width on the axis of :func:`order_key`."""
    if isinstance(chunk, int):
        return chunk
    return span(chunk) // DAY if isinstance(df.schema[name].dataType, T.DateType) else span(chunk)


# ---------------------------------------------------------------- wall clocks
def utc_to_local(c: str | Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(c).cast("timestamp_ntz"))


def local_to_utc(c: str | Column, tz: str, ambiguous: str = "first",
                 nonexistent: str = "shift") -> Column:
    """Wall clock -> UTC with an explicit policy for the two switch nights.

    ambiguous: ``first`` | ``second`` | ``null``; nonexistent: ``shift`` (by the gap) |
    ``gap_end`` (the switch instant; zones that switch on a full hour) | ``null``.
    """
    wall = col(c).cast("timestamp_ntz")
    first = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
    back = utc_to_local(first, tz)
    later = plus(first, "1 hour")
    earlier = plus(first, -HOUR)
    null = F.lit(None).cast("timestamp_ntz")
    twice = utc_to_local(later, tz) == wall
    twice_before = utc_to_local(earlier, tz) == wall
    low = F.when(twice_before, earlier).otherwise(first)
    high = F.when(twice, later).otherwise(first)
    folded = {"first": low, "second": high, "null": null}[ambiguous]
    gap = {"shift": first, "gap_end": floor_time(first, "1 hour"), "null": null}[nonexistent]
    return (F.when(back != wall, gap)
            .when(twice | twice_before, folded).otherwise(first))


def local_midnight(c: str | Column) -> Column:
    return F.date_trunc("day", col(c)).cast("timestamp_ntz")


def local_bucket(c: str | Column, tz: str, hours: int) -> Column:
    """UTC start of the ``hours``-long bucket counted on the local clock from midnight.

    On switch days the buckets keep their local labels, so they last 3 h or 5 h.
    """
    wall = utc_to_local(c, tz)
    label = plus(local_midnight(wall), F.floor(F.hour(wall) / hours).cast("long") * (hours * HOUR))
    return local_to_utc(label, tz, "first", "gap_end")


def calendar_bucket(c: str | Column, unit: str, week_anchor: str = "monday") -> Column:
    """Left label of the day, ISO week, Sunday week, month, quarter or year of a wall clock."""
    if unit == "week" and week_anchor == "sunday":
        return plus(F.date_trunc("week", plus(c, "1 day")), -DAY)
    return F.date_trunc(unit, col(c)).cast("timestamp_ntz")


def interval_start(c: str | Column, step: str | int, convention: str = "end") -> Column:
    """Start label of an interval that its source labels at the ``end`` or the ``start``."""
    return plus(c, -span(step)) if convention == "end" else col(c)
