"""Publication rules, forecast horizons and gate closures as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeaxis as T


@dataclass(frozen=True)
class Rule:
    """How a value becomes public.

    kind: ``observed`` (``lag`` after the interval end), ``monthly`` (local day ``day`` of the
    next month), ``next_day`` (end of the next local day, never before ``not_before`` UTC) or
    ``forecast`` (``horizon`` such as ``D-1 13:00``, ``W-1 Fri 18:00``, ``M-1 -7D``, ``Y-1 15 Dec``).
    """

    kind: str
    lag: str | int = 0
    day: int = 15
    not_before: str | None = None
    horizon: str | None = None


def forecast_published(ts: str | Column, horizon: str, tz: str) -> Column:
    """UTC publication time of the forecast for the interval that starts at ``ts``."""
    day = T.local_midnight(T.utc_to_local(ts, tz))
    unit, _, rest = horizon.partition(" ")
    if unit.startswith("D-"):
        hour, minute = (int(x) for x in rest.split(":"))
        wall = T.plus(day, -int(unit[2:]) * T.DAY + hour * T.HOUR + minute * T.MICROS["minute"])
    elif unit == "W-1":
        wall = T.plus(F.date_trunc("week", day), -3 * T.DAY + 18 * T.HOUR)
    elif unit == "M-1":
        wall = T.plus(F.date_trunc("month", day), -7 * T.DAY)
    elif unit == "Y-1":
        wall = F.make_date(F.year(day) - 1, F.lit(12), F.lit(15)).cast("timestamp_ntz")
    else:
        raise ValueError(horizon)
    return T.local_to_utc(wall, tz, "first", "gap_end")


def published(ts: str | Column, rule: Rule, step: str | int, tz: str) -> Column:
    """UTC time from which look-backs may use the value of the interval that starts at ``ts``."""
    end = T.plus(ts, step)
    if rule.kind == "observed":
        return T.plus(end, rule.lag)
    if rule.kind == "forecast":
        return end
    wall = T.utc_to_local(ts, tz)
    if rule.kind == "monthly":
        first = F.add_months(F.date_trunc("month", wall).cast("date"), 1)
        return T.local_to_utc(F.date_add(first, rule.day - 1).cast("timestamp_ntz"), tz, "first", "gap_end")
    if rule.kind == "next_day":
        nxt = T.local_to_utc(T.plus(T.local_midnight(wall), 2 * T.DAY), tz, "first", "gap_end")
        return nxt if rule.not_before is None else F.greatest(nxt, F.lit(rule.not_before).cast("timestamp_ntz"))
    raise ValueError(rule.kind)


def window_known(end: str | Column, step: str | int, horizon: str, origin: str | Column, tz: str) -> Column:
    """True if the whole forecast window was public at the origin: its last interval was."""
    return forecast_published(T.plus(end, -T.span(step)), horizon, tz) <= T.col(origin)


def result_known(day: str | Column, times: list[tuple[str, str]], lag: str | int, tz: str, days_before: int = 0) -> Column:
    """UTC time at which the auction result of a local delivery day is known.

    ``times`` lists (valid from, HH:MM) in date order; the timetable switches on the auction day.
    """
    auction = F.date_sub(T.col(day).cast("date"), days_before)
    clock = F.lit(None).cast("long")
    for since, hhmm in times:
        h, m = (int(x) for x in hhmm.split(":"))
        clock = F.when(auction >= F.lit(since).cast("date"), F.lit(h * T.HOUR + m * T.MICROS["minute"])).otherwise(clock)
    return T.local_to_utc(T.plus(T.plus(auction, clock), lag), tz, "first", "gap_end")


@dataclass(frozen=True)
class Gate:
    """Gate closure of a class of blocks.

    ``anchor`` is ``day`` or ``week`` (Monday of the delivery week); ``table`` maps a delivery
    weekday (Mon=0) to (days before, HH:MM), or one entry under ``None`` for all weekdays.
    """

    label: str
    table: dict[int | None, tuple[int, str]]
    anchor: str = "day"
    confirmed_from: str | None = None


def gate_closure(df: DataFrame, start: str, gates: dict[str, Gate], selector: str, tz: str, strict: bool = False) -> DataFrame:
    """Adds ``gate_closure_utc``, ``gate_rule`` and ``gate_confidence``.

    A block without a rule stays NULL; with ``strict`` it fails the job, as does a closure after the start of delivery.

    The rules are folded into one expression, so there is no join. Times given in the table
    must not fall into a switch hour.
    """
    wall = T.utc_to_local(start, tz)
    day = T.local_midnight(wall)
    weekday = F.weekday(wall)
    closing = F.lit(None).cast("timestamp_ntz")
    label = F.lit(None).cast("string")
    confidence = F.lit(None).cast("string")
    for key, gate in gates.items():
        base = F.date_trunc("week", day).cast("timestamp_ntz") if gate.anchor == "week" else day
        offset = F.lit(None).cast("long")
        for wd, (back, hhmm) in gate.table.items():
            h, m = (int(x) for x in hhmm.split(":"))
            us = F.lit(-back * T.DAY + h * T.HOUR + m * T.MICROS["minute"])
            offset = us if wd is None else F.when(weekday == wd, us).otherwise(offset)
        hit = F.col(selector) == key
        closing = F.when(hit, T.plus(base, offset)).otherwise(closing)
        label = F.when(hit, F.lit(gate.label)).otherwise(label)
        sure = F.lit(False) if gate.confirmed_from is None else day >= F.lit(gate.confirmed_from).cast("timestamp_ntz")
        confidence = F.when(hit, F.when(sure, "calendar").otherwise("assumed")).otherwise(confidence)
    closed = T.local_to_utc(closing, tz)
    if strict:
        fail = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(F.col(selector).cast("string"), F.lit("null")), F.lit(" at "), F.coalesce(F.col(start).cast("string"), F.lit("null")))).cast("timestamp_ntz")
        closed = (F.when(closed.isNull() & F.col(start).isNotNull(), fail("no gate closure rule for "))
                  .when(closed > F.col(start).cast("timestamp_ntz"), fail("gate closes after the start of delivery: ")).otherwise(closed))
    return df.withColumns({"gate_closure_utc": closed, "gate_rule": label, "gate_confidence": confidence})
