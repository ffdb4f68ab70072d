"""Calendar columns: movable feasts, holidays, cyclic encodings, block shares."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeaxis import col

# month*100+day of the fixed holidays and offsets from Easter Sunday of the movable ones.
FIXED_HOLIDAYS = (101, 102, 801, 1225, 1226)
EASTER_OFFSETS = (-2, 1, 39, 50)


def _mod(a: Column, b: int) -> Column:
    return F.pmod(a, F.lit(b))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter(year: str | Column) -> Column:
    """Easter Sunday (DATE) by the Gregorian computus."""
    y = col(year).cast("int")
    golden = _mod(y, 19)
    century, yy = _div(y, 100), _mod(y, 100)
    skipped = _div(century, 4)
    moon = _div(century + 8, 25)
    epact = _mod(golden * 19 + century - skipped - _div(century - moon + 1, 3) + 15, 30)
    weekday = _mod(F.lit(32) + _mod(century, 4) * 2 + _div(yy, 4) * 2 - epact - _mod(yy, 4), 7)
    late = _div(golden + epact * 11 + weekday * 22, 451)
    day = epact + weekday - late * 7 + 114
    return F.make_date(y, _div(day, 31), _mod(day, 31) + 1)


def is_holiday(date: str | Column) -> Column:
    d = col(date).cast("date")
    feast = easter(F.year(d))
    fixed = (F.month(d) * 100 + F.dayofmonth(d)).isin(*FIXED_HOLIDAYS)
    return fixed | F.datediff(d, feast).isin(*EASTER_OFFSETS)


def day_flags(date: str | Column) -> dict[str, Column]:
    """Holiday neighbourhood of a local date."""
    d = col(date).cast("date")
    wd = F.weekday(d)
    before, after = is_holiday(F.date_add(d, 1)), is_holiday(F.date_sub(d, 1))
    md = F.month(d) * 100 + F.dayofmonth(d)
    return {
        "holiday": is_holiday(d),
        "day_before_holiday": before,
        "day_after_holiday": after,
        "bridge_day": ((wd == 0) & before) | ((wd == 4) & after),
        "xmas_period": (md >= 1224) | (md <= 106),
    }


def cyclic(value: str | Column, period: float, harmonics: int = 1) -> dict[str, Column]:
    """``sin_k`` / ``cos_k`` of ``2 pi k value / period``."""
    out: dict[str, Column] = {}
    for k in range(1, harmonics + 1):
        angle = col(value) * (2 * math.pi * k / period)
        out[f"sin_{k}"], out[f"cos_{k}"] = F.sin(angle), F.cos(angle)
    return out


def share_of_days(first: str | Column, n_days: Column | int, test) -> Column:
    """Share of ``n_days`` local days from ``first`` for which ``test(date)`` holds."""
    n = F.greatest(n_days if isinstance(n_days, Column) else F.lit(n_days), F.lit(1)).cast("int")
    days = F.sequence(F.lit(0), n - 1)
    hits = F.aggregate(
        days, F.lit(0),
        lambda acc, k: acc + F.when(test(F.date_add(col(first).cast("date"), k)), 1).otherwise(0))
    return hits / n


def iso_week_date(year: Column, week: Column, weekday: Column) -> Column:
    """Date of an ISO week and weekday (Mon=0); week 53 of a 52-week year becomes week 52."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    return F.date_add(monday, ((F.least(week, last_week) - 1) * 7 + weekday).cast("int"))
