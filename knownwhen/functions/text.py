"""Text to typed values: numbers, dates, delivery codes and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import iso_week_date
from .timeaxis import HOUR, MICROS, col, local_to_utc, plus

# Texts that mean a missing number.
NULL_TOKENS = ("", "-", "n/a", "n/e", "n.a.", "na", "nan", "none", "null")


def number(c: str | Column, decimal: str = ".", thousands: str = "'",
           null_tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Text to DOUBLE; NULL for null tokens and for anything that does not parse.

    With a decimal comma, dots are thousands separators and must stand before groups of three digits.
    """
    t = F.trim(col(c))
    t = F.when(~F.lower(t).isin(*null_tokens), t)
    t = F.regexp_replace(t, "[" + re.escape(thousands) + "\\u00a0 ]", "")
    if decimal == ",":
        t = F.regexp_replace(t, r"\.(?=\d{3}(?:\D|$))", "")
        t = F.when(~t.contains("."), t)
    if decimal != ".":
        t = F.translate(t, decimal, ".")
    return t.try_cast("double")


def is_null_token(c: str | Column, null_tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return col(c).isNull() | F.lower(F.trim(col(c))).isin(*null_tokens)


def date_any(c: str | Column, formats: list[str]) -> Column:
    """First of several formats that parses."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def delivery_window(code: str | Column, day: str | Column, tz: str) -> dict[str, Column]:
    """UTC ``start`` / ``end`` of a delivery code on a local day.

    Understood codes: ``7`` (hour 7, the seventh), ``3A`` / ``3B`` (first and second pass of
    the repeated autumn hour), ``14qh2`` and ``20hh1`` (quarter and half hours), ``_04_08``
    product suffixes and ``HH:MM bis HH:MM`` ranges.
    """
    c = F.lower(F.trim(col(code)))
    midnight = F.date_trunc("day", col(day)).cast("timestamp_ntz")
    minute = MICROS["minute"]

    def group(pattern: str, g: int) -> Column:
        return F.regexp_extract(c, pattern, g).try_cast("long")

    hour_of, sub, passed = r"^(\d{1,2})(?:[ab])?$", r"^(\d{1,2})([qh]h)(\d)$", r"^(\d{1,2})([ab])$"
    suffix, clock = r"_(\d{2})_(\d{2})$", r"^(\d{2}):(\d{2}) bis (\d{2}):(\d{2})$"
    kind = F.regexp_extract(c, sub, 2)
    slot = F.when(kind == "qh", 15).when(kind == "hh", 30).cast("long")
    start = F.coalesce(
        (group(hour_of, 1) - 1) * HOUR,
        (group(sub, 1) - 1) * HOUR + (group(sub, 3) - 1) * slot * minute,
        group(suffix, 1) * HOUR,
        group(clock, 1) * HOUR + group(clock, 2) * minute)
    length = F.coalesce(
        F.when(c.rlike(hour_of), F.lit(HOUR)),
        F.when(c.rlike(sub), slot * minute))
    wall_end = F.coalesce(
        group(suffix, 2) * HOUR, group(clock, 3) * HOUR + group(clock, 4) * minute)
    wall = plus(midnight, start)
    utc = F.when(F.regexp_extract(c, passed, 2) == "b", local_to_utc(wall, tz, "second"))
    utc = utc.otherwise(local_to_utc(wall, tz, "first"))
    end = F.coalesce(plus(utc, length), local_to_utc(plus(midnight, wall_end), tz, "first"))
    return {"start": utc, "end": end}


def delivery_day(description: str | Column) -> Column:
    """Delivery date in a product description: ``YY_MM_DD`` or ``YYYY_KWnn`` / ``YY_KWnn`` (Monday)."""
    c = col(description)
    day = F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(c, r"(\d{2}_\d{2}_\d{2})", 1)),
                             F.lit("yyyy_MM_dd")).cast("date")
    year = F.regexp_extract(c, r"(\d{2})_KW\d{1,2}", 1).try_cast("int") + 2000
    week = F.regexp_extract(c, r"_KW(\d{1,2})", 1).try_cast("int")
    return F.coalesce(iso_week_date(year, week, F.lit(0)), day)


# ---------------------------------------------------------------- column names
SERVICE_PREFIXES = ("flag", "regime", "src", "eda")  # fixed values


def grammar(areas: list[str], units: list[str], prefixes: tuple[str, ...] = SERVICE_PREFIXES) -> re.Pattern:
    """``{area}_[{area}_]{variable}_{unit}[_xchk_{x}]`` plus prefixed service columns."""
    a = "|".join(sorted(map(re.escape, areas), key=len, reverse=True))
    u = "|".join(sorted(map(re.escape, units), key=len, reverse=True))
    body = (rf"(?P<area>{a})_(?:(?P<area2>{a})_)?(?P<variable>[a-z0-9_]+?)_(?P<unit>{u})"
            rf"(?:_xchk_(?P<xchk>[a-z0-9]+))?")
    service = "|".join(rf"{p}_[a-z0-9_]+" for p in prefixes)
    return re.compile(rf"^(?:{body}|(?P<service>{service}))$")


def check_names(cols: list[str], pattern: re.Pattern, keys: tuple[str, ...] = ("ts_utc", "ts_local")) -> list[str]:
    return [c for c in cols if c not in keys and not pattern.match(c)]


def parse_name(name: str, pattern: re.Pattern) -> dict[str, str | None]:
    """Class, area, variable and unit of a column name."""
    m = pattern.match(name)
    if m is None:
        return {"class": "other", "area": None, "variable": name, "unit": None}
    if m["service"]:
        return {"class": m["service"].split("_", 1)[0], "area": None, "variable": name, "unit": None}
    area = m["area"] if not m["area2"] else f"{m['area']}_{m['area2']}"
    return {"class": "xchk" if m["xchk"] else "data", "area": area,
            "variable": m["variable"], "unit": m["unit"]}


def snake(names: list[str]) -> list[str]:
    """Lower snake case; names that repeat are numbered from ``_2`` until unused. ``(+)``, ``(-)`` and ``%`` become words."""
    umlauts = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
    out: list[str] = []
    wanted = []
    for n in names:
        text = n.lower().translate(umlauts).replace("(+)", " pos ").replace("(-)", " neg ").replace("%", " pct ")
        wanted.append(re.sub(r"[^a-z0-9]+", "_", text).strip("_") or "col")
    for base in wanted:
        name, k = base, 1
        while name in out or (k > 1 and name in wanted):
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out
