"""Arithmetic, comparison and small statistical Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeaxis import col


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def vwmean(value: str | Column, weight: str | Column) -> Column:
    """Weighted mean over the rows where both sides are present; NULL for zero weight."""
    v, w = col(value), col(weight)
    den = F.sum(F.when(v.isNotNull() & w.isNotNull(), w))
    return F.sum(v * w) / F.nullif(den, F.lit(0))


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over the pairs present on both sides; NULL if either side is constant.

    The built-in raises on a constant side in ANSI mode.
    """
    a, b = F.when(col(y).isNotNull(), col(x).cast("double")), F.when(col(x).isNotNull(), col(y).cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def smape_term(y: str | Column, p: str | Column) -> Column:
    den = (F.abs(col(y)) + F.abs(col(p))) / 2
    return F.when(den > 0, F.abs(col(p) - col(y)) / den).otherwise(F.lit(0.0)) * 100


def pinball(y: str | Column, q: str | Column, tau: float | Column) -> Column:
    d = col(y) - col(q)
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    return F.greatest(t * d, (t - 1) * d)


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep NULL as NULL."""
    out = col(c)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def is_close(a: str | Column, b: str | Column, tol: float) -> Column:
    """Equal within ``tol``; two NULLs are equal, one NULL is not."""
    a, b = col(a), col(b)
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tol, F.lit(False))


def row_sum(cols: list[str], min_count: int = 1) -> Column:
    """Sum across columns, NULL when fewer than ``min_count`` of them are present."""
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(present >= min_count, total)


def degree_hours(t: str | Column, heat_below: float = 18.0, cool_above: float = 22.0) -> dict[str, Column]:
    x = col(t)
    return {
        "heating": F.when(x.isNotNull(), F.greatest(F.lit(heat_below) - x, F.lit(0.0))),
        "cooling": F.when(x.isNotNull(), F.greatest(x - F.lit(cool_above), F.lit(0.0))),
        "melt": F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))),
    }


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = (F.pow(F.sin((p2 - p1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def normal_two_sided(z: str | Column) -> Column:
    """Two-sided normal p-value, by the Abramowitz-Stegun 7.1.26 form of erfc (error < 1.5e-7)."""
    x = F.abs(col(z)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the published approximation, highest power last.
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = F.lit(0.0)
    for a in reversed(coefficients):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array of doubles."""
    pos = (F.size(values) - 1) * F.lit(float(q))
    low = F.floor(pos).cast("int")
    a = F.get(values, low)
    b = F.coalesce(F.get(values, low + 1), a)
    return F.when(F.size(values) > 0, a + (b - a) * (pos - low))


def draw(seed: int, size: Column, *parts: Column) -> Column:
    """Reproducible pseudo-random integer in ``[0, size)`` from the first 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), size)
