"""As-of joins and prefix look-ups between two tables, in one chunked pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import order_key, key_width
from . import ordered as O

_SIDE, _TIE, _LEFT, _RIGHT, _AT = "_kw_side", "_kw_tie", "_kw_left", "_kw_right", "_kw_at"


def _stack(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str],
           payload: Sequence[str], ties: Sequence[str], chunk: str | int) -> DataFrame:
    """Both tables on one axis; at equal times right rows come first."""
    keys = [F.col(c) for c in by]
    tie = F.struct(F.lit(0).alias("kw"), *[F.col(t) for t in ties])
    width = key_width(right, right_on, chunk)
    right = right.where(F.col(right_on).isNotNull())
    r = right.select(*keys, order_key(right, right_on).alias(_AT), F.lit(0).alias(_SIDE), tie.alias(_TIE),
                     F.struct(*payload).alias(_RIGHT))
    l = left.select(*keys, order_key(left, left_on).alias(_AT), F.lit(1).alias(_SIDE),
                    F.struct(*left.columns).alias(_LEFT))
    return O.keyed(l.unionByName(r, allowMissingColumns=True), by, _AT, width)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
              by: Sequence[str] = (), columns: Mapping[str, str] | None = None,
              ties: Sequence[str] = (), tolerance: str | int | None = None,
              strict: bool = False, chunk: str | int = "1 day") -> DataFrame:
    """Latest right row at or before each left row (``strict``: before), per ``by`` key.

    ``columns`` maps right columns to output names. Right rows with equal times are ordered
    by ``ties``, the last one wins. With ``tolerance``, older matches become NULL. All left rows are
    kept exactly once.
    """
    columns = dict(columns or {c: c for c in right.columns if c not in by})
    payload = list(dict.fromkeys([*columns, right_on]))
    rows = _stack(left, right, left_on, right_on, by, payload, ties, chunk)
    if strict:
        rows = rows.withColumn(_SIDE, 1 - F.col(_SIDE))
    is_right = F.col(_RIGHT).isNotNull()
    rows = O.inherit(
        rows, {"_kw_edge": F.max_by(_RIGHT, F.when(is_right, F.struct(O.KEY, _TIE)))},
        lambda earlier, _: {"_kw_edge": F.last("_kw_edge", ignorenulls=True).over(earlier)})
    frame = O.inside([_SIDE, _TIE]).rowsBetween(O.UNBOUNDED, 0)
    found = F.coalesce(F.last(_RIGHT, ignorenulls=True).over(frame), F.col("_kw_edge"))
    rows = rows.withColumn("_kw_found", F.when(F.col(_AT).isNotNull(), found)).where(F.col(_LEFT).isNotNull())
    match = F.col("_kw_found")
    out = rows.select(f"{_LEFT}.*", F.col(_AT), match.alias("_kw_found"))
    if tolerance is not None:
        flat = out.withColumn("_kw_seen", F.col("_kw_found")[right_on])
        near = (F.col(_AT) - order_key(flat, "_kw_seen")) <= key_width(right, right_on, tolerance)
        out = flat.withColumn("_kw_found", F.when(near, F.col("_kw_found"))).drop("_kw_seen")
    return out.withColumns({n: F.col("_kw_found")[c] for c, n in columns.items()}).drop("_kw_found", _AT)


def prefix_at(points: DataFrame, events: DataFrame, at: str, ts: str, by: Sequence[str],
              sums: Mapping[str, Column], chunk: str | int = "1 day") -> DataFrame:
    """Adds to each point the sums over all events of its series with time <= ``at``.

    One running pass over the union of both tables; differences of two points give sums over
    half-open spans ``(from, to]`` without any range join.
    """
    ev = events.select("*", *[e.alias(f"_kw_m_{n}") for n, e in sums.items()])
    measured = [f"_kw_m_{n}" for n in sums]
    rows = _stack(points, ev, at, ts, by, measured, (), chunk)
    rows = O.accumulate(rows, {n: F.col(_RIGHT)[f"_kw_m_{n}"] for n in sums}, [_SIDE])
    return rows.where(F.col(_LEFT).isNotNull()).select(f"{_LEFT}.*", *sums)


def span_sums(windows: DataFrame, events: DataFrame, start: str, end: str, ts: str,
              by: Sequence[str], sums: Mapping[str, Column], closed: str = "right",
              chunk: str | int = "1 day") -> DataFrame:
    """Sums of the events inside each window, ``(start, end]`` or ``[start, end)``.

    Windows are first reduced to their distinct bounds; both bounds ride in the same pass.
    """
    shift = 0 if closed == "right" else -1
    keys = list(by)
    distinct = windows.select(*keys, start, end).distinct()
    bounds = distinct.select(*keys, start, end, F.explode(F.array(
        F.struct((order_key(windows, start) + shift).alias("at"), F.lit(-1.0).alias("sign")),
        F.struct((order_key(windows, end) + shift).alias("at"), F.lit(1.0).alias("sign")))).alias("_kw_pick"))
    bounds = bounds.select(*keys, start, end, F.col("_kw_pick.at").alias("_kw_bound"), F.col("_kw_pick.sign").alias("_kw_sign"))
    ev = events.withColumn("_kw_time", order_key(events, ts))
    width = key_width(events, ts, chunk)
    at = prefix_at(bounds, ev, "_kw_bound", "_kw_time", by, sums, width)
    diff = at.groupBy(*keys, start, end).agg(*[F.sum(F.col(n) * F.col("_kw_sign")).alias(n) for n in sums])
    cond = None
    for c in [*keys, start, end]:
        term = windows[c].eqNullSafe(diff[c])
        cond = term if cond is None else cond & term
    out = windows.join(diff, cond, "left")
    for c in [*keys, start, end]:
        out = out.drop(diff[c])
    return out
