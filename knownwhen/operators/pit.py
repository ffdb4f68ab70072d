"""Point-in-time features: what was published by an origin, and only that."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..session import cut_lineage
from . import ordered as O
from .asof import asof_join, span_sums

_ROW = "_kw_pit_row"


def pit_last(series: DataFrame, origins: DataFrame, pub: str, origin: str, by: Sequence[str],
             columns: Mapping[str, str], ties: Sequence[str] = (), chunk: str | int = "1 day") -> DataFrame:
    """Last published row at each origin (publication at the origin counts)."""
    return asof_join(origins, series, origin, pub, by, columns, ties, chunk=chunk)


def pit_lookback(series: DataFrame, origins: DataFrame, by: Sequence[str], ts: str, pub: str, origin: str,
                 features: Mapping[str, tuple[str, Column]], n: int, min_count: int,
                 weights: Mapping[str, Column] | None = None, chunk: str | int = "1 day") -> DataFrame:
    """Aggregates of the ``n`` latest rows published by each origin, per series.

    ``features`` maps an output to (mean | sum | vwmean | max | min, column). A window with
    fewer than ``min_count`` usable values is NULL. ``pub`` must not decrease along ``ts``
    (see :func:`publication_breaks`). Sums and means are differences of prefix sums taken at
    two row numbers; extremes are moving frames over bounded pieces of the series.
    """
    origins_once = origins.select(*by, origin).distinct()
    sums: dict[str, Column] = {_ROW: F.lit(1).cast("long")}
    for name, (kind, c) in features.items():
        usable = c.isNotNull()
        if kind == "vwmean":
            usable = usable & weights[name].isNotNull()
            sums[f"{name}__w"] = F.when(usable, weights[name].cast("double"))
            sums[f"{name}__s"] = F.when(usable, c.cast("double") * weights[name])
        else:
            sums[f"{name}__s"] = F.when(usable, c.cast("double"))
        sums[f"{name}__c"] = F.when(usable, F.lit(1).cast("long"))
    rows = O.running(series, by, ts, sums, chunk=chunk)
    extremes = {name: (F.max if kind == "max" else F.min)(c) for name, (kind, c) in features.items()
                if kind in ("max", "min")}
    if extremes:
        rows = O.rolling_rows(rows, by, ts, {f"{k}__x": e for k, e in extremes.items()}, n, F.lit(1), index=_ROW)
    # The prefix table is looked up at both ends of every window: compute it once.
    rows = cut_lineage(rows.select(*by, pub, *sums, *[f"{k}__x" for k in extremes]))
    measures = [c for c in [*sums, *[f"{k}__x" for k in extremes]] if c != _ROW]
    upper = asof_join(origins_once, rows, origin, pub, by,
                      {_ROW: _ROW, **{c: c for c in measures}}, ties=[_ROW], chunk=chunk)
    additive = [c for c in measures if not c.endswith("__x")]
    lower = rows.select(*by, (F.col(_ROW) + n).alias(_ROW), *[F.col(c).alias(f"{c}0") for c in additive])
    both = upper.transform(match, lower, [*by, _ROW], "left")
    out: list[Column] = []
    for name, (kind, _) in features.items():
        def part(suffix: str) -> Column:
            return F.col(f"{name}__{suffix}") - F.coalesce(F.col(f"{name}__{suffix}0"), F.lit(0))

        count = part("c")
        if kind == "mean":
            value = part("s") / F.nullif(count, F.lit(0))
        elif kind == "sum":
            value = part("s")
        elif kind == "vwmean":
            value = part("s") / F.nullif(part("w"), F.lit(0))
        else:
            value = F.col(f"{name}__x")
        out.append(F.when((count >= min_count) & (count > 0), value).alias(name))
    result = both.select(*by, origin, *out)
    return origins.transform(match, result, [*by, origin], "left")


def event_window(events: DataFrame, origins: DataFrame, by: Sequence[str], ts: str, origin: str,
                 width: str | int, price: Column, volume: Column, chunk: str | int = "1 day") -> DataFrame:
    """Volume-weighted mean and volume of the events executed in ``(origin - width, origin]``."""
    w = origins.withColumn("_kw_from", T.plus(origin, -T.span(width)))
    usable = price.isNotNull() & volume.isNotNull()
    sums = {"_kw_pv": F.when(usable, (price * volume).cast("double")), "_kw_v": F.when(usable, volume.cast("double")),
            "n_events": F.when(usable, F.lit(1).cast("double"))}
    out = span_sums(w, events, "_kw_from", origin, ts, by, sums, chunk=chunk)
    some = F.col("n_events") > 0
    return out.withColumns({
        "vwap": F.when(some, F.col("_kw_pv") / F.nullif(F.col("_kw_v"), F.lit(0.0))),
        "volume": F.when(some, F.col("_kw_v")).otherwise(F.lit(0.0)),
        "n_events": F.col("n_events").cast("long")}).drop("_kw_from", "_kw_pv", "_kw_v")


def lag_join(df: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str], days: Sequence[int]) -> DataFrame:
    """Value of the same slot exactly n days earlier, by equality on the shifted time.

    All lags travel in one join: each row announces itself to the times that will ask for it.
    """
    ahead = df.select(*by, F.explode(F.array(*[F.lit(d) for d in days])).alias("_kw_d"), ts, *cols)
    ahead = ahead.withColumn(ts, T.plus(ts, F.col("_kw_d").cast("long") * T.DAY))
    aggs = [F.max(F.when(F.col("_kw_d") == d, F.col(c))).alias(f"{c}__lag{d}d") for d in days for c in cols]
    return df.transform(match, ahead.groupBy(*by, ts).agg(*aggs), [*by, ts], "left")


def freshest_lead(cube: DataFrame, needs: DataFrame, keys: Sequence[str], hour: str, lead: str, value: str,
                  coverage: str, origin: str, lag: str | int, min_coverage: float = 0.9) -> DataFrame:
    """Per needed (hour, origin): value of the smallest lead published by the origin.

    A lead of K days is published at ``hour - K days + lag``; leads without a value or with too
    little coverage are skipped. Hours without an admissible lead stay as NULL.
    """
    usable = cube.where(F.col(value).isNotNull() & (F.col(coverage) >= min_coverage)).select(
        *keys, hour, lead, value, T.plus(hour, T.span(lag) - F.col(lead).cast("long") * T.DAY).alias("_kw_pub"))
    pairs = needs.select(*keys, hour, origin).distinct().transform(match, usable, [*keys, hour])
    best = (pairs.where(F.col("_kw_pub") <= F.col(origin)).groupBy(*keys, hour, origin)
            .agg(F.min_by(value, lead).alias(value), F.min(lead).alias("lead_used")))
    return needs.transform(match, best, [*keys, hour, origin], "left")


def complete_blocks(df: DataFrame, keys: Sequence[str], value: str, how: str = "mean") -> DataFrame:
    """Block value only if every row of the block has one; also the largest lead used."""
    agg = F.sum(value) if how == "sum" else F.avg(value)
    full = F.count(value) == F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.when(full, agg).alias(value), F.when(full, F.max("lead_used")).alias("lead_max"))


def lagged_targets(blocks: DataFrame, by: Sequence[str], slot: str, start: str, origin: str, known: str,
                   cols: Sequence[str], chunk: str | int = "30 days") -> DataFrame:
    """Same-slot value of the latest known auction, and the mean of the latest known auction."""
    right = blocks.select(*by, slot, known, start, *cols)
    out = asof_join(blocks, right, origin, known, [*by, slot], {c: f"prev_slot__{c}" for c in cols},
                    ties=[start], chunk=chunk)
    out = cut_lineage(out)
    auctions = blocks.groupBy(*by, known).agg(*[F.avg(c).alias(c) for c in cols])
    return asof_join(out, auctions, origin, known, by, {c: f"prev_auction__{c}" for c in cols}, chunk=chunk)


def cross_market(daily: DataFrame, slots: DataFrame, origins: DataFrame, by: Sequence[str], day: str, slot: str,
                 value: str, known: Column, origin: str, days: int = 7, min_days: int = 4,
                 stale: str | int = "3 days", chunk: str | int = "30 days") -> DataFrame:
    """Latest delivery day of another market known at the origin: mean, same slot, mean of the last days.

    ``daily`` has one row per day, ``slots`` one per (day, slot); everything is NULL once the
    latest known day is older than ``stale``.
    """
    roll = O.rolling_time(daily, by, day, {"lb": F.avg(value)}, days - 1, 0,
                          min_count={"lb": (F.col(value), min_days)})
    roll = roll.withColumn("known_at", known)
    out = asof_join(origins, roll, origin, "known_at", by,
                    {value: "prevday", "lb": f"lb{days}d", day: "_kw_day", "known_at": "known_at"},
                    tolerance=stale, chunk=chunk)
    same = slots.select(*by, F.col(day).alias("_kw_day"), slot, F.col(value).alias("prevday_slot"))
    return out.transform(match, same, [*by, "_kw_day", slot], "left").drop("_kw_day")


def publication_breaks(df: DataFrame, by: Sequence[str], ts: str, pub: str, chunk: str | int = "1 day") -> DataFrame:
    """Rows whose publication time lies before that of an earlier row (must be empty)."""
    rows = O.previous(df, by, ts, {"_kw_before": pub}, chunk=chunk)
    return rows.where(F.col(pub) < F.col("_kw_before")).drop("_kw_before")


def leaks(df: DataFrame, known: str, origin: str) -> DataFrame:
    """Rows that use a value known only after their origin (must be empty)."""
    return df.where(F.col(known) > F.col(origin))


def assert_no_leakage(df: DataFrame, known: str, origin: str) -> None:
    if not leaks(df, known, origin).isEmpty():
        raise ValueError(f"{known} lies after {origin}")


def slot_statistics(events: DataFrame, by: Sequence[str], slot: str, executed: str, price: str, volume: str,
                    cutoff: Column | None = None) -> DataFrame:
    """Volume-weighted mean, volume, count, last, high and low per slot of the events known by a cutoff."""
    from ..functions.numeric import vwmean

    rows = events.where(F.col(volume) > 0)
    if cutoff is not None:
        rows = rows.where(F.col(executed) <= cutoff)
    return rows.groupBy(*by, slot).agg(
        vwmean(price, volume).alias("vwap"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("n"),
        F.max_by(price, F.struct(executed, price)).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"))
