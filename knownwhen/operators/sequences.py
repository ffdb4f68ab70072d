"""Runs, episodes, clusters, interpolation, thresholds, decumulation and decay."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions.keys import match
from ..functions import timeaxis as T
from ..session import cut_lineage
from . import ordered as O
from .lags import lagged_sums
from .ranks import quantiles


def mark_runs(df: DataFrame, by: Sequence[str], order: str, pred: Column, name: str = "run",
              chunk: str | int = "1 day", ties: Sequence[str] = ()) -> DataFrame:
    """Adds a run number to the rows for which the predicate holds (NULL elsewhere).

    All rows of a run follow the same last row on which the predicate did not hold, so the
    number of such rows so far identifies the run: one running count, no look at neighbours.
    A NULL predicate ends a run.
    """
    on = F.coalesce(pred, F.lit(False))
    rows = O.running(df.withColumn("_kw_on", on), by, order, {name: (~F.col("_kw_on")).cast("long")}, ties, chunk)
    return rows.withColumn(name, F.when(F.col("_kw_on"), F.col(name))).drop("_kw_on")


def episodes(df: DataFrame, by: Sequence[str], order: str, pred: Column, measures: Sequence[Column] = (),
             chunk: str | int = "1 day") -> DataFrame:
    """One row per run: start, end, length and measures."""
    rows = mark_runs(df, by, order, pred, "_kw_run", chunk).where(F.col("_kw_run").isNotNull())
    return rows.groupBy(*by, "_kw_run").agg(F.min(order).alias("start"), F.max(order).alias("end"),
                                            F.count(F.lit(1)).alias("length"), *measures).drop("_kw_run")


def label_episodes(df: DataFrame, by: Sequence[str], order: str, pred: Column, chunk: str | int = "1 day") -> DataFrame:
    """Adds ``episode_start``, ``episode_length`` and ``is_start`` to every row.

    The first and last rows of a run are known from their neighbours; every row looks up the nearest of each and
    subtracts their numbers, so nothing is joined on a run.
    """
    rows = df.withColumn("_kw_on", F.coalesce(pred, F.lit(False)))
    rows = O.scan(rows, by, order, before={"_kw_p": "_kw_on"}, after={"_kw_n": "_kw_on"}, sums={"_kw_i": F.lit(1).cast("long")}, chunk=chunk)
    edge = lambda near, *cols: F.when(F.col("_kw_on") & ~F.coalesce(near, F.lit(False)), F.struct(*cols))
    rows = O.scan(rows, by, order, last={"_kw_first": edge(F.col("_kw_p"), F.col("_kw_i"), F.col(order).alias("at"))},
                  upcoming={"_kw_last": edge(F.col("_kw_n"), F.col("_kw_i"))}, chunk=chunk)
    inside = lambda c: F.when(F.col("_kw_on"), c)
    out = rows.withColumns({"episode_start": inside(F.col("_kw_first")["at"]),
                            "episode_length": inside(F.col("_kw_last")["_kw_i"] - F.col("_kw_first")["_kw_i"] + 1)})
    out = out.drop("_kw_on", "_kw_p", "_kw_n", "_kw_i", "_kw_first", "_kw_last")
    return out.withColumn("is_start", F.coalesce(F.col("episode_start") == F.col(order), F.lit(False)))


def null_runs(df: DataFrame, by: Sequence[str], order: str, column: str, min_length: int = 1,
              chunk: str | int = "1 day") -> DataFrame:
    """Runs of missing values strictly between the first and the last value of a series."""
    span = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.min(order).alias("_kw_a"), F.max(order).alias("_kw_b"))
    rows = df.transform(match, span, list(by)).where((F.col(order) >= F.col("_kw_a")) & (F.col(order) <= F.col("_kw_b")))
    out = episodes(rows, by, order, F.col(column).isNull(), chunk=chunk)
    return out.where(F.col("length") >= min_length)


def interpolate(df: DataFrame, by: Sequence[str], start: str, end: str | Column, columns: Sequence[str],
                max_span: str | int, chunk: str | int = "7 days") -> DataFrame:
    """Linear interpolation in time of interior gaps that span at most ``max_span``.

    The span runs from the start of the first missing interval to the end of the last one.
    Values that exist are never changed; ``<column>_imputed`` marks what was filled.
    """
    rows = df.withColumn("_kw_end", end if isinstance(end, Column) else F.col(end))
    # A value also remembers where the row after it starts and where the row before it ends:
    # these bound the gap on either side of it.
    rows = O.scan(rows, by, start, before={"_kw_gap_end": "_kw_end"}, after={"_kw_gap_start": start}, chunk=chunk)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(
        F.col(start).alias("t"), F.col(c).cast("double").alias("v"), F.col("_kw_gap_start").alias("opens"),
        F.col("_kw_gap_end").alias("closes"))) for c in columns}
    rows = O.scan(rows, by, start, last={f"_kw_lo_{c}": e for c, e in known.items()},
                  upcoming={f"_kw_hi_{c}": e for c, e in known.items()}, chunk=chunk)
    cols = {}
    for c in columns:
        lo, hi = F.col(f"_kw_lo_{c}"), F.col(f"_kw_hi_{c}")
        span = T.micros(hi["closes"]) - T.micros(lo["opens"])
        fill = F.coalesce(F.col(c).isNull() & (span <= T.span(max_span)), F.lit(False))
        part = (T.micros(start) - T.micros(lo["t"])) / F.nullif(T.micros(hi["t"]) - T.micros(lo["t"]), F.lit(0))
        cols[c] = F.when(fill, lo["v"] + (hi["v"] - lo["v"]) * part).otherwise(F.col(c))
        cols[f"{c}_imputed"] = fill
    return rows.withColumns(cols).drop("_kw_end", "_kw_gap_start", "_kw_gap_end",
                                       *[f"_kw_{x}_{c}" for c in columns for x in ("lo", "hi")])


def _counted(df: DataFrame, by: Sequence[str], day: str, value: str, days: int) -> DataFrame:
    """Count tables: (series, chunk, day, value, n, own), a row for each day and different value of it, in every chunk that sees it.

    Equal values of a day are one row from the first exchange on, so a series of few different values shrinks to them.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, F.unix_date(F.col(day).cast("date")).cast("long").alias("_kw_day"), x.alias("_kw_x"))
    cells = rows.groupBy(*by, "_kw_day", "_kw_x").agg(F.count("_kw_x").alias("_kw_n"))
    return O.halo(cells, by, "_kw_day", days, 0, 4 * days).select(O.GROUP, O.CHUNK, F.col(O.KEY).alias("day"), F.col("_kw_x").alias("x"), F.col("_kw_n").alias("n"), F.col(O.OWN).alias("own"))


def _windows(day: np.ndarray, x: np.ndarray, n: np.ndarray, wanted: np.ndarray, days: int):
    """For each wanted day: (number of values of the ``days`` days before it, function from a rank to the value of that rank).

    One running table of counts per different value takes in the days that enter and gives back those that leave; a rank is
    found by bisection in its running sums.
    """
    order = np.argsort(day, kind="stable")
    order = order[n[order] > 0]
    day, n = day[order], n[order]
    values, code = np.unique(x[order], return_inverse=True)
    table, enter, leave = np.zeros(len(values), np.int64), 0, 0
    for d in wanted:
        to, out = np.searchsorted(day, d), np.searchsorted(day, d - days)
        np.add.at(table, code[enter:to], n[enter:to])
        np.subtract.at(table, code[leave:out], n[leave:out])
        enter, leave = max(enter, to), max(leave, out)
        sums = np.cumsum(table)
        yield int(sums[-1]) if len(sums) else 0, lambda r, sums=sums: float(values[np.searchsorted(sums, r, side="right")])


def _between(pick, n: int, q: float) -> float:
    """Quantile of ``n`` ranked values, linear between neighbours."""
    at = (n - 1) * q
    low = math.floor(at)
    return pick(low) if at == low else (low + 1 - at) * pick(low) + (at - low) * pick(low + 1)


def _distance(pick, n: int, centre: float):
    """Function from a rank to the distance of that rank from ``centre``: the nearest r + 1 values are neighbours in rank, and bisection finds the first."""
    def nearest(r: int) -> float:
        low, high = 0, n - 1 - r
        while low < high:
            mid = (low + high) // 2
            if centre - pick(mid) > pick(mid + r + 1) - centre:
                low = mid + 1
            else:
                high = mid
        return max(centre - pick(low), pick(low + r) - centre)

    return nearest


def _per_day(tables: DataFrame, days: int, names: Sequence[str], measure) -> DataFrame:
    """(GROUP, day, n_past, *names) for the days that a chunk owns; ``measure(n, pick)`` gives the values."""
    schema = T_.StructType([tables.schema[O.GROUP], T_.StructField("day", T_.LongType()), T_.StructField("n_past", T_.LongType()), *[T_.StructField(c, T_.DoubleType()) for c in names]])

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        day = table.column("day")
        if day.null_count:  # rows without a day have no past
            found = [(None, 0, *[None] * len(names))]
        else:
            day, x, n = day.to_numpy(), table.column("x").to_numpy(), table.column("n").to_numpy()
            wanted = np.unique(day[own])
            found = [(int(d), size, *measure(size, pick)) for d, (size, pick) in zip(wanted, _windows(day, x, n, wanted, days))]
        key = table.column(O.GROUP).combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        columns = list(zip(*found)) if found else [[]] * (2 + len(names))
        return pa.Table.from_arrays([key, *[pa.array(c, pa.int64()) for c in columns[:2]], *[pa.array(c, pa.float64()) for c in columns[2:]]], [O.GROUP, "day", "n_past", *names])

    return tables.groupBy(O.GROUP, O.CHUNK).applyInArrow(run, schema)


def rolling_thresholds(df: DataFrame, by: Sequence[str], day: str, value: str, qs: Mapping[str, float], days: int,
                       min_count: int) -> DataFrame:
    """Quantiles of the values of the ``days`` days before each day, one row per (series, day).

    A task holds the count tables of 4 * ``days`` days of one series and their window, never the rows behind them.
    """
    def measure(n, pick):
        return [_between(pick, n, q) if n >= max(min_count, 1) else None for q in qs.values()]

    out = _per_day(_counted(df, by, day, value, days), days, list(qs), measure)
    return out.select(*[F.col(f"{O.GROUP}.{c}").alias(c) for c in by], F.date_from_unix_date(F.col("day").cast("int")).alias(day), *qs, "n_past")


def robust_stats(df: DataFrame, by: Sequence[str], day: str, value: str, days: int, min_count: int) -> DataFrame:
    """Median and scaled MAD (1.4826 x) of the values of the ``days`` days before each day, by the same count tables."""
    def measure(n, pick):
        if n < max(min_count, 1):
            return None, None
        median = _between(pick, n, 0.5)
        return median, 1.4826 * _between(_distance(pick, n, median), n, 0.5)

    out = _per_day(_counted(df, by, day, value, days), days, ["median", "mad"], measure)
    return out.select(*[F.col(f"{O.GROUP}.{c}").alias(c) for c in by], F.date_from_unix_date(F.col("day").cast("int")).alias(day), "median", "mad")


def spikes(df: DataFrame, value: str, threshold: Column, above: bool, single: Column | None = None,
           signed: str | None = None) -> Column:
    """Three-valued exceedance: NULL if undecidable, 0 if the side rule contradicts, else 0 / 1.

    Under a ``single`` price the sign of ``signed`` must match the side: negative for
    exceedance above, positive for exceedance below.
    """
    beyond = F.col(value) > threshold if above else F.col(value) < threshold
    out = beyond.cast("int")
    unknown = F.col(value).isNull() | threshold.isNull()
    if single is not None:
        match = F.signum(F.col(signed)) == (-1 if above else 1)
        out = F.when(single & ~match, F.lit(0)).otherwise(out)
        unknown = unknown | (single & F.col(signed).isNull())
    return F.when(~unknown, out)


def climatology(df: DataFrame, cell: Sequence[str], order: str, outcome: str, window: int = 150, min_periods: int = 20,
                by: Sequence[str] = (), chunk: str | int = "7 days", bounds: tuple[float, float] = (1e-4, 1 - 1e-4)) -> DataFrame:
    """Past-only frequency of an outcome per cell: expanding and over the last ``window`` rows.

    Falls back to the expanding frequency over all cells, and on the first row to the overall mean.
    """
    from ..functions.numeric import clip

    y = F.col(outcome).cast("double")
    one = F.when(y.isNotNull(), F.lit(1.0))
    rows = O.running(df, by, order, {"_kw_ps": y, "_kw_pn": one}, ties=cell, chunk=chunk)
    rows = O.running(rows, [*by, *cell], order, {"_kw_cs": y, "_kw_cn": one, "_kw_i": F.lit(1).cast("long")}, chunk=chunk)
    rows = O.rolling_rows(rows, [*by, *cell], order, {"_kw_roll": F.avg(y)}, window, y, min_periods, skip=1, index="_kw_i")
    overall = df.groupBy(*by).agg(F.avg(y).alias("_kw_all")) if by else df.agg(F.avg(y).alias("_kw_all"))
    rows = rows.transform(match, overall, list(by)) if by else rows.join(F.broadcast(overall))
    own_s, own_n = F.coalesce(y, F.lit(0.0)), F.coalesce(one, F.lit(0.0))      # the sums include the row itself
    zero = F.lit(0.0)
    prior = F.coalesce((F.col("_kw_ps") - own_s) / F.nullif(F.col("_kw_pn") - own_n, zero), F.col("_kw_all"))
    expanding = F.coalesce((F.col("_kw_cs") - own_s) / F.nullif(F.col("_kw_cn") - own_n, zero), prior)
    rolling = F.coalesce(F.col("_kw_roll"), expanding)
    return rows.withColumns({"clim_expanding": clip(expanding, *bounds), "clim_rolling": clip(rolling, *bounds)}).drop(
        "_kw_ps", "_kw_pn", "_kw_cs", "_kw_cn", "_kw_i", "_kw_roll", "_kw_all")


def decumulate(df: DataFrame, by: Sequence[str], order: str, column: str, period: Column, name: str,
               chunk: str | int = "7 days") -> DataFrame:
    """Increments of a counter that restarts every period.

    A missing value at the start of a period counts as 0, a later one as unchanged.
    """
    rows = df.withColumn("_kw_period", period)
    keys = [*by, "_kw_period"]
    rows = O.last_known(rows, keys, order, {"_kw_level": column}, chunk=chunk)
    rows = rows.withColumn("_kw_level", F.coalesce(F.col("_kw_level"), F.lit(0.0)))
    rows = O.previous(rows, keys, order, {"_kw_before": "_kw_level"}, chunk=chunk)
    return rows.withColumn(name, F.col("_kw_level") - F.coalesce(F.col("_kw_before"), F.lit(0.0))).drop(
        "_kw_period", "_kw_level", "_kw_before")


def decluster(df: DataFrame, by: Sequence[str], order: str, value: str, threshold: Column, run: int,
              chunk: str | int = "7 days") -> DataFrame:
    """Clusters of exceedances: a new one begins after more than ``run`` rows without exceedance.

    Returns start, end, exceedances, the peak excess, and value and threshold at the (first) peak.
    """
    rows = O.row_index(df, by, order, "_kw_pos", chunk=chunk)
    excess = F.col(value).cast("double") - threshold
    rows = rows.withColumns({"_kw_excess": excess, "_kw_thr": threshold}).where(F.col("_kw_excess") > 0)
    rows = cut_lineage(rows.select(*by, order, value, "_kw_pos", "_kw_excess", "_kw_thr"))      # few rows from here on
    rows = O.previous(rows, by, order, {"_kw_last": "_kw_pos"}, chunk=chunk)
    fresh = F.col("_kw_last").isNull() | (F.col("_kw_pos") - F.col("_kw_last") > run)
    rows = O.running(rows, by, order, {"_kw_cluster": fresh.cast("long")}, chunk=chunk)
    peak = F.struct(F.col("_kw_excess"), (-F.col("_kw_pos")).alias("first"))
    return rows.groupBy(*by, "_kw_cluster").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n_exceed"),
        F.max("_kw_excess").alias("excess"), F.max_by("_kw_thr", peak).alias("threshold"),
        F.max_by(value, peak).alias("peak")).drop("_kw_cluster")


def _decayed(rows: DataFrame, log_d: float, chunk: int) -> DataFrame:
    """(GROUP, _kw_i, _kw_n), numbered from 0 without holes -> the same with ``_kw_s``: ``s[i] = d s[i-1] + n[i-1]``, ``s[0] = 0``.

    A chunk of rows maps the state at its first row to the state after its last: ``s -> factor * s + offset``. Such maps compose to maps
    of the same kind, and all full chunks share one factor, so the states at the borders obey the same recurrence over
    chunks, with ``d^span`` for ``d``, and are found by the same function, on ``span`` times fewer rows. Inside a chunk the state is a
    weighted prefix sum, whose weights stay in range because exponents are measured from the border.
    """
    span = max(1, min(chunk, int(600 / abs(log_d))))
    keyed = rows.withColumn(O.CHUNK, T.floor_div(F.col("_kw_i"), span))
    at = F.col("_kw_i") - F.col(O.CHUNK) * span
    offsets = cut_lineage(keyed.groupBy(O.GROUP, O.CHUNK).agg(F.sum(F.col("_kw_n") * F.exp((span - 1 - at) * log_d)).alias("_kw_n")))
    step = span * log_d
    if abs(step) < 40:
        border = _decayed(offsets.withColumnRenamed(O.CHUNK, "_kw_i"), step, max(chunk, 16)).select(O.GROUP, F.col("_kw_i").alias(O.CHUNK), F.col("_kw_s").alias("_kw_border"))
    else:  # a factor below 1e-17: what a chunk leaves is gone after a few more
        reach = int(700 / abs(step)) + 1
        ahead = offsets.select(O.GROUP, "_kw_n", F.col(O.CHUNK).alias("_kw_from"), F.explode(F.sequence(F.col(O.CHUNK) + 1, F.col(O.CHUNK) + reach)).alias(O.CHUNK))
        border = ahead.groupBy(O.GROUP, O.CHUNK).agg(F.sum(F.col("_kw_n") * F.exp((F.col(O.CHUNK) - F.col("_kw_from") - 1) * step)).alias("_kw_border"))
    before = Window.partitionBy(O.GROUP, O.CHUNK).orderBy("_kw_i").rowsBetween(O.UNBOUNDED, -1)
    inner = F.sum(F.col("_kw_n") * F.exp(-(at + 1) * log_d)).over(before)
    state = F.exp(at * log_d) * (F.coalesce(inner, F.lit(0.0)) + F.coalesce(F.col("_kw_border"), F.lit(0.0)))
    return keyed.join(border, [O.GROUP, O.CHUNK], "left").withColumn("_kw_s", state).drop(O.CHUNK, "_kw_border")


def decay_state(df: DataFrame, by: Sequence[str], order: str, event: str, half_life: float, name: str = "state",
                chunk: int = 4096, rows_chunk: str | int = "1 day") -> DataFrame:
    """``S[t] = d S[t-1] + N[t-1]`` with ``d = 2^(-1/half_life)``, ``S`` = 0 on the first row.

    No row is copied, whatever the half-life: see ``_decayed``.
    """
    rows = O.row_index(df, by, order, "_kw_i", chunk=rows_chunk)
    rows = rows.withColumns({"_kw_i": F.col("_kw_i") - 1, O.GROUP: O.group_key(by), "_kw_n": F.coalesce(F.col(event).cast("double"), F.lit(0.0))})
    return O.unkeyed(_decayed(rows, -math.log(2) / half_life, chunk).withColumnRenamed("_kw_s", name).drop("_kw_i", "_kw_n"))


def acf(df: DataFrame, by: Sequence[str], order: str, value: str, lags: Sequence[int], chunk: str | int = "30 days") -> DataFrame:
    """Autocorrelation with the common mean and variance: lagged products of the demeaned values, taken inside chunks."""
    rows = O.row_index(df.where(F.col(value).isNotNull()), by, order, "_kw_i", chunk=chunk)
    mean = rows.groupBy(*by).agg(F.avg(value).alias("_kw_m"))
    rows = rows.transform(match, mean, list(by)).select(*by, "_kw_i", (F.col(value) - F.col("_kw_m")).alias("x"))
    sums = lagged_sums(rows, by, "_kw_i", ["x"], sorted({0, *lags}))
    power = sums.where("lag = 0").select(*by, F.col("s")[0].alias("_kw_v"))
    return (sums.where(F.col("lag").isin(*lags)).transform(match, power, list(by))
            .select(*by, "lag", (F.col("s")[0] / F.nullif(F.col("_kw_v"), F.lit(0.0))).alias("acf")))


def break_dates(df: DataFrame, by: Sequence[str], order: str, flags: Sequence[str], chunk: str | int = "365 days") -> DataFrame:
    """First row at which a label takes a new value; missing labels are skipped."""
    long = df.select(*by, order, *[F.col(f).cast("string").alias(f) for f in flags]).unpivot([*by, order], list(flags), "flag", "label")
    rows = O.previous(long.where(F.col("label").isNotNull()), [*by, "flag"], order, {"before": "label"}, chunk=chunk)
    return rows.where(F.col("before").isNotNull() & (F.col("label") != F.col("before"))).select(
        *by, "flag", F.col(order).alias("break_at"), "before", F.col("label").alias("after"))


def episode_catalogue(eps: DataFrame, by: Sequence[str], length: str = "length") -> DataFrame:
    """Number, median and longest length per label."""
    n = eps.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"), F.max(length).alias("longest"))
    return n.transform(match, quantiles(eps, by, length, {"median_length": 0.5}), list(by))
