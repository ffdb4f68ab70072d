"""Source merging, gap scans, agreement, profiles and validation suites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..functions.numeric import corr, is_close
from ..session import cut_lineage
from . import ordered as O
from .aggregates import dedup
from .grid import steps_between
from .lags import by_chunk
from .ranks import pick_top
from .sequences import episodes, label_episodes
from .shaping import union_all


# ---------------------------------------------------------------- several sources of one quantity
def coalesce_sources(df: DataFrame, name: str, sources: Sequence[tuple[str, str, Column | None]], keep_check: Sequence[str] = ()) -> DataFrame:
    """``name`` from the first usable source, ``src_<name>`` says which one.

    ``sources`` lists (column, label, usable) in priority order; ``usable`` is typically a date
    condition. Columns in ``keep_check`` stay as ``<name>_xchk_<label>``.
    """
    value = F.lit(None)
    label = F.lit(None).cast("string")
    for column, tag, usable in reversed(sources):
        ok = F.col(column).isNotNull() if usable is None else F.col(column).isNotNull() & usable
        value = F.when(ok, F.col(column)).otherwise(value)
        label = F.when(ok, F.lit(tag)).otherwise(label)
    cols = {name: value, f"src_{name}": label}
    cols |= {f"{name}_xchk_{tag}": F.col(c) for c, tag, _ in sources if tag in keep_check}
    return df.withColumns(cols)


def merge_sources(parts: Mapping[str, DataFrame], keys: Sequence[str], coverage: str, min_coverage: float = 0.9) -> DataFrame:
    """One row per key: priority by position, but thin rows lose to any well-covered source."""
    stacked = union_all(list(parts.values()), "source", list(parts))
    position = F.create_map(*[x for i, n in enumerate(parts) for x in (F.lit(n), F.lit(i))])[F.col("source")]
    rank = F.when(F.col(coverage) < min_coverage, 10).otherwise(0) + position
    return dedup(stacked, keys, rank, keep="first")


def replace_copied(df: DataFrame, a: str, b: str, third: str, period: Column, by: Sequence[str] = (), tol: float = 0.5,
                   share: float = 0.9) -> DataFrame:
    """Periods in which ``a`` is a copy of ``b`` take the third source; ``flag_<a>_copied`` marks them."""
    rows = df.withColumn("_kw_period", period)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    equal = F.when(both, (F.abs(F.col(a) - F.col(b)) <= tol).cast("double"))
    copied = rows.groupBy(*by, "_kw_period").agg((F.coalesce(F.avg(equal), F.lit(0.0)) > share).alias("_kw_copied"))
    out = rows.transform(match, copied, [*by, "_kw_period"])
    return out.withColumns({f"flag_{a}_copied": F.col("_kw_copied"), a: F.when(F.col("_kw_copied"), F.col(third)).otherwise(F.col(a))}).drop(
        "_kw_period", "_kw_copied")


def override(df: DataFrame, column: str, better: str, allowed: Column, tol: float = 0.005) -> DataFrame:
    """Takes the better source only where it differs or fills; ``<column>_change`` is changed / filled / NULL."""
    here, there = F.col(column), F.col(better)
    differs = here.isNotNull() & there.isNotNull() & (F.abs(here - there) > tol)
    fills = here.isNull() & there.isNotNull()
    kind = F.when(allowed & differs, "changed").when(allowed & fills, "filled")
    return df.withColumns({f"{column}_change": kind, column: F.when(kind.isNotNull(), there).otherwise(here)})


def agreement(df: DataFrame, a: str, b: str, tol: float, by: Sequence[str] = (), day: Column | None = None) -> DataFrame:
    """Share equal within a tolerance, largest and mean difference, correlation, level ratio, differing days."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.abs(F.col(a) - F.col(b))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((d <= tol).cast("double")).alias("share_equal"), F.max(d).alias("max_diff"),
            F.avg(d).alias("mean_abs_diff"), F.avg(F.col(b) - F.col(a)).alias("bias"), corr(a, b).alias("corr"),
            (F.avg(b) / F.nullif(F.avg(a), F.lit(0.0))).alias("ratio")]
    if day is not None:
        aggs.append(F.count_distinct(F.when(d > tol, day)).alias("days_different"))
    return rows.groupBy(*by).agg(*aggs)


def overlap_diff(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], tol: float) -> DataFrame:
    """Common keys and differing cells per column between two copies; NULLs are equal."""
    right = b.select(*key, *[F.col(c).alias(f"_kw_{c}") for c in columns])
    both = a.transform(match, right, list(key))
    flags = both.select(*[(~is_close(c, f"_kw_{c}", tol)).cast("long").alias(c) for c in columns])
    return flags.unpivot([], list(columns), "column", "differs").groupBy("column").agg(
        F.count(F.lit(1)).alias("common"), F.sum("differs").alias("different"))


def best_lag(a: DataFrame, b: DataFrame, ts: str, value: str, lags: Sequence[int], step: str | int, by: Sequence[str] = (),
             period: Column | None = None, min_n: int = 1000) -> DataFrame:
    """Per period the lag (in steps) at which the changes of two series correlate best.

    A change counts only if the row one step earlier exists. Both series meet once, in chunks of steps; every lag is a shift of
    the same arrays. Rows off the grid of steps form grids of their own.
    """
    us = T.span(step)
    unit = (period if period is not None else F.lit("all")).alias("period")
    at = lambda df: df.where(F.col(ts).isNotNull())
    nothing = lambda c: F.lit(None).cast("double").alias(c)
    left = at(a).select(*by, F.col(ts), unit, F.col(value).cast("double").alias("va"), nothing("vb"), F.lit(1.0).alias("here"))
    right = at(b).select(*by, F.col(ts), nothing("va"), F.col(value).cast("double").alias("vb"), F.lit(None).cast("double").alias("here"))
    both = left.unionByName(right.withColumn("period", F.lit(None).cast(left.schema["period"].dataType)))
    micros = T.micros(ts)
    rows = both.withColumns({"_kw_step": T.floor_div(micros, us), "_kw_phase": F.pmod(micros, F.lit(us))}).groupBy(*by, "_kw_phase", "_kw_step").agg(
        F.max("period").alias("period"), *[F.max(c).alias(c) for c in ("va", "vb", "here")])
    before, after = max(0, *(-lag for lag in lags)) + 1, max(0, *lags)

    def kernel(d, table) -> list[tuple]:
        da, db = (np.r_[np.nan, np.diff(d.x[c])] for c in ("va", "vb"))
        here = d.own[d.x["here"][d.own] == 1]
        if not len(here):
            return []
        code = table.column("period").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[d.row[here]].astype(float)
        code = np.nan_to_num(code, nan=-1).astype(int)
        out = []
        for p in np.unique(code):
            own = here[code == p]
            for lag in lags:
                u, v = da[own], db[own + lag]
                fine = ~(np.isnan(u) | np.isnan(v))
                u, v = u[fine], v[fine]
                gap = np.abs(d.x["va"][own] - d.x["vb"][own + lag])
                known = ~np.isnan(gap)
                out.append((int(d.row[own[0]]), lag, len(u), [u.sum(), v.sum(), u @ u, v @ v, u @ v, gap[known].sum(), float(known.sum())]))
        return out

    parts = by_chunk(rows, [*by, "_kw_phase"], "_kw_step", ["va", "vb", "here"], before, after,
                     f"period {left.schema['period'].dataType.simpleString()}, lag int, n bigint, s array<double>", kernel, carry=["period"])
    at_ = lambda i: F.sum(F.col("s")[i])
    sums = parts.groupBy(*[F.col(f"{O.GROUP}.{c}").alias(c) for c in by], "period", "lag").agg(
        F.sum("n").alias("n"), *[at_(i).alias(c) for i, c in enumerate(("u", "v", "uu", "vv", "uv", "gap", "pairs"))])
    n = F.col("n")
    spread = lambda a_, b_, ab: n * F.col(ab) - F.col(a_) * F.col(b_)
    stats = sums.select(*by, "period", "lag", "n", (spread("u", "v", "uv") / F.nullif(F.sqrt(F.greatest(spread("u", "u", "uu"), F.lit(0.0)) * F.greatest(spread("v", "v", "vv"), F.lit(0.0))), F.lit(0.0))).alias("corr"),
                        (F.col("gap") / F.nullif(F.col("pairs"), F.lit(0.0))).alias("mae"))
    best = F.struct(F.col("corr"), -F.col("lag"))
    ok = stats.where((F.col("n") >= min_n) & F.col("corr").isNotNull() & ~F.isnan("corr"))
    return ok.groupBy(*by, "period").agg(F.max_by("lag", best).alias("best_lag"), F.max("corr").alias("corr_best"),
                                         F.max_by("mae", best).alias("mae_best"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("corr_lag0"))


def splice_report(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], period: Column | None = None) -> DataFrame:
    """Per feature (and period): common rows, correlation and relative level of two sources."""
    right = b.select(*key, *[F.col(c).alias(f"_kw_{c}") for c in columns])
    both = a.transform(match, right, list(key)).withColumn("period", period if period is not None else F.lit("all"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col(f"_kw_{c}").cast("double").alias("y"))
                                for c in columns])).alias("c")
    long = both.select("period", cells).select("period", "c.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return long.groupBy("feature", "period").agg(
        F.count(F.lit(1)).alias("n"), corr("x", "y").alias("corr"), (F.avg("y") / F.nullif(F.avg("x"), F.lit(0.0)) - 1).alias("relative_level"))


def conflicts(df: DataFrame, key: Sequence[str], *values: str) -> DataFrame:
    """Keys that occur more than once, and how many distinct value combinations they carry."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(F.struct(*values)).alias("variants"))
    return per.where(F.col("copies") > 1)


# ---------------------------------------------------------------- gaps
def gap_scan(df: DataFrame, by: Sequence[str], ts: str, step: str | int, start: Column, end: Column,
             resolution_hours: int | None = None, chunk: str | int = "30 days") -> DataFrame:
    """Runs of missing buckets: ``head``, ``gap``, ``tail`` and, for sub-hourly grids, ``resolution``.

    Each series is expected from its first to its last bucket. A stretch of at least
    ``resolution_hours`` consecutive hours in which only the full hour is present is a change
    of resolution, not a gap. ``start`` / ``end`` bound the sample.
    """
    us = T.span(step)
    have = df.where(F.col(ts).isNotNull()).select(*by, T.floor_time(ts, us).alias("bucket"))
    span = have.groupBy(*by).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    if resolution_hours:
        out = _grid_runs(have.distinct(), span, by, us, resolution_hours, chunk)
    else:
        # Missing buckets lie between neighbours that are there: no bucket of the grid is made.
        rows = O.steps(have, by, "bucket", "next", chunk).where(T.micros("next") - T.micros("bucket") > us)
        out = rows.select(*by, F.lit("gap").alias("kind"), T.plus("bucket", us).alias("start_utc"), F.col("next").alias("end_utc"),
                          (T.floor_div(T.micros("next") - T.micros("bucket"), us) - 1).alias("n_missing"))
    null_count = F.lit(None).cast("long").alias("n_missing")
    head = span.where(F.col("first") > start).select(*by, F.lit("head").alias("kind"), start.alias("start_utc"), F.col("first").alias("end_utc"), null_count)
    tail = span.where(T.plus("last", us) < end).select(*by, F.lit("tail").alias("kind"), T.plus("last", us).alias("start_utc"), end.alias("end_utc"), null_count)
    return out.unionByName(head).unionByName(tail)


def _grid_runs(have: DataFrame, span: DataFrame, by: Sequence[str], us: int, resolution_hours: int, chunk: str | int) -> DataFrame:
    """Runs ``gap`` and ``resolution`` on the full grid of each series."""
    wanted = steps_between(span.withColumn("_kw_stop", T.plus("last", us)), by, "first", "_kw_stop", us, "bucket")
    full = wanted.transform(match, have.withColumn("_kw_have", F.lit(True)), [*by, "bucket"], "left").withColumn("_kw_have", F.coalesce("_kw_have", F.lit(False)))
    full = cut_lineage(full)
    hours = full.groupBy(*by, T.floor_time("bucket", "1 hour").alias("hour")).agg(
        F.bool_or((F.col("bucket") == T.floor_time("bucket", "1 hour")) & F.col("_kw_have")).alias("top"),
        F.count_if(~F.col("_kw_have")).alias("missing"))
    coarse = F.col("top") & (F.col("missing") > 0)
    marked = label_episodes(hours, by, "hour", coarse, chunk)
    marked = marked.select(*by, "hour", (F.coalesce("episode_length", F.lit(0)) >= resolution_hours).alias("_kw_res"))
    full = cut_lineage(full.withColumn("hour", T.floor_time("bucket", "1 hour")).transform(match, marked, [*by, "hour"]).drop("hour"))
    gaps = episodes(full, by, "bucket", ~F.col("_kw_have") & ~F.col("_kw_res"), chunk=chunk)
    gaps = gaps.select(*by, F.lit("gap").alias("kind"), F.col("start").alias("start_utc"), T.plus("end", us).alias("end_utc"), F.col("length").alias("n_missing"))
    return gaps.unionByName(_resolution_runs(full, by, us, chunk))


def _resolution_runs(full: DataFrame, by: Sequence[str], us: int, chunk: str | int) -> DataFrame:
    hours = full.where(F.col("_kw_res") & ~F.col("_kw_have")).groupBy(*by, T.floor_time("bucket", "1 hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("k"), F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    rows = O.previous(hours, by, "hour", {"before": "hour"}, chunk=chunk)
    fresh = F.col("before").isNull() | (T.micros("hour") - T.micros("before") > T.HOUR)
    rows = O.last_known(rows, by, "hour", {"run": F.when(fresh, F.col("hour"))}, chunk=chunk)
    return rows.groupBy(*by, "run").agg(F.min("a").alias("start_utc"), T.plus(F.max("z"), us).alias("end_utc"), F.sum("k").alias("n_missing")).select(
        *by, F.lit("resolution").alias("kind"), "start_utc", "end_utc", "n_missing")


def missing_buckets(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.transform(match, present.select(*keys).distinct(), list(keys), "left_anti")


def missing_by_day(expected: DataFrame, present: DataFrame, by: Sequence[str], hour: str, tz: str) -> DataFrame:
    """Missing hours per local day, whether the whole day is missing and whether it is a switch day."""
    day = T.local_midnight(T.utc_to_local(hour, tz)).alias("day")
    full = expected.groupBy(*by, day).agg(F.count(F.lit(1)).alias("expected"))
    gone = missing_buckets(expected, present, [*by, hour]).groupBy(*by, day).agg(F.count(F.lit(1)).alias("missing"))
    out = gone.transform(match, full, [*by, "day"])
    start, end = T.local_to_utc("day", tz), T.local_to_utc(T.plus("day", "1 day"), tz)
    return out.withColumns({"full_day": F.col("missing") == F.col("expected"),
                            "switch_day": T.micros(end) - T.micros(start) != T.DAY})


# ---------------------------------------------------------------- profiles
def null_share(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """NULL share per column and group in one aggregate pass, then unpivoted."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column", "null_share")


def live_completeness(df: DataFrame, columns: Sequence[str], ts: str) -> DataFrame:
    """Share present per column and year, only for full years between its first and last value."""
    rows = df.select(ts, *columns)
    spans = rows.agg(*[F.struct(F.min(F.when(F.col(c).isNotNull(), F.col(ts))).alias("first"),
                                F.max(F.when(F.col(c).isNotNull(), F.col(ts))).alias("last")).alias(c) for c in columns])
    spans = spans.unpivot([], list(columns), "column", "span").select("column", F.year("span.first").alias("y0"), F.year("span.last").alias("y1"))
    share = null_share(rows.withColumn("year", F.year(ts)), columns, ["year"])
    out = share.join(spans, "column").where((F.col("year") > F.col("y0")) & (F.col("year") < F.col("y1")))
    return out.select("column", "year", (1 - F.col("null_share")).alias("complete"))


def coverage_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), full: float = 0.999) -> DataFrame:
    """Share of rows with complete and with empty coverage per column."""
    aggs = []
    for c in columns:
        aggs += [F.struct(F.avg((F.col(c) >= full).cast("double")).alias("complete"), F.avg((F.col(c) == 0).cast("double")).alias("empty"),
                          F.avg(c).alias("mean")).alias(c)]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.unpivot(list(by), list(columns), "column", "s").select(*by, "column", "s.complete", "s.empty", "s.mean")


def series_profile(df: DataFrame, by: Sequence[str], ts: str, value: str, chunk: str | int = "30 days") -> DataFrame:
    """Rows, distinct stamps, duplicate share, first and last stamp, most common step, NULL share."""
    stamps = df.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("k"), F.count(value).alias("v"))
    rows = O.previous(stamps, by, ts, {"_kw_t": ts}, chunk=chunk)
    rows = rows.withColumn("step", (T.micros(ts) - T.micros("_kw_t")) / T.MICROS["second"])
    counts = rows.where(F.col("step").isNotNull()).groupBy(*by, "step").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy(*by).agg(F.max_by("step", F.struct("c", -F.col("step"))).alias("modal_step_s"))
    base = stamps.groupBy(*by).agg(F.sum("k").alias("rows"), F.count(F.lit(1)).alias("stamps"), F.min(ts).alias("first"), F.max(ts).alias("last"),
                                   F.sum("v").alias("_kw_v"))
    out = base.transform(match, modal, list(by), "left")
    return out.withColumns({"duplicate_share": 1 - F.col("stamps") / F.col("rows"), "null_share": 1 - F.col("_kw_v") / F.col("rows")}).drop("_kw_v")


def column_dictionary(df: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """First and last non-null time and NULL share of every column, in one aggregate."""
    wide = df.agg(*[F.struct(F.min(F.when(F.col(c).isNotNull(), F.col(ts))).alias("start_utc"),
                             F.max(F.when(F.col(c).isNotNull(), F.col(ts))).alias("end_utc"),
                             F.avg(F.col(c).isNull().cast("double")).alias("null_share")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "s").select("column", "s.*")


# ---------------------------------------------------------------- checks
@dataclass
class Expectations:
    """Named conditions evaluated together in one aggregate; nothing is written when one fails."""

    rules: dict[str, Column] = field(default_factory=dict)

    def never(self, name: str, bad: Column) -> Expectations:
        self.rules[name] = F.count_if(F.coalesce(bad, F.lit(False))) == 0
        return self

    def holds(self, name: str, aggregate: Column) -> Expectations:
        self.rules[name] = aggregate
        return self

    def report(self, df: DataFrame) -> DataFrame:
        wide = df.agg(*[F.coalesce(r, F.lit(False)).alias(n) for n, r in self.rules.items()])
        return wide.unpivot([], list(self.rules), "check", "passed")

    def enforce(self, df: DataFrame) -> DataFrame:
        failed = [r["check"] for r in self.report(df).where(~F.col("passed")).collect()]
        if failed:
            raise ValueError(f"failed checks: {sorted(failed)}")
        return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def conserved(a: DataFrame, b: DataFrame, columns: Mapping[str, str], tol: float = 1e-6) -> DataFrame:
    """Totals of paired columns before and after a transformation, and whether they agree."""
    def totals(df: DataFrame, names: Sequence[str], tag: str) -> DataFrame:
        wide = df.agg(*[F.sum(F.col(c).cast("double")).alias(n) for n, c in zip(columns, names)])
        return wide.unpivot([], list(columns), "column", tag)

    out = totals(a, list(columns), "before").join(totals(b, list(columns.values()), "after"), "column")
    return out.withColumn("conserved", F.abs(F.col("before") - F.col("after")) <= tol * F.greatest(F.abs("before"), F.lit(1.0)))


def sample_groups(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` groups picked reproducibly by a seeded digest of their key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    chosen = df.select(*keys).distinct().withColumn("_kw_d", digest).orderBy("_kw_d", *keys).limit(n).drop("_kw_d")
    return df.transform(match, chosen, list(keys), "left_semi")


def spot_check(result: DataFrame, brute: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int = 25, seed: int = 0,
               tol: float = 1e-6) -> DataFrame:
    """Sampled keys whose optimised value differs from a first-principles recomputation (must be empty)."""
    sampled = sample_groups(result, keys, n, seed)
    right = brute.select(*keys, *[F.col(c).alias(f"_kw_{c}") for c in columns])
    both = sampled.transform(match, right, list(keys), "left")
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~is_close(c, f"_kw_{c}", tol)
    return both.where(bad)


def largest(df: DataFrame, metric: str, k: int, *ties: str) -> DataFrame:
    return pick_top(df.withColumn("_kw_all", F.lit(0)), ["_kw_all"], k, F.col(metric).desc(), *[F.col(t) for t in ties]).drop("_kw_all")
