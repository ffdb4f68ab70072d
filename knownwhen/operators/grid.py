"""Regular grids, reindexing, bounded up-sampling and step functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..session import cut_lineage, spread
from . import ordered as O


def instants(start: Column, end: Column, step: str | int) -> Column:
    """Array of the step starts in ``[start, end)`` (NTZ); empty for an empty span."""
    us = T.span(step)
    first, last = T.micros(start), T.micros(end) - 1
    return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(us)), T.from_micros)) \
        .otherwise(F.array().cast("array<timestamp_ntz>"))


def steps_between(df: DataFrame, keep: Sequence[str], first: str, end: str, step: str | int, name: str,
                  block: int = 4096) -> DataFrame:
    """One row per step in ``[first, end)`` of every input row.

    Steps are generated in two levels, blocks first, and the blocks are spread over the
    cluster: a long fine grid is neither one array nor one task.
    """
    us = T.span(step)
    coarse = df.select(*keep, T.micros(first).alias("_kw_a"), T.micros(end).alias("_kw_b")).where(F.col("_kw_a") < F.col("_kw_b"))
    coarse = coarse.select(*keep, "_kw_b", F.explode(F.sequence("_kw_a", F.col("_kw_b") - 1, F.lit(us * block))).alias("_kw_a"))
    coarse = spread(coarse, *keep, "_kw_a")
    fine = F.sequence("_kw_a", F.least(F.col("_kw_b") - 1, F.col("_kw_a") + us * (block - 1)), F.lit(us))
    return coarse.select(*keep, F.explode(fine).alias("_kw_us")).select(*keep, T.from_micros("_kw_us").alias(name))


def grid(spark: SparkSession, start: str, end: str, step: str | int, tz: str | None = None,
         name: str = "ts_utc") -> DataFrame:
    """Complete grid of interval starts in ``[start, end)``, spread over tasks, with local labels."""
    us = T.span(step)
    first = spark.sql(f"SELECT unix_micros(TIMESTAMP '{start}') a, unix_micros(TIMESTAMP '{end}') b").first()
    rows = spark.range(first.a, first.b, us)
    out = rows.select(T.from_micros(F.col("id")).alias(name))
    return out if tz is None else out.withColumn("ts_local", T.utc_to_local(name, tz))


def span_grid(df: DataFrame, ts: str, step: str | int, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Grid from the first to the last value of ``ts``, for every ``by`` key.

    The span is taken over the whole table, so all series share one grid.
    """
    name = name or ts
    per = df.groupBy(*by).agg(F.min(ts).alias("_kw_a"), F.max(ts).alias("_kw_b"))
    ends = per.agg(F.min("_kw_a").alias("_kw_a"), F.max("_kw_b").alias("_kw_b"))
    ends = ends.select(T.floor_time("_kw_a", step).alias("_kw_a"), T.plus(T.floor_time("_kw_b", step), step).alias("_kw_b"))
    # One row of bounds meets the list of keys.
    spans = per.select(*by).join(F.broadcast(ends)) if by else ends
    return steps_between(spans, by, "_kw_a", "_kw_b", step, name)


def trim(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows in ``[start, end)``; plain literals, so the filter reaches the scan."""
    return df.where((F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
                    & (F.col(ts) < F.lit(end).cast(df.schema[ts].dataType)))


def on_grid(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join from the grid: missing steps become NULL rows."""
    return target.transform(match, df, list(keys), "left")


def upsample(df: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str], step: str | int,
             how: str = "repeat", cap: str | int = "1 hour", chunk: str | int = "1 day") -> DataFrame:
    """Spreads each value over its own interval: until the next stamp, at most ``cap``.

    ``split`` divides by the number of steps. A later stamp starts its own interval, so finer
    values win, and nothing is carried across a gap.
    """
    if how not in ("repeat", "split"):
        raise ValueError(how)
    us, top = T.span(step), T.span(cap)
    rows = O.following(df.select(*by, ts, *cols), by, ts, {"_kw_next": ts}, chunk=chunk)
    length = F.least(F.coalesce(T.micros("_kw_next") - T.micros(ts), F.lit(top)), F.lit(top))
    n = F.greatest(F.round(length / us), F.lit(1)).cast("long")
    rows = rows.withColumn("_kw_n", n)
    values = [(F.col(c) / F.col("_kw_n") if how == "split" else F.col(c)).alias(c) for c in cols]
    return (rows.select(*by, T.micros(ts).alias("_kw_us"), F.explode(F.sequence(F.lit(0), F.col("_kw_n") - 1)).alias("_kw_k"),
                        *values)
            .select(*by, T.from_micros(F.col("_kw_us") + F.col("_kw_k") * us).alias(ts), *cols))


def blocks_to_grid(blocks: DataFrame, start: str, end: str, cols: Sequence[str], step: str | int,
                   by: Sequence[str] = (), name: str = "ts_utc") -> DataFrame:
    """Each grid step inside ``[start, end)`` gets its block's values.

    Steps are explicit rows, so the work is the covered span; overlaps are found with
    :func:`knownwhen.operators.intervals.overlaps`.
    """
    us = T.span(step)
    first = T.micros(T.ceil_time(start, step))
    return blocks.select(*by, F.explode(instants(T.from_micros(first), F.col(end), us)).alias(name), *cols)


def local_steps(df: DataFrame, ts: str, tz: str, days: int, cols: Sequence[str],
                by: Sequence[str] = (), chunk: str | int = "30 days") -> DataFrame:
    """Values stamped near a local midnight -> blocks of ``days`` local days.

    Stamps are rounded to the nearest local midnight; the last value of a start wins and a
    later block cuts an earlier one short. Returns ``block_start_utc`` / ``block_end_utc``.
    """
    wall = T.local_midnight(T.plus(T.utc_to_local(ts, tz), "12 hours"))
    rows = df.select(*by, F.col(ts).alias("_kw_ts"), wall.alias("_kw_wall"), *cols)
    rows = rows.groupBy(*by, "_kw_wall").agg(*[F.max_by(c, "_kw_ts").alias(c) for c in cols])
    rows = rows.select(
        *by, T.local_to_utc("_kw_wall", tz, "first", "gap_end").alias("block_start_utc"),
        T.local_to_utc(T.plus("_kw_wall", days * T.DAY), tz, "first", "gap_end").alias("_kw_end"), *cols)
    rows = O.following(rows, by, "block_start_utc", {"_kw_next": "block_start_utc"}, chunk=chunk)
    return rows.select(*by, "block_start_utc",
                       F.least("_kw_end", F.coalesce("_kw_next", "_kw_end")).alias("block_end_utc"), *cols)


def month_steps(df: DataFrame, ts: str, tz: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Month stamps -> blocks ``[month, next month)`` on the local clock."""
    month = T.calendar_bucket(T.utc_to_local(ts, tz), "month")
    after = F.add_months(month.cast("date"), 1).cast("timestamp_ntz")
    return df.select(*by, T.local_to_utc(month, tz, "first", "gap_end").alias("block_start_utc"),
                     T.local_to_utc(after, tz, "first", "gap_end").alias("block_end_utc"), *cols)


RULES = {
    "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "first": None,
}


def resample(df: DataFrame, by: Sequence[str], ts: str, bucket: Column, rules: Mapping[str, str],
             require: int | None = None, name: str = "bucket") -> DataFrame:
    """One rule per column (first / mean / max / min / sum); optionally complete buckets only."""
    aggs = []
    for c, rule in rules.items():
        agg = F.min_by(c, ts) if rule == "first" else RULES[rule](F.col(c).cast("double"))
        aggs.append(agg.alias(c))
    out = df.groupBy(*by, bucket.alias(name)).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    return out if require is None else out.where(F.col("n_rows") == require)


def regularize(df: DataFrame, by: Sequence[str], ts: str, value: str, step: str | int,
               max_fill: int, chunk: str | int = "1 hour") -> DataFrame:
    """Mean per step on a complete grid; runs of at most ``max_fill`` empty steps are filled forward."""
    us = T.span(step)
    per = df.groupBy(*by, T.floor_time(ts, us).alias(ts)).agg(F.avg(value).alias(value))
    full = on_grid(per, span_grid(per, ts, us, by), [*by, ts])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    full = O.scan(full, by, ts, last={"_kw_last": known}, upcoming={"_kw_next": known}, chunk=chunk)
    run = (T.micros(F.col("_kw_next.t")) - T.micros(F.col("_kw_last.t"))) / us - 1
    fill = F.col(value).isNull() & (run <= max_fill)
    return full.withColumns({
        value: F.when(fill, F.col("_kw_last.v")).otherwise(F.col(value)),
        "filled": F.coalesce(fill, F.lit(False))}).drop("_kw_last", "_kw_next")


# Longest median step of each grid kind, and what a quarter-hourly grid must show.
GRID_MINUTES = {"15min": 15, "h": 60, "D": 1440, "W": 10080}
COARSEST = "MS"
QUARTER_SHARE = 0.9
FEWEST_STAMPS = 3


def native_step(df: DataFrame, by: Sequence[str], ts: str, chunk: str | int = "1 day") -> DataFrame:
    """Median step and grid kind (15min / h / D / W / MS) of each series.

    Steps are counted per distinct length first, so the median never needs all rows of a series.
    """
    from .ranks import quantiles

    steps = O.previous(df.select(*by, ts).distinct(), by, ts, {"_kw_prev": ts}, chunk=chunk)
    steps = steps.withColumn("minutes", (T.micros(ts) - T.micros("_kw_prev")) / T.MICROS["minute"])
    steps = cut_lineage(steps.select(*by, "minutes"))
    median = quantiles(steps, by, "minutes", {"median_minutes": 0.5})
    counts = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n_stamps"),
                                    F.avg((F.col("minutes") == 15).cast("double")).alias("share_15"))
    out = counts.transform(match, median, list(by), "left")
    m = F.col("median_minutes")
    kind = F.lit(COARSEST)
    for name, minutes in reversed(GRID_MINUTES.items()):
        regular = F.col("share_15") >= QUARTER_SHARE if minutes == 15 else F.lit(True)
        kind = F.when((m <= minutes) & regular, name).otherwise(kind)
    return out.withColumn("grid_kind", F.when((F.col("n_stamps") < FEWEST_STAMPS) | m.isNull(), "D").otherwise(kind))


def expected_rows(spark: SparkSession, start: str, end: str, step: str | int, tz: str, by: str = "year") -> DataFrame:
    """Number of grid steps per local day, month or year; switch days differ."""
    g = grid(spark, start, end, step, tz)
    return g.groupBy(T.calendar_bucket("ts_local", by).alias(by)).agg(F.count(F.lit(1)).alias("expected"))


def from_position(df: DataFrame, by: Sequence[str], order: str, start: Column, step: str | int,
                  chunk: int = 1_000_000) -> DataFrame:
    """Interval starts of an index that only counts positions: ``start + i * step``."""
    out = O.row_index(df, by, order, "_kw_i", chunk=chunk)
    return out.withColumn("ts_utc", T.from_micros(T.micros(start) + (F.col("_kw_i") - 1) * T.span(step))).drop("_kw_i")


def resolve_fold(df: DataFrame, day: str, label: str, order: str, keys: Sequence[str] = (),
                 chunk: int = 1_000_000) -> DataFrame:
    """First / second pass of a repeated local label, from file order.

    The first run of equal labels is summer time (``0``), the second winter time (``1``); a
    label that appears as one even-sized run is split in half.
    """
    by = [day, *keys]
    rows = O.previous(df, by, order, {"_kw_before": label}, chunk=chunk)
    starts = (~F.col(label).eqNullSafe(F.col("_kw_before"))).cast("long")
    rows = O.running(rows, by, order, {"_kw_run": starts}, chunk=chunk)
    within = O.running(rows, [*by, label, "_kw_run"], order, {"_kw_pos": F.lit(1).cast("long")}, chunk=chunk)
    runs = (rows.groupBy(*by, label, "_kw_run").agg(F.count(F.lit(1)).alias("_kw_n")))
    per_label = runs.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_kw_runs"), F.min("_kw_run").alias("_kw_first"),
                                             F.max("_kw_n").alias("_kw_size"))
    out = within.transform(match, per_label, [*by, label])
    half = (F.col("_kw_runs") == 1) & (F.col("_kw_size") % 2 == 0) & (F.col("_kw_pos") > F.col("_kw_size") / 2)
    fold = F.when(F.col("_kw_runs") > 1, (F.col("_kw_run") > F.col("_kw_first")).cast("int")).otherwise(half.cast("int"))
    return out.withColumn("fold", fold).drop("_kw_before", "_kw_run", "_kw_pos", "_kw_runs", "_kw_first", "_kw_size")


def detect_clock(df: DataFrame, ts: str, spring: Column, autumn: Column, by: Sequence[str] = ()) -> DataFrame:
    """Clock of naive stamps from the switch days: a gap in spring and repeats in autumn mean local."""
    n_spring = F.sum(spring.cast("long"))
    n_autumn = F.sum(autumn.cast("long"))
    distinct = F.count_distinct(F.when(autumn, F.col(ts)))
    out = df.groupBy(*by).agg(n_spring.alias("spring_rows"), n_autumn.alias("autumn_rows"), distinct.alias("autumn_stamps"))
    return out.withColumn("clock", F.when((F.col("spring_rows") == 0) & (F.col("autumn_rows") > F.col("autumn_stamps")), "local")
                          .when(F.col("autumn_rows") == F.col("autumn_stamps"), "fixed").otherwise("unknown"))
