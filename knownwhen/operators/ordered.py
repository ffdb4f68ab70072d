"""Ordered computations on series of any length, without one task per series.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one task, which
fails as soon as one series holds a large share of the table. The operators here cut each
series into chunks of its ordering axis and work in two levels:

1. rows are hash-partitioned by (series, chunk), so a hot series spreads over the cluster;
2. one summary row per chunk (built with map-side partial aggregation) is scanned per series
   to find what each chunk inherits from the ones before it;
3. the inherited value is joined back and combined with a window inside the chunk.

The number of summary rows depends on the time span, not on the number of events. Choose the
chunk so that one chunk of the densest series is a comfortable task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timeaxis import floor_div, key_width, order_key
from ..session import WIDE, spread

GROUP, CHUNK, KEY, OWN, INDEX = "_kw_group", "_kw_chunk", "_kw_key", "_kw_own", "_kw_index"
_FIRST_CHUNK = -(2**62)
UNBOUNDED = Window.unboundedPreceding


def group_key(by: Sequence[str]) -> Column:
    """One struct column: unlike bare keys, a struct joins NULL members to NULL members."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def keyed(df: DataFrame, by: Sequence[str], order: str, chunk: str | int) -> DataFrame:
    """Adds the series struct, the BIGINT ordering key and the chunk number."""
    key = order_key(df, order)
    number = F.coalesce(floor_div(key, key_width(df, order, chunk)), F.lit(_FIRST_CHUNK))
    return df.withColumns({GROUP: group_key(by), KEY: key, CHUNK: number})


def unkeyed(df: DataFrame) -> DataFrame:
    return df.drop(GROUP, KEY, CHUNK, OWN, INDEX)


def position(ties: Sequence[str] = ()) -> Column:
    return F.struct(F.col(KEY), *[F.col(t) for t in ties])


def inside(ties: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(GROUP, CHUNK).orderBy(KEY, *ties)


def inherit(rows: DataFrame, summary: Mapping[str, Column],
            carried: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
            whole: Mapping[str, Column] | None = None) -> DataFrame:
    """Joins to every row what its chunk inherits from the chunks before and after it.

    ``summary`` is aggregated per chunk; ``carried`` maps the windows over the earlier and the
    later summary rows (nearest last) to output columns; ``whole`` gives per-series totals.
    """
    totals = rows.groupBy(GROUP, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    series = Window.partitionBy(GROUP)
    earlier = series.orderBy(F.col(CHUNK).asc()).rowsBetween(UNBOUNDED, -1)
    later = series.orderBy(F.col(CHUNK).desc()).rowsBetween(UNBOUNDED, -1)
    cols = [c.alias(n) for n, c in carried(earlier, later).items()]
    cols += [c.over(series).alias(n) for n, c in (whole or {}).items()]
    state = totals.select(F.col(GROUP).alias("_kw_g"), F.col(CHUNK).alias("_kw_c"), *cols)
    return (rows.join(state, (F.col(GROUP) == F.col("_kw_g")) & (F.col(CHUNK) == F.col("_kw_c")))
            .drop("_kw_g", "_kw_c"))


def accumulate(rows: DataFrame, sums: Mapping[str, Column], ties: Sequence[str] = (),
               inclusive: bool = True, totals: Mapping[str, str] | None = None) -> DataFrame:
    """Running sums over rows that already carry the series and chunk keys.

    ``totals`` maps an output name to the sum whose whole-series total it should hold.
    """
    zero = F.lit(0)
    out = inherit(
        rows,
        {f"_kw_t_{n}": F.sum(e) for n, e in sums.items()},
        lambda earlier, _: {f"_kw_b_{n}": F.sum(f"_kw_t_{n}").over(earlier) for n in sums},
        whole={name: F.sum(f"_kw_t_{n}") for name, n in (totals or {}).items()},
    )
    frame = inside(ties).rowsBetween(UNBOUNDED, 0 if inclusive else -1)
    out = out.withColumns({
        n: F.coalesce(F.col(f"_kw_b_{n}"), zero) + F.coalesce(F.sum(e).over(frame), zero)
        for n, e in sums.items()})
    return out.drop(*[f"_kw_b_{n}" for n in sums])


def running(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column],
            ties: Sequence[str] = (), chunk: str | int = "1 day", inclusive: bool = True) -> DataFrame:
    """Prefix sums per series in the given order."""
    return unkeyed(accumulate(keyed(df, by, order, chunk), sums, ties, inclusive))


def row_index(df: DataFrame, by: Sequence[str], order: str, name: str,
              ties: Sequence[str] = (), chunk: str | int = "1 day") -> DataFrame:
    """1-based position of each row in its series."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, ties, chunk)


Values = Mapping[str, "Column | str"]


def scan(df: DataFrame, by: Sequence[str], order: str, *, last: Values | None = None, upcoming: Values | None = None,
         before: Values | None = None, after: Values | None = None, sums: Values | None = None,
         ties: Sequence[str] = (), chunk: str | int = "1 day") -> DataFrame:
    """Several ordered look-ups in one pass over the rows and one over the chunk summaries.

    ``last`` / ``upcoming``: nearest non-null value at or before / after the row; ``before`` /
    ``after``: value of the neighbouring row; ``sums``: running sums. Asking for everything in
    one call matters: each call reads its input twice, once for the summaries.
    """
    def columns(values: Values | None) -> dict[str, Column]:
        return {n: v if isinstance(v, Column) else F.col(v) for n, v in (values or {}).items()}

    last_, next_, before_, after_, sums_ = map(columns, (last, upcoming, before, after, sums))
    rows = keyed(df, by, order, chunk)
    pos = position(ties)
    summary = {f"_kw_l_{n}": F.max_by(v, F.when(v.isNotNull(), pos)) for n, v in last_.items()}
    summary |= {f"_kw_n_{n}": F.min_by(v, F.when(v.isNotNull(), pos)) for n, v in next_.items()}
    summary |= {f"_kw_s_{n}": F.sum(v) for n, v in sums_.items()}
    here_b = F.struct(*[v.alias(n) for n, v in before_.items()]) if before_ else None
    here_a = F.struct(*[v.alias(n) for n, v in after_.items()]) if after_ else None
    if before_:
        summary["_kw_edge_before"] = F.max_by(here_b, pos)
    if after_:
        summary["_kw_edge_after"] = F.min_by(here_a, pos)

    def carried(earlier: WindowSpec, later: WindowSpec) -> dict[str, Column]:
        out = {f"_kw_l_{n}": F.last(f"_kw_l_{n}", ignorenulls=True).over(earlier) for n in last_}
        out |= {f"_kw_n_{n}": F.last(f"_kw_n_{n}", ignorenulls=True).over(later) for n in next_}
        out |= {f"_kw_s_{n}": F.sum(f"_kw_s_{n}").over(earlier) for n in sums_}
        out |= {"_kw_edge_before": F.last("_kw_edge_before").over(earlier)} if before_ else {}
        out |= {"_kw_edge_after": F.last("_kw_edge_after").over(later)} if after_ else {}
        return out

    out = inherit(rows, summary, carried)
    up_to = inside(ties).rowsBetween(UNBOUNDED, 0)
    onwards = inside(ties).rowsBetween(0, Window.unboundedFollowing)
    near = inside(ties)
    new = {n: F.coalesce(F.last(v, ignorenulls=True).over(up_to), F.col(f"_kw_l_{n}")) for n, v in last_.items()}
    new |= {n: F.coalesce(F.first(v, ignorenulls=True).over(onwards), F.col(f"_kw_n_{n}")) for n, v in next_.items()}
    new |= {n: F.coalesce(F.col(f"_kw_s_{n}"), F.lit(0)) + F.coalesce(F.sum(v).over(up_to), F.lit(0)) for n, v in sums_.items()}
    if before_:
        new["_kw_near_before"] = F.coalesce(F.lag(here_b, 1).over(near), F.col("_kw_edge_before"))
    if after_:
        new["_kw_near_after"] = F.coalesce(F.lead(here_a, 1).over(near), F.col("_kw_edge_after"))
    out = out.withColumns(new)
    out = out.withColumns({**{n: F.col("_kw_near_before")[n] for n in before_}, **{n: F.col("_kw_near_after")[n] for n in after_}})
    return unkeyed(out.drop("_kw_near_after", "_kw_near_before", "_kw_edge_before", "_kw_edge_after", *[f"_kw_l_{n}" for n in last_],
                            *[f"_kw_n_{n}" for n in next_], *[f"_kw_s_{n}" for n in sums_]))


def last_known(df: DataFrame, by: Sequence[str], order: str, values: Values, ties: Sequence[str] = (),
               chunk: str | int = "1 day") -> DataFrame:
    """Latest non-null value at or before each row."""
    return scan(df, by, order, last=values, ties=ties, chunk=chunk)


def next_known(df: DataFrame, by: Sequence[str], order: str, values: Values, ties: Sequence[str] = (),
               chunk: str | int = "1 day") -> DataFrame:
    """Earliest non-null value at or after each row."""
    return scan(df, by, order, upcoming=values, ties=ties, chunk=chunk)


def previous(df: DataFrame, by: Sequence[str], order: str, values: Values, ties: Sequence[str] = (),
             chunk: str | int = "1 day") -> DataFrame:
    """Values of the row before; NULL on the first row of a series."""
    return scan(df, by, order, before=values, ties=ties, chunk=chunk)


def following(df: DataFrame, by: Sequence[str], order: str, values: Values, ties: Sequence[str] = (),
              chunk: str | int = "1 day") -> DataFrame:
    """Values of the row after; NULL on the last row of a series."""
    return scan(df, by, order, after=values, ties=ties, chunk=chunk)


def steps(df: DataFrame, by: Sequence[str], order: str, name: str, chunk: str | int = "1 day") -> DataFrame:
    """(by, order, name): every distinct value of the axis once per series, beside the next larger one (NULL beside the largest).

    Equal values are neighbours once a chunk is sorted, so they are dropped there instead of in a hash table: rows are shuffled and sorted once.
    """
    rows = keyed(df.select(*by, order), by, order, chunk)
    later = Window.partitionBy(GROUP).orderBy(F.col(CHUNK).desc()).rowsBetween(UNBOUNDED, -1)
    heads = rows.groupBy(GROUP, CHUNK).agg(F.min(order).alias("_kw_head"))
    heads = heads.select(F.col(GROUP).alias("_kw_g"), F.col(CHUNK).alias("_kw_c"), F.last("_kw_head").over(later).alias("_kw_head"))
    near = inside([order])
    rows = spread(rows, GROUP, CHUNK, least=WIDE).withColumns({"_kw_n": F.row_number().over(near), "_kw_p": F.lag(order, 1).over(near)})
    rows = rows.where((F.col("_kw_n") == 1) | ~F.col(order).eqNullSafe(F.col("_kw_p"))).withColumn(name, F.lead(order, 1).over(near))
    rows = rows.join(heads, (F.col(GROUP) == F.col("_kw_g")) & (F.col(CHUNK) == F.col("_kw_c")))
    return rows.select(*by, order, F.coalesce(name, "_kw_head").alias(name))


def halo(df: DataFrame, by: Sequence[str], order: str, before: int, after: int,
         width: int) -> DataFrame:
    """Copies each row into every chunk whose moving frames can reach it.

    ``OWN`` marks the one copy that is an output row. With ``width`` at least the reach a row
    is copied at most twice per direction. A row without an order value is kept, in a chunk of its own.
    """
    key = order_key(df, order)
    low = floor_div(key - after, width)
    high = floor_div(key + before, width)
    rows = df.withColumns({GROUP: group_key(by), KEY: key})
    rows = rows.withColumn(CHUNK, F.explode_outer(F.sequence(low, high)))
    return rows.withColumn(OWN, F.col(CHUNK).eqNullSafe(floor_div(F.col(KEY), width)))


def rolling_time(df: DataFrame, by: Sequence[str], order: str, aggs: Mapping[str, Column],
                 before: str | int, after: str | int = 0, chunk: str | int | None = None,
                 min_count: Mapping[str, tuple[Column, int]] | None = None) -> DataFrame:
    """Moving aggregates over ``[t - before, t + after]`` on the ordering axis.

    ``before=7 days`` includes both ends; pass microseconds (or days for a DATE axis) to move
    an end by one unit. Rows without an order value get NULL. ``min_count`` maps an output to (counted column, minimum) and turns
    thinner windows into NULL. Frames see a bounded piece of a series, never all of it.
    """
    b, a = key_width(df, order, before), key_width(df, order, after)
    reach = max(abs(b), abs(a), 1)
    width = key_width(df, order, chunk) if chunk is not None else 4 * reach
    rows = halo(df, by, order, b, a, width)
    frame = Window.partitionBy(GROUP, CHUNK).orderBy(KEY).rangeBetween(-b, a)
    placed = F.col(KEY).isNotNull()
    cols = {n: F.when(placed, e.over(frame)) for n, e in aggs.items()}
    for n, (counted, least) in (min_count or {}).items():
        cols[n] = F.when(F.count(counted).over(frame) >= least, cols[n])
    return unkeyed(rows.withColumns(cols).where(F.col(OWN)))


def rolling_rows(df: DataFrame, by: Sequence[str], order: str, aggs: Mapping[str, Column], n: int,
                 counted: Column, min_periods: int = 1, center: bool = False, skip: int = 0,
                 ties: Sequence[str] = (), chunk: str | int = "1 day", index: str | None = None) -> DataFrame:
    """Moving aggregates over the last ``n`` rows (``skip`` rows back), or centred on the row.

    ``index`` names a column that already numbers the rows of each series.
    """
    after = (n - 1) // 2 if center else -skip
    before = n - 1 + skip if not center else n - 1 - after
    number = index or INDEX + "_n"
    rows = df if index else row_index(df, by, order, number, ties, chunk)
    rows = halo(rows, by, number, before, max(after, 0), max(4 * n, 4096))
    frame = Window.partitionBy(GROUP, CHUNK).orderBy(number).rowsBetween(-before, after)
    full = F.count(counted).over(frame) >= min_periods
    rows = rows.withColumns({k: F.when(full, e.over(frame)) for k, e in aggs.items()})
    out = unkeyed(rows.where(F.col(OWN)))
    return out if index else out.drop(number)
