"""Range joins, interval overlap, segments, concurrency and latest-created-wins resolution."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..session import WIDE, cut_lineage, spread
from . import ordered as O

_BIN = "_kw_bin"


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bin numbers touched by ``[start, end)`` in microseconds."""
    return F.sequence(T.floor_div(start, width), T.floor_div(F.greatest(end - 1, start), width))


def range_join(windows: DataFrame, rows: DataFrame, start: str, end: str, ts: str,
               by: Sequence[str] = (), bin: str | int = "1 day") -> DataFrame:
    """Rows inside ``[start, end)`` of each window, as an equi-join on time bins.

    Windows are copied to the bins they touch, rows are not copied; the exact bounds stay as a
    residual filter. Spark broadcasts the windows when their measured size allows it, so the
    rows need no shuffle then; otherwise both sides hash on (key, bin) and skewed bins are split.
    """
    width = T.span(bin)
    w = windows.where(F.col(start) < F.col(end)).withColumn(
        _BIN, F.explode(_bins(T.micros(start), T.micros(end), width)))
    r = rows.withColumn(_BIN, T.floor_div(T.micros(ts), width))
    out = w.transform(match, r, [*by, _BIN])
    return out.where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop(_BIN)


def window_aggregate(windows: DataFrame, rows: DataFrame, start: str, end: str, ts: str,
                     aggs: Sequence[Column], by: Sequence[str] = (), bin: str | int = "1 day") -> DataFrame:
    """All measures of a plan over each distinct window; windows without rows are absent."""
    distinct = windows.select(*by, start, end).distinct()
    return range_join(distinct, rows, start, end, ts, by, bin).groupBy(*by, start, end).agg(*aggs)


def overlap_join(events: DataFrame, windows: DataFrame, event: tuple[str, str], window: tuple[str, str],
                 by: Sequence[str] = (), known: tuple[str, str] | None = None,
                 bin: str | int = "7 days", clip: tuple[str, str] = ("clip_start", "clip_end")) -> DataFrame:
    """Pairs with ``event.start < window.end`` and ``event.end > window.start``, clipped.

    ``known=(created, origin)`` keeps only events created at or before the window's origin.
    A pair is emitted in exactly one bin: the one where its overlap starts.
    """
    width = T.span(bin)
    (es, ee), (ws, we) = event, window
    e = events.where(F.col(es) < F.col(ee)).withColumn(_BIN, F.explode(_bins(T.micros(es), T.micros(ee), width)))
    w = windows.where(F.col(ws) < F.col(we)).withColumn(_BIN, F.explode(_bins(T.micros(ws), T.micros(we), width)))
    low, high = F.greatest(F.col(es), F.col(ws)), F.least(F.col(ee), F.col(we))
    cond = (F.col(es) < F.col(we)) & (F.col(ee) > F.col(ws))
    if known:
        cond &= F.col(known[0]) <= F.col(known[1])
    out = e.transform(match, w, [*by, _BIN]).where(cond)
    out = out.where(F.col(_BIN) == T.floor_div(T.micros(low), width))
    return out.withColumns({clip[0]: low, clip[1]: high}).drop(_BIN)


def segments(df: DataFrame, by: Sequence[str], start: str, end: str, chunk: str | int = "30 days") -> DataFrame:
    """Consecutive segments ``[p, q)`` between all start and end points of a key."""
    points = df.select(*by, F.col(start).alias("p")).union(df.select(*by, F.col(end).alias("p")))
    return O.steps(points, by, "p", "q", chunk).where(F.col("q").isNotNull())


def concurrency(df: DataFrame, start: str, end: str, by: Sequence[str] = (), chunk: str | int = "30 days") -> DataFrame:
    """Number of open intervals after every change, from +1 / -1 steps.

    Steps at one instant are added up before the shuffle, so the running sum only sees changes.
    """
    steps = df.where(F.col(start) < F.col(end)).select(*by, F.explode(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col(end).alias("t"), F.lit(-1).cast("long").alias("d")))).alias("_kw_step"))
    steps = steps.groupBy(*by, F.col("_kw_step.t").alias("t")).agg(F.sum("_kw_step.d").alias("step"))
    return O.running(steps, by, "t", {"open": F.col("step")}, chunk=chunk)


def concurrency_on_grid(df: DataFrame, grid: DataFrame, start: str, end: str, ts: str,
                        by: Sequence[str] = (), chunk: str | int = "30 days") -> DataFrame:
    """Open intervals at each grid instant (0 before the first change)."""
    from .asof import prefix_at

    steps = df.where(F.col(start) < F.col(end)).select(*by, F.explode(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col(end).alias("t"), F.lit(-1).cast("long").alias("d")))).alias("_kw_step"))
    steps = steps.groupBy(*by, F.col("_kw_step.t").alias("_kw_t")).agg(F.sum("_kw_step.d").alias("_kw_d"))
    return prefix_at(grid, steps, ts, "_kw_t", by, {"open": F.col("_kw_d")}, chunk)


LEAF = 64   # pieces of one bin that are compared with one another
FAN = 16    # parts of a bin with more pieces than that


def _visible_only(pieces: DataFrame) -> DataFrame:
    """Of the pieces with one extent in one bin only the highest ranked can be seen. Most hidden pieces go before the exchange."""
    whole = (F.col("_kw_s") == F.col("_kw_lo")) & (F.col("_kw_e") == F.col("_kw_hi"))
    extent = [F.when(~whole, F.col(c)).alias(f"{c}_g") for c in ("_kw_s", "_kw_e")]
    best = pieces.groupBy("_kw_k", "_kw_lo", "_kw_hi", *extent).agg(F.max_by("_kw_v", "_kw_rank").alias("_kw_v"), F.max("_kw_rank").alias("_kw_rank"))
    return best.select("_kw_k", "_kw_lo", "_kw_hi", F.coalesce("_kw_s_g", "_kw_lo").alias("_kw_s"), F.coalesce("_kw_e_g", "_kw_hi").alias("_kw_e"), "_kw_rank", "_kw_v")


def _parts(pieces: DataFrame) -> DataFrame:
    """The pieces cut at the borders of ``FAN`` equal parts of their bin, which become bins of their own."""
    width = F.call_function("div", F.col("_kw_hi") - F.col("_kw_lo") + (FAN - 1), F.lit(FAN).cast("long"))
    first = T.floor_div(F.col("_kw_s") - F.col("_kw_lo"), F.col("_kw_w"))
    last = T.floor_div(F.col("_kw_e") - 1 - F.col("_kw_lo"), F.col("_kw_w"))
    rows = pieces.withColumn("_kw_w", width).withColumn("_kw_j", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("_kw_low", F.col("_kw_lo") + F.col("_kw_j") * F.col("_kw_w"))
    rows = rows.withColumn("_kw_high", F.least(F.col("_kw_low") + F.col("_kw_w"), "_kw_hi"))
    return rows.select("_kw_k", F.col("_kw_low").alias("_kw_lo"), F.col("_kw_high").alias("_kw_hi"), F.greatest("_kw_s", "_kw_low").alias("_kw_s"),
                       F.least("_kw_e", "_kw_high").alias("_kw_e"), "_kw_rank", "_kw_v")


def _elementary(leaves: DataFrame) -> DataFrame:
    """(_kw_k, seg_start, seg_end, _kw_v): in each bin the segments between neighbouring ends, each with its highest ranked piece;
    neighbours with the same piece are joined. A bin is one row of at most ``LEAF`` pieces."""
    bins = spread(leaves, "_kw_k", "_kw_lo", "_kw_hi", least=WIDE).groupBy("_kw_k", "_kw_lo", "_kw_hi").agg(F.collect_list(F.struct("_kw_s", "_kw_e", "_kw_rank", "_kw_v")).alias("_kw_p"))
    p = F.col("_kw_p")
    bins = bins.withColumn("_kw_t", F.array_sort(F.array_distinct(F.concat(F.transform(p, lambda x: x["_kw_s"]), F.transform(p, lambda x: x["_kw_e"])))))
    t = F.col("_kw_t")

    def segment(i):
        covers = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: (p[j]["_kw_s"] <= t[i]) & (p[j]["_kw_e"] >= t[i + 1]))
        top = F.array_max(F.transform(covers, lambda j: F.struct(p[j]["_kw_rank"].alias("r"), j.alias("j"))))
        return F.struct(t[i].alias("s"), t[i + 1].alias("e"), top["j"].alias("j"))

    bins = bins.withColumn("_kw_g", F.filter(F.transform(F.sequence(F.lit(0), F.size(t) - 2), segment), lambda g: g["j"].isNotNull()))
    g = F.col("_kw_g")
    joins = lambda i, k: F.coalesce((F.get(g, i)["j"] == F.get(g, k)["j"]) & (F.get(g, i)["e"] == F.get(g, k)["s"]), F.lit(False))
    places = F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))
    opens = F.filter(places, lambda i: ~joins(i - 1, i))
    closes = F.filter(places, lambda i: ~joins(i, i + 1))
    runs = F.zip_with(opens, closes, lambda a, z: F.struct(g[a]["s"].alias("s"), g[z]["e"].alias("e"), p[g[a]["j"]]["_kw_v"].alias("v")))
    return bins.select("_kw_k", F.inline(runs)).select("_kw_k", T.from_micros("s").alias("seg_start"), T.from_micros("e").alias("seg_end"), F.col("v").alias("_kw_v"))


def resolve_latest(df: DataFrame, key: Sequence[str], start: str, end: str, rank: Sequence[str],
                   values: Mapping[str, str], bin: str | int, window: tuple[str, str] | None = None) -> DataFrame:
    """Segments of each key on which the interval with the highest ``rank`` wins; segments end at bin borders.

    Intervals are cut at bin borders. Bins of up to ``LEAF`` pieces are resolved as they are. In a bin with more, of those that cover all of it only the highest ranked one can ever be visible, and it is found by a
    map-side ``max_by``; an interval keeps at most two other pieces. Bins that still hold more than ``LEAF`` pieces are
    cut into ``FAN`` parts, again and again, where the same holds; so neither a key with very many intervals nor a crowded moment
    gathers in one task, and no pair of intervals is formed outside a bin of ``LEAF`` pieces.

    ``window`` (start, end columns already part of ``key``) cuts at the window instead.
    """
    width = T.span(bin)
    s, e = T.micros(start), T.micros(end)
    rows = df.where(F.col(start) < F.col(end)).select(
        *key, F.explode(_bins(s, e, width)).alias(_BIN), s.alias("_kw_s"), e.alias("_kw_e"),
        F.struct(*rank).alias("_kw_rank"), F.struct(*[F.col(c).alias(n) for n, c in values.items()]).alias("_kw_v"))
    low, high = F.col(_BIN) * width, (F.col(_BIN) + 1) * width
    if window:
        low = F.greatest(low, T.micros(window[0]))
        high = F.least(high, T.micros(window[1]))
    rows = rows.select(F.struct(*key).alias("_kw_k"), low.alias("_kw_lo"), high.alias("_kw_hi"), F.greatest("_kw_s", low).alias("_kw_s"),
                       F.least("_kw_e", high).alias("_kw_e"), "_kw_rank", "_kw_v").where("_kw_s < _kw_e")
    pieces, at, done = cut_lineage(rows), ["_kw_k", "_kw_lo", "_kw_hi"], []
    hidden = True  # only crowded bins are searched for hidden pieces, before they are cut; the others move once, to be resolved
    while True:
        crowded = cut_lineage(pieces.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > LEAF) & (F.col("_kw_hi") - F.col("_kw_lo") > 1)).select(*at))
        if crowded.isEmpty():
            break
        done.append(pieces.join(crowded, at, "left_anti"))
        among = pieces.join(crowded, at, "left_semi")
        pieces = cut_lineage(_visible_only(among if hidden else _parts(among)))
        hidden = False
    for other in done:
        pieces = pieces.unionByName(other)
    return _elementary(pieces).select(*[F.col("_kw_k")[c].alias(c) for c in key], *[F.col("_kw_v")[n].alias(n) for n in values], "seg_start", "seg_end")


def time_weighted(segs: DataFrame, value: str, window: tuple[str, str], keys: Sequence[str], name: str) -> DataFrame:
    """``sum(value * segment length) / window length`` per key and window."""
    seconds = (T.micros("seg_end") - T.micros("seg_start")) / 1e6
    total = (T.micros(window[1]) - T.micros(window[0])) / 1e6
    return segs.groupBy(*keys, *window).agg((F.sum(F.col(value) * seconds) / F.first(total)).alias(name))


def explain_runs(runs: DataFrame, reasons: DataFrame, token: str, pattern: str, note: str,
                 run: tuple[str, str] = ("start", "stop"), reason: tuple[str, str] = ("known_start", "known_stop"),
                 id_: Sequence[str] = ("series",), bin: str | int = "30 days") -> DataFrame:
    """Notes of all known intervals that overlap a run and whose pattern matches its token."""
    pairs = overlap_join(reasons, runs, reason, run, bin=bin)
    hits = pairs.where(F.expr(f"{token} rlike {pattern}"))
    notes = hits.groupBy(*id_, *run).agg(F.array_join(F.array_sort(F.collect_set(note)), "; ").alias("notes"))
    return runs.transform(match, notes, [*id_, *run], "left")


def interval_gaps(df: DataFrame, by: Sequence[str], start: str, end: str, chunk: str | int = "30 days") -> DataFrame:
    """Jumps between consecutive intervals of a key: from the last end to the next start."""
    one = df.groupBy(*by, start).agg(F.min(end).alias(end))
    rows = O.previous(one, by, start, {"gap_start": end}, chunk=chunk)
    return (rows.where(F.col(start) > F.col("gap_start"))
            .select(*by, "gap_start", F.col(start).alias("gap_end"),
                    ((T.micros(start) - T.micros("gap_start")) / T.HOUR).alias("hours")))


def overlaps(df: DataFrame, by: Sequence[str], start: str, end: str, ties: Sequence[str] = (),
             chunk: str | int = "30 days") -> DataFrame:
    """Intervals that begin before the next one of their key: ``next_start < end``."""
    rows = O.following(df, by, start, {"next_start": start}, ties, chunk)
    return rows.where(F.col("next_start") < F.col(end))


def explode_intervals(df: DataFrame, start: str, end: str, step: str | int, name: str = "slot") -> DataFrame:
    """One row per covered grid step."""
    from .grid import instants

    return df.withColumn(name, F.explode(instants(T.floor_time(start, step), F.col(end), step)))


EARTH_KM = 6371.0


def _xyz(lat: str, lon: str) -> list[Column]:
    """The point on the unit sphere."""
    la, lo = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _cell(xyz: Sequence[Column], side: Column) -> Column:
    """Cube of the given side that holds the point."""
    return F.struct(*[F.floor(c / side).alias(n) for c, n in zip(xyz, "xyz")])


def _cells_near(xyz: Sequence[Column], side: Column, reach: Column) -> Column:
    """Those of the point's cube and its 26 neighbours that are at most ``reach`` away from it."""
    own = F.struct(*[F.floor(c / side).alias(n) for c, n in zip(xyz, "xyz")], *[(c - F.floor(c / side) * side).alias(f"d{n}") for c, n in zip(xyz, "xyz")], side.alias("s"), (reach * reach).alias("r"))
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])

    def near(o: Column) -> Column:
        off = lambda d, n: F.when(d[n] < 0, o[f"d{n}"]).when(d[n] > 0, o["s"] - o[f"d{n}"]).otherwise(F.lit(0.0))
        kept = F.filter(steps, lambda d: off(d, "x") * off(d, "x") + off(d, "y") * off(d, "y") + off(d, "z") * off(d, "z") <= o["r"])
        return F.transform(kept, lambda d: F.struct(*[(o[n] + d[n]).alias(n) for n in "xyz"]))

    return F.explode(F.element_at(F.transform(F.array(own), near), 1))


def _close_pairs(left: DataFrame, right: DataFrame, left_pos: tuple[str, str], right_pos: tuple[str, str], right_id: str, k: int, finest_km: float) -> DataFrame:
    """(_kw_0, _kw_1: left position, right columns, km): for each left position all right points that can be among its ``k`` nearest, and few others."""
    from ..functions.numeric import haversine_km
    from .ranks import pick_top

    coarse = min(finest_km / EARTH_KM, 1.0)
    last = max(0, math.ceil(math.log2(2.0 / coarse)))  # here the 27 cubes around any point hold the sphere
    below = max(0, math.floor(math.log2(coarse * EARTH_KM * 200)))  # halvings down to some 5 m
    first, last = coarse / 2.0**below, last + below
    side_of = lambda level: F.lit(first) * F.pow(F.lit(2.0), level)
    placed = lambda df, pos: df.where(F.col(pos[0]).isNotNull() & F.col(pos[1]).isNotNull())
    here, there = ["_kw_0", "_kw_1"], ["_kw_2", "_kw_3"]
    places = cut_lineage(placed(left, left_pos).select(*[F.col(c).alias(n) for c, n in zip(left_pos, here)]).distinct())
    offers = placed(right, right_pos).withColumns({n: F.col(c) for c, n in zip(right_pos, there)})
    offers = cut_lineage(pick_top(offers, there, k, F.col(right_id)).drop("rank"))
    finest = offers.select(*there).distinct().select(_cell(_xyz(*there), F.lit(first)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("_kw_n"))
    up = lambda c: F.floor(F.col("c")[c] / F.pow(F.lit(2.0), F.col("_kw_level"))).alias(c)
    counts = finest.withColumn("_kw_level", F.explode(F.sequence(F.lit(0), F.lit(last)))).groupBy("_kw_level", F.struct(*[up(c) for c in "xyz"]).alias("_kw_c")).agg(F.sum("_kw_n").alias("_kw_n"))
    full = cut_lineage(counts.where(F.col("_kw_n") >= k).select("_kw_level", "_kw_c"))
    sizes = sorted(r[0] for r in full.select("_kw_level").distinct().collect())  # at most one per size
    own = places.withColumn("_kw_level", F.explode(F.array(*[F.lit(u) for u in sizes]) if sizes else F.array().cast("array<int>")))
    own = own.withColumn("_kw_c", _cell(_xyz(*here), side_of(F.col("_kw_level")))).join(full, ["_kw_level", "_kw_c"])
    own = cut_lineage(own.groupBy(*here).agg(F.min("_kw_level").alias("_kw_level")))
    km = haversine_km(*[F.col(c) for c in (*here, *there)])

    def met(asked: DataFrame, cell: Column) -> DataFrame:
        """The asked cubes beside the offers in them, of every size in use."""
        used = sorted(r[0] for r in asked.select("_kw_level").distinct().collect()) or [last]
        at = offers.withColumn("_kw_level", F.explode(F.array(*[F.lit(u) for u in used])))
        return spread(asked, *here).withColumn("_kw_c", cell).join(at.withColumn("_kw_c", _cell(_xyz(*there), side_of(F.col("_kw_level")))), ["_kw_level", "_kw_c"]).drop("_kw_level", "_kw_c").withColumn("km", km)

    inside = met(own, _cell(_xyz(*here), side_of(F.col("_kw_level"))))
    bound = pick_top(inside, here, k, F.col("km")).groupBy(*here).agg(F.max("km").alias("_kw_bound"))
    asked = cut_lineage(places.join(own, here, "left").join(bound, here, "left").withColumn("_kw_level", F.least(F.coalesce(F.col("_kw_level") + 1, F.lit(last)), F.lit(last))))
    reach = F.coalesce(2 * F.sin(F.col("_kw_bound") / (2 * EARTH_KM)) * (1 + 1e-9) + 1e-9, F.lit(4.0))
    return met(asked, _cells_near(_xyz(*here), side_of(F.col("_kw_level")), reach)).where(F.col("_kw_bound").isNull() | (F.col("km") <= F.col("_kw_bound"))).drop("_kw_bound", *there)


def nearest(left: DataFrame, right: DataFrame, left_pos: tuple[str, str], right_pos: tuple[str, str],
            left_id: str, right_id: str, k: int = 1, finest_km: float = 100.0) -> DataFrame:
    """The ``k`` nearest right points of every left point by great-circle distance, exactly; all, if fewer. Points without position take no part.

    Both sides lie in cubes around the unit sphere, whose sides are ``finest_km`` times powers of two, down to the size at which no cube holds ``k``
    right positions any more (some 5 m at least). Of the right points at one position only the ``k`` smallest ids can ever be found, so crowded positions
    count once; left points at one position are answered together. A left position takes the smallest of its cubes that holds ``k``
    right positions. The k-th distance inside that cube bounds the answer: one equi-join with the neighbouring cubes of twice the side that the bound
    reaches sees every possible match, and only pairs within the bound are ranked. A position in a crowded region looks at small cubes, a lonely one at large ones;
    only a position with fewer than ``k`` right positions in its octant of the sphere looks at all of them.
    """
    from .ranks import pick_top

    here = ["_kw_0", "_kw_1"]
    found = pick_top(_close_pairs(left, right, left_pos, right_pos, right_id, k, finest_km), here, k, F.col("km"), F.col(right_id))
    points = left.where(F.col(left_pos[0]).isNotNull() & F.col(left_pos[1]).isNotNull())
    return points.join(found, (F.col(left_pos[0]) == F.col("_kw_0")) & (F.col(left_pos[1]) == F.col("_kw_1"))).drop(*here)
