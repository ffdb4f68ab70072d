"""Scores of the size of exceedances, each fold predicted from the clusters that ended before it.

A cluster is known from one fold on (and, under a recent window, up to another), so how many known values lie below a point is a running
count over folds. Values are cut into slices per series; running counts per (slice, fold) tell which slice holds a wanted order statistic
and how many known values lie below it. Inside a slice the rest is found on its own few values. So a cluster is shipped once, not
once per fold, and no task holds a series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import timeaxis as T
from ..session import cut_lineage
from .ordered import GROUP, group_key
from .ranks import SLICES, _cuts, _slice, salted_join

FOUND = "kind int, window string, fold long, level int, v double"
NEVER = 2**40


def _picked(table: pa.Table) -> list[tuple]:
    """One slice. Rows are known values (kind 0: x, first and last fold), wanted order statistics (1: fold, window, level, place, weight) and
    test values (2: x, fold)."""
    kind = table.column("kind").to_numpy()
    get = lambda c, k: table.column(c).to_numpy(zero_copy_only=False)[kind == k]
    x, since, until = (get(c, 0) for c in ("x", "since", "until"))
    order = np.argsort(x, kind="stable")
    x, since, until = x[order], since[order], until[order]
    window = np.array(table.column("window").to_pylist(), object)
    known = lambda f, w: (since <= f) & ((until > f) | (w == "expanding"))
    out = []
    wanted = list(zip(window[kind == 1], get("fold", 1).astype(int)))
    level, place, weight = get("level", 1), get("place", 1), get("weight", 1)
    tests, fold = get("x", 2), get("fold", 2)
    windows = sorted({w for w in window[kind == 3]})
    for w, f in sorted(set(wanted)):
        own = x[known(f, w)]
        for i in [i for i, key in enumerate(wanted) if key == (w, f)]:
            out.append((1, w, f, int(level[i]), float(weight[i] * own[int(place[i])])))
    for w in windows:
        for f in np.unique(fold):
            own = x[known(f, w)]
            out.append((2, w, int(f), 0, float(np.searchsorted(own, tests[fold == f], side="right").sum())))
    return out


def exceedance_backtest(clusters: DataFrame, by: Sequence[str], start: str, end: str, excess: str, test_start: str, months: int,
                        taus: Sequence[float], min_fit: int = 30, embargo_days: int = 0, recent_days: int | None = None, tail: float = 0.9) -> DataFrame:
    """Out-of-sample quantile scores of empirical and exponential predictions, one row per series, fold and window of the past.

    Folds last ``months``; a fold is predicted from all clusters that ended ``embargo_days`` before it (``expanding``) and, with ``recent_days``, from
    those of its last days too (``recent``: all of them where the recent ones are fewer than ``min_fit``). ``tail_*`` are the scores over levels of ``tail`` and
    above, ``hit_*`` the share below the highest level, ``mean_pit*`` the mean probability integral transform.
    """
    from .evaluate import fold_of

    windows = ["expanding", *(["recent"] if recent_days else [])]
    rows = clusters.withColumns({"_kw_in": T.plus(end, embargo_days * T.DAY), "_kw_out": T.plus(end, (recent_days or 0) * T.DAY)})
    rows = rows.select(group_key(by).alias(GROUP), F.col(excess).cast("double").alias("x"), fold_of(start, test_start, months).cast("long").alias("fold"),
                       (fold_of("_kw_in", test_start, months) + 1).cast("long").alias("since"),
                       (fold_of("_kw_out", test_start, months) + 1 if recent_days else F.lit(NEVER)).cast("long").alias("until"))
    rows = rows.where(F.col("x").isNotNull())
    rows = cut_lineage(salted_join(rows, _cuts(rows, "x", SLICES, "_kw_cuts"), [GROUP], ["x"]).withColumn("slice", _slice("_kw_cuts", "x")).drop("_kw_cuts"))
    folds = rows.where("fold >= 0").groupBy(GROUP, "fold").agg(F.count(F.lit(1)).alias("n_test"))
    # Known values per slice and fold: running sums of what comes and goes. One row per (series, slice, fold, window).
    moves = rows.select(GROUP, "slice", "x", F.explode(F.array(*[
        F.struct(F.lit(w).alias("window"), F.col(c).alias("at"), F.lit(s).alias("d")) for w in windows for c, s in (("since", 1), *((("until", -1),) if w == "recent" else ()))])).alias("m"))
    moves = moves.groupBy(GROUP, "slice", "m.window", "m.at").agg(F.sum("m.d").alias("d"), F.sum(F.col("m.d") * F.col("x")).alias("dx"))
    asked = rows.select(GROUP, "slice").distinct().join(folds, GROUP).withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    both = moves.select(GROUP, "slice", "window", "at", "d", "dx", F.lit(None).cast("long").alias("n_test")).unionByName(
        asked.select(GROUP, "slice", "window", F.col("fold").alias("at"), F.lit(0).cast("long").alias("d"), F.lit(0.0).alias("dx"), "n_test"))
    running = Window.partitionBy(GROUP, "slice", "window").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counts = both.withColumns({"c": F.sum("d").over(running), "s": F.sum("dx").over(running)}).where("n_test is not null").withColumnRenamed("at", "fold")
    below = Window.partitionBy(GROUP, "window", "fold").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(GROUP, "window", "fold")
    counts = counts.withColumns({"before": F.coalesce(F.sum("c").over(below), F.lit(0)), "n": F.sum("c").over(whole), "mean": F.sum("s").over(whole) / F.sum("c").over(whole)})
    counts = cut_lineage(counts.where(F.col("n") >= min_fit).select(GROUP, "slice", "window", "fold", "n_test", "c", "before", "n", "mean"))
    marks = [float(u) for u in taus]
    at = (F.col("n") - 1) * F.col("l.u")
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(u).alias("u")) for i, u in enumerate(marks)]))
    wanted = counts.where("c > 0").withColumn("l", levels).withColumn("p", F.explode(F.array(
        F.struct(F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("weight")), F.struct((F.floor(at) + 1).alias("rank"), (at - F.floor(at)).alias("weight")))))
    wanted = wanted.where((F.col("p.weight") > 0) & (F.col("p.rank") >= F.col("before")) & (F.col("p.rank") < F.col("before") + F.col("c")))
    blank = {"x": "double", "since": "long", "until": "long", "window": "string", "fold": "long", "level": "int", "place": "long", "weight": "double"}

    def part(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        return df.select(GROUP, "slice", F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()])

    tests = rows.where("fold >= 0")
    parts = part(rows, 0, x=F.col("x"), since=F.col("since"), until=F.col("until")).unionByName(
        part(wanted, 1, fold=F.col("fold"), window=F.col("window"), level=F.col("l.level"), place=F.col("p.rank") - F.col("before"), weight=F.col("p.weight"))).unionByName(
        part(tests, 2, x=F.col("x"), fold=F.col("fold"))).unionByName(part(counts.select(GROUP, "slice", "window").distinct(), 3, window=F.col("window")))
    types = T_._parse_datatype_string(FOUND)
    schema = T_.StructType([parts.schema[GROUP], T_.StructField("slice", parts.schema["slice"].dataType), *types])

    def run(table: pa.Table) -> pa.Table:
        found = _picked(table)
        first = pa.array([0] * len(found), pa.int64())
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.float64()]
        return pa.Table.from_arrays([*(table.column(c).combine_chunks().take(first) for c in (GROUP, "slice")), *[pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)]],
                                    [GROUP, "slice", *types.names])

    found = cut_lineage(parts.groupBy(GROUP, "slice").applyInArrow(run, schema))
    quantile = found.where("kind = 1").groupBy(GROUP, "window", "fold", "level").agg(F.sum("v").alias("q"))
    tables = quantile.groupBy(GROUP, "window", "fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "q"))), lambda e: e["q"]).alias("q_emp"))  # one entry per level
    placed = tests.groupBy(GROUP, "slice", "fold").agg(F.count(F.lit(1)).alias("k"))
    pit = counts.join(placed, [GROUP, "slice", "fold"]).join(found.where("kind = 2").select(GROUP, "slice", "window", "fold", "v"), [GROUP, "slice", "window", "fold"])
    pit = pit.groupBy(GROUP, "window", "fold").agg((F.sum(F.col("before") * F.col("k") + F.col("v")) / F.sum(F.col("k") * F.col("n"))).alias("mean_pit_empirical"))
    model = counts.groupBy(GROUP, "window", "fold").agg(F.first("n").alias("n_fit"), F.first("mean").alias("mean")).join(tables, [GROUP, "window", "fold"]).join(pit, [GROUP, "window", "fold"], "left")
    if recent_days:  # the recent window falls back to the expanding one
        every = model.where("window = 'expanding'")
        thin = every.join(model.where("window = 'recent'").select(GROUP, "fold"), [GROUP, "fold"], "left_anti").withColumn("window", F.lit("recent"))
        model = model.unionByName(thin)
    scored = salted_join(tests.select(GROUP, "x", "fold"), model, [GROUP, "fold"], ["x"])
    u = F.array(*[F.lit(v) for v in marks])
    scored = scored.withColumn("q_exp", F.transform(u, lambda v: -F.log(1 - v) * F.col("mean")))

    def score(q: str, least: float) -> Column:
        loss = F.zip_with(F.col(q), u, lambda v, t: F.when(t >= least, F.greatest(t * (F.col("x") - v), (t - 1) * (F.col("x") - v))))
        return F.aggregate(F.filter(loss, lambda v: v.isNotNull()), F.lit(0.0), lambda a, b: a + b) / max(1, sum(v >= least for v in marks))

    hit = lambda q: F.avg((F.col("x") <= F.element_at(q, len(marks))).cast("double"))
    has_tail = any(v >= tail for v in marks)
    tails = [F.avg(score(q, tail)).alias(n) if has_tail else F.lit(None).cast("double").alias(n) for q, n in (("q_emp", "tail_empirical"), ("q_exp", "tail_exponential"))]
    out = scored.groupBy(GROUP, "fold", "window").agg(
        F.count(F.lit(1)).alias("n_test"), F.first("n_fit").alias("n_fit"), F.avg(score("q_emp", 0.0)).alias("score_empirical"), F.avg(score("q_exp", 0.0)).alias("score_exponential"),
        *tails, hit("q_emp").alias("hit_empirical"), hit("q_exp").alias("hit_exponential"), F.avg(1 - F.exp(-F.col("x") / F.col("mean"))).alias("mean_pit"),
        F.first("mean_pit_empirical").alias("mean_pit_empirical"))
    return out.select(*[F.col(GROUP)[c].alias(c) for c in by], *[c for c in out.columns if c != GROUP])
