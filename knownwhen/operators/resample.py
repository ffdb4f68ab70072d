"""Bootstrap intervals from weights of blocks: a draw is a list of how often each block counts, never a copy of rows.

Draws come from digests, so that any engine can repeat them: slot ``i`` of draw ``b`` takes block ``md5(seed|b|i) mod n``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import timeaxis as T
from ..functions.keys import match
from ..functions.numeric import draw
from ..session import cut_lineage
from . import ordered as O
from .ranks import quantiles, row_rank
from .sequences import episodes

CHUNK = 32  # draws of one row of block totals
WIDTH = 65536  # ranks of one task


def drawn_sums(totals: str, fields: Sequence[str], seed: int, b: Column) -> Column:
    """Struct of the sums of draw ``b`` over an array column of block totals."""
    t = F.col(totals)
    n = F.size(t)
    zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])

    def add(acc: Column, i: Column) -> Column:
        return F.transform(F.array(t[draw(seed, n, b, i).cast("int")]), lambda x: F.struct(*[(acc[f] + x[f]).alias(f) for f in fields]))[0]

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, add))


def with_draws(packed: DataFrame, draws: int) -> DataFrame:
    """Rows of block totals times draws (``_kw_b``): the arrays travel once per ``CHUNK`` draws and are multiplied inside the tasks."""
    chunks = -(-draws // CHUNK)
    spread = packed.withColumn("_kw_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition("_kw_c")
    return spread.withColumn("_kw_b", F.explode(F.sequence(F.col("_kw_c") * CHUNK, F.least((F.col("_kw_c") + 1) * CHUNK, F.lit(draws)) - 1))).drop("_kw_c")


def packed_totals(totals: DataFrame, by: Sequence[str], block: str, fields: Sequence[str], name: str) -> DataFrame:
    """One array of block totals per series, in the order of the blocks; its length is the number of blocks (days, weeks), not of rows."""
    return totals.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(block, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields]))).alias(name))


def block_bootstrap(blocks: DataFrame, by: Sequence[str], block: str, sums: Mapping[str, Column], statistic: Column, draws: int, seed: int,
                    levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval of a statistic of resampled block totals. Rows are summed per block first; a draw reads the totals by number inside
    its row, so nothing is shuffled per slot."""
    totals = blocks.groupBy(*by, block).agg(*[e.alias(n) for n, e in sums.items()])
    point = totals.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums]).select(*by, statistic.alias("estimate"))
    rows = with_draws(packed_totals(totals, by, block, list(sums), "_kw_t"), draws)
    stats = rows.select(*by, drawn_sums("_kw_t", list(sums), seed, F.col("_kw_b")).alias("_kw_s")).select(*by, "_kw_s.*").select(*by, statistic.alias("_kw_stat"))
    ci = stats.groupBy(*by).agg(F.percentile("_kw_stat", F.lit(levels[0])).alias("ci_low"), F.percentile("_kw_stat", F.lit(levels[1])).alias("ci_high"))
    return point.transform(match, ci, list(by)) if by else point.join(F.broadcast(ci))


def block_weights(n: int, draws: int, seed: int) -> np.ndarray:
    """``w[j, b]``: how often draw ``b`` takes block ``j``."""
    w = np.zeros((n, draws), np.int32)
    for b in range(draws):
        head = f"{seed}|{b}|".encode()
        picks = [int(hashlib.md5(head + str(i).encode()).hexdigest()[:8], 16) % n for i in range(n)]
        w[:, b] = np.bincount(picks, minlength=n)
    return w


def ap_difference(df: DataFrame, by: Sequence[str], block: str, y: str, first: str, second: str, row_id: str, draws: int, seed: int,
                  least: int = 5, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Average precision of ``second`` minus that of ``first``, with the percentile interval over resampled blocks.

    Each model's rows are ranked once. Ranks are cut into pieces of ``WIDTH``; a piece adds up, for all draws at once, the weights of its rows
    and of its positives, running totals over pieces follow, and a second pass gives every positive its weighted precision. Draws with fewer than
    ``least`` weighted positives are left out. Copies of a row count at one rank. Rows are shipped once per model and pass, draws never.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull())
    numbers = rows.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_kw_k"))
    numbers = O.row_index(numbers, by, block, "_kw_j", chunk="365 days").select(*by, block, (F.col("_kw_j") - 1).alias("_kw_j"))
    sizes = numbers.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("_kw_n"))
    models = F.explode(F.array(F.struct(F.lit(0).alias("m"), F.col(first).cast("double").alias("p")), F.struct(F.lit(1).alias("m"), F.col(second).cast("double").alias("p"))))
    long = rows.transform(match, numbers, [*by, block]).select(*by, "_kw_j", F.col(y).cast("double").alias("_kw_y"), F.col(row_id).alias("_kw_id"), models.alias("x"))
    long = row_rank(long.select(*by, "_kw_j", "_kw_y", "_kw_id", F.col("x.m").alias("_kw_m"), F.col("x.p").alias("_kw_p")), [*by, "_kw_m"], "_kw_p", "_kw_id", "_kw_r", descending=True)
    long = cut_lineage(long.transform(match, sizes, list(by)) if by else long.join(F.broadcast(sizes))).withColumn(O.GROUP, O.group_key(by)).withColumn("_kw_s", T.floor_div(F.col("_kw_r").cast("long") - 1, WIDTH))
    pieces = long.select(O.GROUP, "_kw_m", "_kw_s", "_kw_r", "_kw_j", "_kw_y", "_kw_n")
    key = [O.GROUP, "_kw_m", "_kw_s"]
    numbers_ = T_.ArrayType(T_.DoubleType())
    schema = pieces.select(*key).schema.add("a", numbers_).add("b", numbers_)

    def answer(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.Table:
        one = pa.array([0], pa.int64())
        return pa.Table.from_arrays([*(table.column(c).combine_chunks().take(one) for c in key), *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (a, b))], [*key, "a", "b"])

    def totals(table: pa.Table) -> pa.Table:
        w = block_weights(table.column("_kw_n")[0].as_py(), draws, seed)
        j, t = table.column("_kw_j").to_numpy(), table.column("_kw_y").to_numpy()
        every, hits = np.bincount(j, minlength=len(w)), np.bincount(j, weights=t, minlength=len(w))
        return answer(table, every @ w, hits @ w)

    sums = pieces.groupBy(*key).applyInArrow(totals, schema)
    cells = sums.select(*key, F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    before = Window.partitionBy(O.GROUP, "_kw_m", "i").orderBy("_kw_s").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.withColumns({"a0": F.coalesce(F.sum("x.a").over(before), F.lit(0.0)), "b0": F.coalesce(F.sum("x.b").over(before), F.lit(0.0))})
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda e: e[c]).alias(c)
    start = start.groupBy(*key).agg(listed("a0"), listed("b0"))

    def precision(left: pa.Table, right: pa.Table) -> pa.Table:
        w = block_weights(left.column("_kw_n")[0].as_py(), draws, seed)
        order = np.argsort(left.column("_kw_r").to_numpy())
        j, t = left.column("_kw_j").to_numpy()[order], left.column("_kw_y").to_numpy()[order]
        a, b = (np.array(right.column(c)[0].as_py()) for c in ("a0", "b0"))
        gain, hits = np.zeros(draws), np.zeros(draws)
        for k in range(0, len(j), 1024):
            part = w[j[k:k + 1024]].astype(float)
            good = part * t[k:k + 1024, None]
            upto, found = a + np.cumsum(part, axis=0), b + np.cumsum(good, axis=0)
            gain += np.where(upto > 0, good * found / np.maximum(upto, 1), 0).sum(0)
            hits += good.sum(0)
            a, b = upto[-1], found[-1]
        return answer(left, gain, hits)

    parts = pieces.groupBy(*key).cogroup(start.groupBy(*key)).applyInArrow(precision, schema)
    drawn = parts.select(O.GROUP, "_kw_m", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x")).groupBy(O.GROUP, "_kw_m", "i").agg(F.sum("x.a").alias("gain"), F.sum("x.b").alias("hits"))
    pick = lambda m: F.max(F.when(F.col("_kw_m") == m, F.col("gain") / F.nullif(F.col("hits"), F.lit(0.0))))
    stats = drawn.groupBy(O.GROUP, "i").agg(F.max("hits").alias("hits"), (pick(1) - pick(0)).alias("d")).where(F.col("hits") >= least)
    ci = stats.groupBy(O.GROUP).agg(F.count(F.lit(1)).alias("draws"), F.percentile("d", F.lit(levels[0])).alias("ci_low"), F.percentile("d", F.lit(levels[1])).alias("ci_high"))
    positives = long.where("_kw_y = 1").select(O.GROUP, "_kw_m", "_kw_r")
    numbered = O.row_index(positives.select(F.struct(O.GROUP, "_kw_m").alias("_kw_k"), "_kw_r"), ["_kw_k"], "_kw_r", "_kw_h", chunk=WIDTH)
    point = numbered.groupBy(F.col(f"_kw_k.{O.GROUP}").alias(O.GROUP), F.col("_kw_k._kw_m").alias("_kw_m")).agg(F.avg(F.col("_kw_h") / F.col("_kw_r")).alias("ap"))
    point = point.groupBy(O.GROUP).agg(*[F.max(F.when(F.col("_kw_m") == m, F.col("ap"))).alias(n) for m, n in ((0, "ap_first"), (1, "ap_second"))])
    out = point.join(ci, O.GROUP, "left")
    return out.select(*[F.col(O.GROUP)[c].alias(c) for c in by], "ap_first", "ap_second", (F.col("ap_second") - F.col("ap_first")).alias("difference"), "draws", "ci_low", "ci_high")


MEASURES = {"share": ("exceed", "n"), "episodes_per_week": ("episodes", "weeks"), "mean_length": ("length", "episodes"), "mean_excess": ("excess", "exceed")}


def effect_intervals(df: DataFrame, by: Sequence[str], ts: str, value: str, date: str, days: int, q: float, draws: int, seed: int, above: bool = True,
                     chunk: str | int = "7 days", levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Exceedances of a fixed pre-period threshold before and after a date: one row per series and measure with the ratio of both sides and
    its interval over resampled weeks, counted from the date; the weeks of the two sides are drawn apart. An episode belongs to the
    week it starts in. ``tail`` (the ``q`` quantile of each side) and ``extreme`` are differences without interval.
    """
    at = F.lit(date).cast("date").cast("timestamp_ntz")
    rows = df.where((F.col(ts) >= T.plus(at, -days * T.DAY)) & (F.col(ts) < T.plus(at, days * T.DAY))).select(*by, ts, value).where(F.col(value).isNotNull())
    rows = rows.withColumn("side", F.when(F.col(ts) < at, "pre").otherwise("post"))
    thr = quantiles(rows.where("side = 'pre'"), by, value, {"threshold": q})
    rows = (rows.transform(match, thr, list(by)) if by else rows.join(F.broadcast(thr))).withColumn("_kw_x", (F.col(value) - F.col("threshold")) * (1 if above else -1))
    rows = cut_lineage(rows.withColumn("week", T.floor_div(F.datediff(F.col(ts).cast("date"), F.lit(date).cast("date")).cast("long"), 7)))
    up = F.col("_kw_x") > 0
    weekly = rows.groupBy(*by, "side", "week").agg(F.count(F.lit(1)).alias("n"), F.count_if(up).alias("exceed"), F.sum(F.when(up, F.col("_kw_x"))).alias("excess"), F.lit(1).alias("weeks"))
    eps = episodes(rows, [*by, "side"], ts, up, chunk=chunk).withColumn("week", T.floor_div(F.datediff(F.col("start").cast("date"), F.lit(date).cast("date")).cast("long"), 7))
    eps = eps.groupBy(*by, "side", "week").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("length"))
    weekly = cut_lineage(weekly.transform(match, eps, [*by, "side", "week"], "left"))
    fields = ["n", "exceed", "excess", "weeks", "episodes", "length"]
    packed = packed_totals(weekly.where("side = 'pre'"), by, "week", fields, "_kw_pre").transform(match, packed_totals(weekly.where("side = 'post'"), by, "week", fields, "_kw_post"), list(by))
    whole = lambda c: F.aggregate(c, F.struct(*[F.lit(0.0).alias(f) for f in fields]), lambda a, x: F.struct(*[(a[f] + x[f]).alias(f) for f in fields]))
    per = lambda s, m: s[MEASURES[m][0]] / F.nullif(s[MEASURES[m][1]], F.lit(0.0))
    points = packed.select(*by, whole("_kw_pre").alias("a"), whole("_kw_post").alias("z"))
    points = points.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), per(F.col("a"), m).alias("pre"), per(F.col("z"), m).alias("post")) for m in MEASURES])).alias("e")).select(*by, "e.*")
    points = points.withColumn("effect", F.col("post") / F.nullif(F.col("pre"), F.lit(0.0)))
    drawn = with_draws(packed, draws).select(*by, drawn_sums("_kw_pre", fields, seed, F.col("_kw_b")).alias("a"), drawn_sums("_kw_post", fields, seed + 1, F.col("_kw_b")).alias("z"))
    ratios = drawn.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (per(F.col("z"), m) / F.nullif(per(F.col("a"), m), F.lit(0.0))).alias("r")) for m in MEASURES])).alias("e")).select(*by, "e.*")
    ci = ratios.groupBy(*by, "measure").agg(F.percentile("r", F.lit(levels[0])).alias("ci_low"), F.percentile("r", F.lit(levels[1])).alias("ci_high"))
    tails = quantiles(rows, [*by, "side"], value, {"tail": q}).transform(match, rows.groupBy(*by, "side").agg((F.max(value) if above else F.min(value)).alias("extreme")), [*by, "side"])
    tails = tails.unpivot([*by, "side"], ["tail", "extreme"], "measure", "v").groupBy(*by, "measure").agg(*[F.max(F.when(F.col("side") == s, F.col("v"))).alias(s) for s in ("pre", "post")])
    tails = tails.select(*by, "measure", "pre", "post", (F.col("post") - F.col("pre")).alias("effect"), F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"))
    return points.transform(match, ci, [*by, "measure"], "left").select(*tails.columns).unionByName(tails)
