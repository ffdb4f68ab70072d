"""Rolling-origin backtests: folds, scores, calibration, combination, classification, policies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..functions.numeric import clip, corr, pinball, smape_term
from ..session import cut_lineage
from . import ordered as O
from .asof import asof_join, prefix_at
from .pit import lagged_targets
from .ranks import _cuts, _slice, equal_bins, quantiles, ranked_values, row_rank, salted_join
from .sequences import episodes



# ---------------------------------------------------------------- baselines and folds
def naive_baselines(blocks: DataFrame, by: Sequence[str], slot: str, start: str, origin: str, known: str, target: str,
                    window: int = 7, chunk: str | int = "365 days") -> DataFrame:
    """``prev_slot``, ``prev_auction`` and ``roll_med`` (median of the last known same-slot results)."""
    rows = lagged_targets(blocks, by, slot, start, origin, known, [target], chunk)
    rows = rows.withColumnsRenamed({f"prev_slot__{target}": "prev_slot", f"prev_auction__{target}": "prev_auction"})
    x = F.col("prev_slot")
    return O.rolling_rows(rows, [*by, slot], start, {"roll_med": F.percentile(x, F.lit(0.5))}, window, x, max(2, window // 2), chunk=chunk)


def fold_of(ts: str, test_start: str, months: int) -> Column:
    """Fold number of a local date (-1 before the test period)."""
    year, month = (int(x) for x in test_start.split("-")[:2])
    serial = F.year(ts) * 12 + F.month(ts) - (year * 12 + month)
    day = F.lit(test_start).cast("date")
    return F.when(F.col(ts).cast("date") >= day, F.floor(serial / months)).otherwise(F.lit(-1)).cast("int")


def fold_start(fold: str | Column, test_start: str, months: int) -> Column:
    first = F.trunc(F.lit(test_start).cast("date"), "month")
    return F.add_months(first, (T.col(fold) * months).cast("int")).cast("timestamp_ntz")


def fold_plan(df: DataFrame, by: Sequence[str], start: str, end: str, test_start: str, months: int, min_train: int,
              embargo: str | int = 0, chunk: str | int = "365 days") -> DataFrame:
    """One row per usable fold: its start, training rows (ended before it, less the embargo) and test rows.

    Training counts are prefix counts at the fold starts, so no row meets a fold.
    """
    rows = df.withColumn("fold", fold_of(start, test_start, months))
    test = rows.where(F.col("fold") >= 0).groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n_test"))
    test = test.withColumn("fold_start", fold_start("fold", test_start, months)).withColumn("_kw_cut", T.plus("fold_start", -T.span(embargo)))
    out = prefix_at(test, df, "_kw_cut", end, by, {"n_train": F.lit(1).cast("long")}, chunk)
    return out.where(F.col("n_train") >= min_train).drop("_kw_cut")


def train_windows(folds: DataFrame, df: DataFrame, by: Sequence[str], start: str, end: str, months: int, min_train: int,
                  breaks: DataFrame | None = None, chunk: str | int = "365 days") -> DataFrame:
    """Sliding (``months`` back, at least ``min_train`` rows) and since-last-break training starts per fold.

    ``breaks`` has (key, break_at). Falls back to the ``min_train`` latest rows or to all rows.
    """
    f = folds.withColumn("sliding_start", F.add_months(F.col("fold_start").cast("date"), -months).cast("timestamp_ntz"))
    numbered = O.row_index(df.select(*by, start, end), by, end, "_kw_i", [start], chunk)
    f = prefix_at(f.withColumn("_kw_before", T.plus("sliding_start", -1)), df, "_kw_before", start, by, {"_kw_old": F.lit(1).cast("long")}, chunk)
    f = f.withColumn("n_sliding", F.greatest(F.col("n_train") - F.col("_kw_old"), F.lit(0)))
    f = f.withColumn("_kw_i", F.col("n_train") - min_train + 1)
    f = f.transform(match, numbered.select(*by, "_kw_i", F.col(start).alias("_kw_min_start")), [*by, "_kw_i"], "left")
    short = F.col("n_sliding") < min_train
    f = f.withColumns({"sliding_rule": F.when(short, "latest_rows").otherwise("months"),
                       "sliding_start": F.when(short, F.col("_kw_min_start")).otherwise(F.col("sliding_start"))})
    if breaks is not None:
        f = asof_join(f, breaks, "fold_start", "break_at", by, {"break_at": "regime_start"}, chunk=chunk)
    return f.drop("_kw_before", "_kw_old", "_kw_i", "_kw_min_start")


# ---------------------------------------------------------------- point and quantile scores
def long_predictions(df: DataFrame, keys: Sequence[str], y: str, models: Sequence[str]) -> DataFrame:
    """(keys, y, model, p) rows; rows on which any model or the target is missing are dropped for all."""
    common = df.dropna(subset=[y, *models])
    return common.select(*keys, F.col(y).cast("double").alias("y"), *[F.col(m).cast("double").alias(m) for m in models]).unpivot(
        [*keys, "y"], list(models), "model", "p")


def point_aggregates() -> list[Column]:
    e = F.col("p") - F.col("y")
    return [F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(smape_term("y", "p")).alias("smape"), F.avg(F.abs(F.asinh("p") - F.asinh("y"))).alias("mae_asinh"),
            F.avg(e).alias("bias"), F.avg((e > 0).cast("double")).alias("share_over"), F.max(F.abs(e)).alias("max_abs_error"),
            (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"), corr("p", "y").alias("corr")]


def point_metrics(preds: DataFrame, by: Sequence[str], baseline: str | None = None) -> DataFrame:
    """Scores of long predictions per group and model; skill against a baseline model in percent."""
    out = preds.groupBy(*by, "model").agg(*point_aggregates())
    if baseline is None:
        return out
    ref = out.where(F.col("model") == baseline).select(*by, F.col("mae").alias("_kw_ref"))
    out = out.transform(match, ref, list(by), "left") if by else out.join(F.broadcast(ref))
    return out.withColumn("skill", 100 * (1 - F.col("mae") / F.nullif(F.col("_kw_ref"), F.lit(0.0)))).drop("_kw_ref")


def metric_breakdown(preds: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The same scores pooled and by every dimension, for all models, in one pass."""
    labels = [F.struct(F.lit("pooled").alias("dimension"), F.lit("all").alias("label"))]
    labels += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dims]
    rows = preds.withColumn("_kw_d", F.explode(F.array(*labels)))
    return rows.groupBy(F.col("_kw_d.dimension").alias("dimension"), F.col("_kw_d.label").alias("label"), "model").agg(*point_aggregates())


def error_quantiles(preds: DataFrame, by: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    return quantiles(preds.withColumn("error", F.col("p") - F.col("y")), [*by, "model"], "error", qs)


def quantile_metrics(df: DataFrame, by: Sequence[str], y: str, levels: Mapping[float, str]) -> DataFrame:
    """Pinball loss and observed share below, per level."""
    cells = F.explode(F.array(*[F.struct(F.lit(float(l)).alias("level"), F.col(c).cast("double").alias("q")) for l, c in levels.items()]))
    rows = df.select(*by, F.col(y).cast("double").alias("y"), cells.alias("c")).select(*by, "y", "c.*").where(F.col("q").isNotNull() & F.col("y").isNotNull())
    return rows.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"), F.avg(pinball("y", "q", F.col("level"))).alias("pinball"),
                                          F.avg((F.col("y") <= F.col("q")).cast("double")).alias("observed_below"))


def interval_metrics(df: DataFrame, by: Sequence[str], y: str, low: str, high: str, levels: Mapping[float, str]) -> DataFrame:
    """Coverage and width of an interval, and the CRPS as twice the mean pinball loss over the levels."""
    inside = (F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))
    losses = [pinball(y, c, l) for l, c in levels.items()]
    crps = 2 * sum(losses[1:], losses[0]) / len(losses)
    rows = df.where(F.col(low).isNotNull() & F.col(high).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"),
                                 F.avg(F.col(high) - F.col(low)).alias("width"), F.avg(crps).alias("crps"))


# ---------------------------------------------------------------- sequential calibration
def earlier_folds_rank(df: DataFrame, by: Sequence[str], fold: str, value: str, rank_of: Column, min_n: int, slices: int = 64) -> DataFrame:
    """For each fold the value of a given rank among all earlier folds of its series.

    ``rank_of`` computes the 1-based rank from the column ``n`` (number of earlier values).
    The values are cut into slices; cumulative slice counts tell in which slice the rank lies,
    and only that slice is looked at value by value, so rows do not meet every later fold.
    """
    rows = df.where(F.col(value).isNotNull()).select(O.group_key(by).alias(O.GROUP), F.col(fold).alias("_kw_f"), F.col(value).cast("double").alias("_kw_v"))
    sliced = salted_join(rows, _cuts(rows, "_kw_v", slices, "_kw_cuts"), [O.GROUP], ["_kw_v", "_kw_f"])
    sliced = sliced.withColumn("_kw_s", _slice("_kw_cuts", "_kw_v", slices)).drop("_kw_cuts")
    cells = sliced.groupBy(O.GROUP, "_kw_s", "_kw_f", "_kw_v").agg(F.count(F.lit(1)).alias("_kw_n"))
    hist = cells.groupBy(O.GROUP, "_kw_s", "_kw_f").agg(F.sum("_kw_n").alias("_kw_n"))
    targets = df.select(O.group_key(by).alias(O.GROUP), F.col(fold).alias("_kw_t")).distinct()
    # Histogram rows (slices x folds per series) meet the later folds; data rows do not.
    past = hist.join(targets, O.GROUP).where(F.col("_kw_f") < F.col("_kw_t")).groupBy(O.GROUP, "_kw_t", "_kw_s").agg(F.sum("_kw_n").alias("_kw_n"))
    w = Window.partitionBy(O.GROUP, "_kw_t")
    past = past.withColumns({"n": F.sum("_kw_n").over(w), "_kw_before": F.sum("_kw_n").over(w.orderBy("_kw_s")) - F.col("_kw_n")})
    past = past.where(F.col("n") >= min_n).withColumn("_kw_r", F.least(rank_of, F.col("n")))
    spot = past.where((F.col("_kw_before") < F.col("_kw_r")) & (F.col("_kw_r") <= F.col("_kw_before") + F.col("_kw_n")))
    spot = spot.select(O.GROUP, "_kw_t", "_kw_s", "n", (F.col("_kw_r") - F.col("_kw_before")).alias("_kw_r"))
    near = cells.join(spot, [O.GROUP, "_kw_s"]).where(F.col("_kw_f") < F.col("_kw_t"))
    near = near.groupBy(O.GROUP, "_kw_t", "n", "_kw_r", "_kw_v").agg(F.sum("_kw_n").alias("_kw_n"))
    run = F.sum("_kw_n").over(Window.partitionBy(O.GROUP, "_kw_t").orderBy("_kw_v"))
    near = near.withColumn("_kw_c", run).where(F.col("_kw_c") >= F.col("_kw_r"))
    out = near.groupBy(O.GROUP, "_kw_t", "n").agg(F.min("_kw_v").alias("value"))
    return out.select(*[F.col(O.GROUP)[c].alias(c) for c in by], F.col("_kw_t").alias(fold), F.col("n").alias("n_past"), "value")


def conformal(df: DataFrame, by: Sequence[str], fold: str, y: str, low: str, high: str, level: int, min_scores: int = 30) -> DataFrame:
    """Sequential conformal adjustment of an interval on the asinh scale.

    Each fold is widened by the finite-sample quantile (next higher order statistic) of the
    conformity scores of all earlier folds; folds with too few scores stay NULL.
    """
    rows = df.withColumns({"_kw_lo": F.asinh(low), "_kw_hi": F.asinh(high), "_kw_y": F.asinh(y)})
    rows = rows.withColumn("_kw_score", F.greatest(F.col("_kw_lo") - F.col("_kw_y"), F.col("_kw_y") - F.col("_kw_hi")))
    rows = rows.withColumn("_kw_score", F.when(F.col("_kw_lo").isNotNull() & F.col("_kw_hi").isNotNull() & F.col("_kw_y").isNotNull(), F.col("_kw_score")))
    share = F.least(F.ceil((F.col("n") + 1) * level / 100) / F.col("n"), F.lit(1.0))
    # The product can miss an integer by rounding; ranks are whole numbers.
    rank = F.ceil(F.round((F.col("n") - 1) * share, 9)) + 1
    q = earlier_folds_rank(rows, by, fold, "_kw_score", rank, min_scores).withColumnRenamed("value", "_kw_q")
    out = rows.transform(match, q, [*by, fold], "left")
    return out.withColumns({"low_adjusted": F.sinh(F.col("_kw_lo") - F.col("_kw_q")), "high_adjusted": F.sinh(F.col("_kw_hi") + F.col("_kw_q"))}).drop(
        "_kw_lo", "_kw_hi", "_kw_y", "_kw_score", "_kw_q", "n_past")


def combine(df: DataFrame, by: Sequence[str], fold: str, y: str, models: Sequence[str], min_hist: int, top: int = 3) -> DataFrame:
    """Equal, median, best-past, top-k and inverse-MAE combinations from earlier folds only.

    Errors are summed per (series, fold); a fold sees the running sums of the folds before it.
    Until ``min_hist`` past rows exist the weights are equal.
    """
    rows = df.dropna(subset=[y, *models])
    errors = rows.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("_kw_n"), *[F.sum(F.abs(F.col(m) - F.col(y))).alias(f"_kw_{i}") for i, m in enumerate(models)])
    past = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    k = len(models)
    weights = errors.select(*by, fold, F.coalesce(F.sum("_kw_n").over(past), F.lit(0)).alias("n_past"),
                            F.array(*[F.sum(f"_kw_{i}").over(past) for i in range(k)]).alias("_kw_e"))
    ready = F.col("n_past") >= min_hist
    mae = F.transform("_kw_e", lambda e: e / F.col("n_past"))
    order = F.array_sort(F.transform(mae, lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
    inverse = F.transform(mae, lambda m: 1 / m)
    total = F.aggregate(inverse, F.lit(0.0), lambda a, x: a + x)
    equal = F.array(*[F.lit(1.0 / k)] * k)
    pick = lambda n: F.transform(F.array(*[F.lit(i) for i in range(k)]), lambda i: F.when(
        F.exists(F.slice(order, 1, n), lambda s: s["i"] == i), 1.0 / min(n, k)).otherwise(F.lit(0.0)))
    weights = weights.select(*by, fold, "n_past", F.when(ready, F.transform(inverse, lambda x: x / total)).otherwise(equal).alias("_kw_inv"),
                             F.when(ready, pick(1)).otherwise(equal).alias("_kw_best"), F.when(ready, pick(top)).otherwise(equal).alias("_kw_top"))
    out = rows.transform(match, weights, [*by, fold])
    p = F.array(*[F.col(m).cast("double") for m in models])
    dot = lambda w: F.aggregate(F.zip_with(p, F.col(w), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    s = F.array_sort(p)
    median = (F.element_at(s, (k + 1) // 2) + F.element_at(s, k // 2 + 1)) / 2
    return out.withColumns({"c_average": F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / k, "c_median": median, "c_best_past": dot("_kw_best"),
                            "c_top": dot("_kw_top"), "c_inverse_mae": dot("_kw_inv")}).drop("_kw_inv", "_kw_best", "_kw_top")


def compare_runs(a: DataFrame, b: DataFrame, key: Sequence[str], y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Two variants on their common rows: MAE of both and the change in percent."""
    right = b.select(*key, F.col(p).alias("_kw_p"))
    both = a.transform(match, right, list(key)).where(F.col(p).isNotNull() & F.col("_kw_p").isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae_a"), F.avg(F.abs(F.col("_kw_p") - F.col(y))).alias("mae_b"))
    return out.withColumn("change", 100 * (F.col("mae_b") / F.nullif(F.col("mae_a"), F.lit(0.0)) - 1))


def compare_variants(df: DataFrame, by: Sequence[str], order: str, y: str, first: str, second: str, baseline: str, period: Column, lags: int,
                     pooled: str = "all", alpha: float = 0.05, min_n: int = 30) -> DataFrame:
    """Two forecasts on the rows where both and the baseline are known, per period and over all of it (``pooled``): errors, skill against the
    baseline, the Diebold-Mariano statistic of their absolute errors and, for a period, whether it points the way of the pooled one
    (``agrees``) and is beyond chance itself (``sure``); both NULL where either test is missing.
    """
    from .stats import dm_test

    rows = df.where(F.col(y).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(baseline).isNotNull())
    error = lambda c: F.abs(F.col(c) - F.col(y))
    rows = rows.withColumn("period", F.explode(F.array(F.lit(pooled), period.cast("string"))))
    rows = cut_lineage(rows.select(*by, "period", order, error(first).alias("_kw_a"), error(second).alias("_kw_b"), error(baseline).alias("_kw_0"), (error(second) - error(first)).alias("_kw_d")))
    keys = [*by, "period"]
    mean = rows.groupBy(*keys).agg(F.avg("_kw_a").alias("mae_first"), F.avg("_kw_b").alias("mae_second"), F.avg("_kw_0").alias("_kw_base"))
    skill = lambda c: 100 * (1 - F.col(c) / F.nullif(F.col("_kw_base"), F.lit(0.0)))
    mean = mean.withColumns({"skill_first": skill("mae_first"), "skill_second": skill("mae_second")}).drop("_kw_base")
    tests = cut_lineage(dm_test(rows, keys, order, "_kw_d", lags, min_n).select(*keys, "n", "stat", "p"))
    whole = tests.where(F.col("period") == pooled).select(*by, F.col("stat").alias("_kw_all"))
    out = mean.transform(match, tests, keys).transform(match, whole, list(by), "left")
    part = F.col("period") != pooled
    tested = F.col("stat").isNotNull() & F.col("_kw_all").isNotNull()
    return out.withColumns({"agrees": F.when(part & tested, F.col("stat") * F.col("_kw_all") > 0), "sure": F.when(part & tested, F.col("p") < alpha)}).drop("_kw_all")


def stability(metrics: DataFrame, by: Sequence[str], period: str, model: str, loss: str, pooled: str = "all") -> DataFrame:
    """Per series: pooled best model, how often it wins a sub-period, and its mean rank there."""
    w = Window.partitionBy(*by, period).orderBy(loss, model)
    ranked = metrics.withColumn("_kw_r", F.row_number().over(w))
    best = ranked.where((F.col(period) == pooled) & (F.col("_kw_r") == 1)).select(*by, F.col(model).alias("pooled_best"))
    sub = ranked.where(F.col(period) != pooled).transform(match, best, list(by))
    mine = F.when(F.col(model) == F.col("pooled_best"), F.col("_kw_r"))
    return sub.groupBy(*by, "pooled_best").agg(F.count(mine).alias("periods"), F.count_if(mine == 1).alias("wins"), F.avg(mine).alias("mean_rank"), F.max(mine).alias("worst_rank"))


# ---------------------------------------------------------------- probabilities
def class_metrics(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Brier, log loss, ROC-AUC (average ranks), base rate, mean prediction and their ratio."""
    yy = F.col(y).cast("double")
    rows = df.where(yy.isNotNull() & F.col(p).isNotNull())
    q = clip(F.col(p), 1e-9, 1 - 1e-9)
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(yy).alias("pos"), F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier"),
        (-F.avg(yy * F.log(q) + (1 - yy) * F.log(1 - q))).alias("logloss"), F.avg(yy).alias("base_rate"), F.avg(p).alias("mean_pred"))
    table = ranked_values(rows, by, p, {"hits": yy})
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    sums = table.groupBy(*by).agg(F.sum(rank * F.col("hits")).alias("_kw_r")) if by else table.agg(F.sum(rank * F.col("hits")).alias("_kw_r"))
    out = base.transform(match, sums, list(by)) if by else base.join(F.broadcast(sums))
    n1, n0 = F.col("pos"), F.col("n") - F.col("pos")
    return out.withColumns({"roc_auc": (F.col("_kw_r") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0)),
                            "observed_over_expected": F.col("base_rate") / F.greatest("mean_pred", F.lit(1e-12))}).drop("_kw_r")


def average_precision(df: DataFrame, by: Sequence[str], y: str, p: str, row_id: str) -> DataFrame:
    """Mean precision at the positive rows, ordered by falling probability, ties by row id.

    The rank among all rows and the rank among the positives give the precision at each positive.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    every = row_rank(rows, by, p, row_id, "_kw_all", descending=True).where(F.col(y) == 1)
    hits = row_rank(rows.where(F.col(y) == 1), by, p, row_id, "_kw_hit", descending=True).select(*by, row_id, "_kw_hit")
    both = every.transform(match, hits, [*by, row_id])
    return both.groupBy(*by).agg(F.avg(F.col("_kw_hit") / F.col("_kw_all")).alias("average_precision"))


def reliability(df: DataFrame, by: Sequence[str], y: str, p: str, row_id: str, k: int = 10) -> DataFrame:
    """Mean prediction and observed rate per equal-count bin of the prediction."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return equal_bins(rows, by, p, row_id, k).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def murphy(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reliability, resolution, uncertainty and calibration error from a reliability table."""
    keys = list(by) or [F.lit("all").alias("_kw_all")]
    n = F.col("n")
    total = table.groupBy(*keys).agg(F.sum("n").alias("_kw_n"), (F.sum(n * F.col("observed")) / F.sum("n")).alias("_kw_y"))
    names = list(by) or ["_kw_all"]
    rows = (table if by else table.withColumn("_kw_all", F.lit("all"))).transform(match, total, names)
    gap, lift = F.col("predicted") - F.col("observed"), F.col("observed") - F.col("_kw_y")
    out = rows.groupBy(*names).agg(
        (F.sum(n * gap * gap) / F.first("_kw_n")).alias("rel"), (F.sum(n * lift * lift) / F.first("_kw_n")).alias("res"),
        F.first(F.col("_kw_y") * (1 - F.col("_kw_y"))).alias("unc"), (F.sum(n * F.abs(gap)) / F.first("_kw_n")).alias("ece"))
    return out if by else out.drop("_kw_all")


def brier_skill(df: DataFrame, by: Sequence[str], y: str, models: Sequence[str], baselines: Sequence[str]) -> DataFrame:
    """Brier score of every model and its skill against the best baseline of its group."""
    rows = long_predictions(df, by, y, [*models, *baselines])
    scores = rows.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    base = scores.where(F.col("model").isin(*baselines))
    best = base.groupBy(*by).agg(F.min_by("model", F.struct("brier", "model")).alias("baseline"), F.min("brier").alias("_kw_b"))
    out = scores.transform(match, best, list(by)) if by else scores.join(F.broadcast(best))
    return out.withColumn("skill", 1 - F.col("brier") / F.nullif(F.col("_kw_b"), F.lit(0.0))).drop("_kw_b")


def capture(df: DataFrame, by: Sequence[str], score: str, amount: Column, row_id: str, shares: Sequence[float]) -> DataFrame:
    """Share of an amount found in the top x % of rows by score, with precision-style lift."""
    ranked = row_rank(df.where(F.col(score).isNotNull()), by, score, row_id, "_kw_rank", "_kw_rows", descending=True)
    aggs = [F.sum(amount).alias("_kw_total"), F.first("_kw_rows").alias("n")]
    for i, s in enumerate(shares):
        k = F.greatest(F.floor(F.col("_kw_rows") * F.lit(float(s))), F.lit(1))
        aggs += [F.sum(F.when(F.col("_kw_rank") <= k, amount)).alias(f"_kw_a{i}"), F.max(k).alias(f"_kw_k{i}")]
    wide = ranked.groupBy(*by).agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("top_share"), F.col(f"_kw_k{i}").alias("k"), F.col(f"_kw_a{i}").cast("double").alias("amount"))
                                for i, s in enumerate(shares)]))
    out = wide.select(*by, "n", "_kw_total", cells.alias("c")).select(*by, "n", "_kw_total", "c.*")
    share = F.col("amount") / F.nullif(F.col("_kw_total").cast("double"), F.lit(0.0))
    return out.withColumns({"captured": share, "mean_in_top": F.col("amount") / F.col("k"), "lift": share * F.col("n") / F.col("k")}).drop("_kw_total", "amount")


# Fixed values of the distribution between and beyond quantiles.
EQUAL_QUANTILES = 1e-9   # neighbours closer than this give no slope
FLAT_UPPER_TAIL = 1e-3   # share of the last survival left beyond equal top quantiles
FLAT_LOWER_RATE = 50.0   # rate of the lower tail beyond equal bottom quantiles
SURE = 1e-5              # probabilities stay this far from 0 and 1


def prob_above(df: DataFrame, levels: Sequence[float], columns: Sequence[str], name: str = "p_above") -> DataFrame:
    """P(value > 0) from ascending quantiles.

    Survival falls by a constant hazard between two quantiles, so the cumulated hazard at 0 is that of the first level plus, for each
    pair of neighbours, the part of their hazard that lies below 0. The last pair's rate goes on above the top quantile. Below the
    bottom quantile the distribution function falls at the rate of the first pair.
    """
    hazard = [-math.log1p(-t) for t in levels]
    q = [F.col(c).cast("double") for c in columns]
    below = lambda x: F.greatest(-x, F.lit(0.0))
    total = F.lit(hazard[0])
    for i, (left, right) in enumerate(zip(q, q[1:])):
        part = F.when(right <= 0, F.lit(1.0)).otherwise(below(left) / F.nullif(right - left, F.lit(0.0)))
        total = total + F.when(left >= 0, F.lit(0.0)).otherwise(part) * (hazard[i + 1] - hazard[i])
    width = q[-1] - q[-2]
    beyond = F.when(width > EQUAL_QUANTILES, below(q[-1]) * (hazard[-1] - hazard[-2]) / F.nullif(width, F.lit(0.0))).otherwise(-math.log(FLAT_UPPER_TAIL))
    total = total + F.when(q[-1] <= 0, beyond).otherwise(F.lit(0.0))
    first = q[1] - q[0]
    rate = F.when(first > EQUAL_QUANTILES, (math.log(levels[1]) - math.log(levels[0])) / F.nullif(first, F.lit(0.0))).otherwise(F.lit(FLAT_LOWER_RATE))
    lower = -F.expm1(F.lit(math.log(levels[0])) - rate * q[0])
    return df.withColumn(name, clip(F.when(q[0] > 0, lower).otherwise(F.exp(-total)), SURE, 1 - SURE))


# ---------------------------------------------------------------- exceedances and interventions
def calendar_lift(df: DataFrame, dims: Mapping[str, Column], outcome: Column) -> DataFrame:
    """Share of an outcome per calendar label, relative to the overall share."""
    labels = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("label")) for n, c in dims.items()]))
    rows = df.where(outcome.isNotNull()).select(outcome.cast("double").alias("o"), labels.alias("d"))
    out = rows.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("o").alias("share"))
    total = df.where(outcome.isNotNull()).agg(F.avg(outcome.cast("double")).alias("_kw_base"))
    return out.join(F.broadcast(total)).withColumn("lift", F.col("share") / F.nullif(F.col("_kw_base"), F.lit(0.0))).drop("_kw_base")


def intervention_effect(df: DataFrame, by: Sequence[str], ts: str, value: str, date: str, days: int, q: float, above: bool = True,
                        placebo_days: int | None = None, chunk: str | int = "7 days") -> DataFrame:
    """Exceedances of a fixed pre-period threshold before and after a date, and their ratio.

    The threshold is the pre-period quantile of each series. With ``placebo_days`` the design
    is repeated at an earlier date.
    """
    designs = {"real": 0, **({"placebo": placebo_days} if placebo_days else {})}
    out = None
    for design, shift in designs.items():
        at = F.date_sub(F.lit(date).cast("date"), shift).cast("timestamp_ntz")
        low, high = T.plus(at, -days * T.DAY), T.plus(at, days * T.DAY)
        rows = df.where((F.col(ts) >= low) & (F.col(ts) < high)).select(*by, ts, value)
        rows = rows.withColumn("side", F.when(F.col(ts) < at, "pre").otherwise("post"))
        thr = quantiles(rows.where(F.col("side") == "pre"), by, value, {"threshold": q})
        rows = rows.transform(match, thr, list(by))
        excess = (F.col(value) - F.col("threshold")) * (1 if above else -1)
        rows = cut_lineage(rows.withColumn("_kw_x", excess))
        share = rows.groupBy(*by, "side").agg(
            F.count(value).alias("n"), F.count_if(F.col("_kw_x") > 0).alias("n_exceed"), F.avg(F.when(F.col("_kw_x") > 0, F.col("_kw_x"))).alias("mean_excess"),
            F.max("threshold").alias("threshold"))
        eps = episodes(rows, [*by, "side"], ts, F.col("_kw_x") > 0, chunk=chunk)
        eps = eps.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("episodes"), F.avg("length").alias("mean_length"))
        both = share.transform(match, eps, [*by, "side"], "left").withColumns({
            "share": F.col("n_exceed") / F.nullif(F.col("n"), F.lit(0)), "episodes_per_week": F.coalesce(F.col("episodes"), F.lit(0)) / (days / 7)})
        measures = ["share", "episodes_per_week", "mean_length", "mean_excess"]
        pick = lambda m, s: F.max(F.when(F.col("side") == s, F.col(m)))
        wide = both.groupBy(*by).agg(F.max("threshold").alias("threshold"), *[pick(m, s).alias(f"{m}_{s}") for m in measures for s in ("pre", "post")])
        wide = wide.withColumns({f"{m}_ratio": F.col(f"{m}_post") / F.nullif(F.col(f"{m}_pre"), F.lit(0.0)) for m in measures}).withColumn("design", F.lit(design))
        out = wide if out is None else out.unionByName(wide)
    return out


# ---------------------------------------------------------------- bid policies
def revenue(bid: str | Column, cleared: str | Column) -> Column:
    """Pay-as-bid revenue of a unit bid against the highest accepted bid."""
    b = F.greatest(T.col(bid), F.lit(0.0))
    return F.when(T.col(bid).isNotNull() & (b <= T.col(cleared) + 1e-9), b).otherwise(F.lit(0.0))


def policy_backtest(df: DataFrame, by: Sequence[str], cleared: str, policies: Sequence[str]) -> DataFrame:
    """Revenue, win rate, share of the perfect bid and value loss of each policy."""
    rows = df.where(F.col(cleared).isNotNull())
    long = rows.select(*by, F.col(cleared).alias("c"), *[F.col(p).cast("double").alias(p) for p in policies]).unpivot([*by, "c"], list(policies), "policy", "bid")
    rev, best = revenue("bid", "c"), revenue("c", "c")
    won = F.coalesce(F.greatest(F.col("bid"), F.lit(0.0)) <= F.col("c") + 1e-9, F.lit(False))
    won = F.col("bid").isNotNull() & won
    return long.groupBy(*by, "policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rev).alias("revenue"), F.avg(won.cast("double")).alias("win_rate"),
        (F.sum(rev) / F.nullif(F.sum(best), F.lit(0.0))).alias("share_of_oracle"), (F.avg(best) - F.avg(rev)).alias("value_loss"), F.avg("bid").alias("mean_bid"))


def choose_monthly(df: DataFrame, by: Sequence[str], start: str, cleared: str, candidates: Mapping[str, Column], fallback: str, lookback_days: int,
                   min_past: int, known_after: str | int = "24 hours") -> DataFrame:
    """Each month the candidate bid with the highest mean revenue on the known rows of the days before.

    A row is known some time after its start and counts for the months whose look-back covers
    it, at most ``lookback_days / 28 + 1`` of them: it is copied to those month starts, summed
    map-side per (series, month), and the winner joins back on the month.
    """
    names = list(candidates)
    rows = df.withColumns({f"_kw_b{i}": c.cast("double") for i, c in enumerate(candidates.values())})
    rows = rows.withColumn("month", F.date_trunc("month", start).cast("timestamp_ntz"))
    complete = None
    for i in range(len(names)):
        term = F.col(f"_kw_b{i}").isNotNull()
        complete = term if complete is None else complete & term
    reach = lookback_days // 28 + 2
    ahead = rows.where(complete).withColumn("_kw_m", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(reach)), lambda k: F.add_months(F.trunc(start, "month"), k).cast("timestamp_ntz"))))
    ahead = ahead.where((T.plus(start, T.span(known_after)) <= F.col("_kw_m")) & (F.col(start) >= T.plus("_kw_m", -lookback_days * T.DAY)))
    sums = ahead.groupBy(*by, F.col("_kw_m").alias("month")).agg(
        F.count(F.lit(1)).alias("n_past"), *[F.avg(revenue(f"_kw_b{i}", cleared)).alias(f"_kw_r{i}") for i in range(len(names))])
    best = F.array_max(F.array(*[F.struct(F.col(f"_kw_r{i}").alias("r"), F.lit(-i).alias("i")) for i in range(len(names))]))
    choice = sums.select(*by, "month", "n_past", F.when(F.col("n_past") >= min_past, -best["i"]).otherwise(F.lit(names.index(fallback))).alias("_kw_j"))
    out = rows.transform(match, choice, [*by, "month"], "left").withColumn("_kw_j", F.coalesce("_kw_j", F.lit(names.index(fallback))))
    bids = F.array(*[F.col(f"_kw_b{i}") for i in range(len(names))])
    labels = F.array(*[F.lit(n) for n in names])
    out = out.withColumns({"chosen": F.get(labels, F.col("_kw_j")), "bid": F.get(bids, F.col("_kw_j")), "n_past": F.coalesce("n_past", F.lit(0))})
    return out.drop("_kw_j", *[f"_kw_b{i}" for i in range(len(names))])


def fixed_window_bids(df: DataFrame, by: Sequence[str], start: str, value: str, windows: Sequence[int], known_after: str | int = "24 hours",
                      tolerance: str | int = "4 hours", chunk: str | int = "30 days") -> DataFrame:
    """Median of the results of the last days that are known at the start of a row."""
    known = df.where(F.col(value).isNotNull()).select(*by, T.plus(start, T.span(known_after)).alias("_kw_t"), F.col(value).cast("double").alias("_kw_v"))
    for w in windows:
        known = O.rolling_time(known, by, "_kw_t", {f"fixed_{w}d": F.percentile("_kw_v", F.lit(0.5))}, w * T.DAY - 1)
    return asof_join(df, known.drop("_kw_v"), start, "_kw_t", by, {f"fixed_{w}d": f"fixed_{w}d" for w in windows}, tolerance=tolerance, chunk=chunk)


def pool(frames: Mapping[str, DataFrame], scale_on: str, ts: str, since: str) -> DataFrame:
    """Stacks series with an identity column and the standard deviation of each in a window."""
    from .shaping import union_all

    out = union_all(list(frames.values()), "series", list(frames))
    scale = out.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz")).groupBy("series").agg(F.stddev_samp(scale_on).alias("scale"))
    return out.join(scale, "series", "left")


# ---------------------------------------------------------------- models per fold
def ridge_backtest(df: DataFrame, by: Sequence[str], fold: str, y: str, xs: Sequence[str], alpha: float, bound: float = 5.0) -> DataFrame:
    """Expanding-window ridge forecasts: every fold is predicted from all earlier folds.

    Per fold the features are standardised with the moments of its own training rows, clipped
    and imputed with 0. Moments come from running sums over folds; training rows then meet the
    folds that use them and are reduced map-side to one Gram matrix per (series, fold); the
    solve is on that small matrix.
    """
    k = len(xs)
    rows = df.where(F.col(y).isNotNull())
    per = rows.groupBy(*by, fold).agg(*[a for i, x in enumerate(xs) for a in (
        F.count(x).alias(f"_kw_c{i}"), F.sum(F.col(x).cast("double")).alias(f"_kw_s{i}"), F.sum(F.col(x).cast("double") * F.col(x)).alias(f"_kw_q{i}"))])
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, i: F.sum(f"_kw_{c}{i}").over(w)
    moments = per.select(*by, fold, *[c for i in range(k) for c in (
        (total("s", i) / F.nullif(total("c", i), F.lit(0))).alias(f"_kw_m{i}"),
        F.sqrt(F.greatest(total("q", i) / F.nullif(total("c", i), F.lit(0)) - F.pow(total("s", i) / F.nullif(total("c", i), F.lit(0)), F.lit(2)), F.lit(0.0))).alias(f"_kw_d{i}"))])

    def z(i: int) -> Column:
        scaled = (F.col(xs[i]) - F.col(f"_kw_m{i}")) / F.nullif(F.col(f"_kw_d{i}"), F.lit(0.0))
        return F.coalesce(clip(scaled, -bound, bound), F.lit(0.0))

    keyed = moments.withColumnRenamed(fold, "_kw_fold")
    pairs = rows.transform(match, keyed, list(by)) if by else rows.join(F.broadcast(keyed))
    train = pairs.where(F.col(fold) < F.col("_kw_fold"))
    cols = [F.lit(1.0), *[z(i) for i in range(k)], F.col(y).cast("double")]
    size = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(size) for j in range(i, size)]
    grams = train.groupBy(*by, "_kw_fold").agg(*sums)
    flat = F.array(*[F.col(f"g_{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    grams = grams.select(*by, "_kw_fold", flat.alias("g"))
    types = {f.name: f.dataType.simpleString() for f in grams.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in (*by, "_kw_fold")] + ["_kw_beta array<double>"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec in batch.to_dict("records"):
                g = np.asarray(rec["g"], dtype=float).reshape(size, size)
                xs_, ym = slice(1, size - 1), g[0, -1] / g[0, 0]
                lhs = g[xs_, xs_] + alpha * np.eye(k)
                beta = np.linalg.solve(lhs, g[xs_, -1] - ym * g[xs_, 0])
                out.append([*[rec[c] for c in by], rec["_kw_fold"], [float(ym), *beta.tolist()]])
            yield pd.DataFrame(out, columns=[*by, "_kw_fold", "_kw_beta"])

    fits = grams.mapInPandas(solve, schema)
    test = pairs.where(F.col(fold) == F.col("_kw_fold")).transform(match, fits, [*by, "_kw_fold"])
    pred = F.col("_kw_beta")[0] + sum((F.col("_kw_beta")[i + 1] * z(i) for i in range(k)), F.lit(0.0))
    return test.withColumn("p", pred).select(*df.columns, "p")


# ---------------------------------------------------------------- recurring events
def fit_recurrence(df: DataFrame, by: Sequence[str], start: str, end: str, min_years: int = 3) -> DataFrame:
    """Per recurring event: modal ISO week and weekday against modal Easter offset, and modal length."""
    from ..functions.calendar import easter

    once = df.select(*by, F.col(start).cast("date").alias("s"), F.datediff(end, start).alias("length")).groupBy(*by, "s").agg(F.min("length").alias("length"))
    rows = once.withColumns({"iso_week": F.weekofyear("s"), "iso_weekday": F.weekday("s"), "easter_offset": F.datediff("s", easter(F.year("s")))})

    def modal(cols: Sequence[str], name: str, hits: str) -> DataFrame:
        counts = rows.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("k"))
        value = F.struct(*cols)
        return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("k"), *[-F.col(c) for c in cols])).alias(name), F.max("k").alias(hits))

    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("years")).where(F.col("years") >= min_years)
    out = n.join(modal(["iso_week", "iso_weekday"], "i", "iso_hits"), list(by)).join(modal(["easter_offset"], "e", "easter_hits"), list(by)).join(
        modal(["length"], "l", "length_hits"), list(by))
    return out.select(*by, "years", F.when(F.col("easter_hits") > F.col("iso_hits"), "easter").otherwise("iso").alias("rule"), "i.iso_week", "i.iso_weekday",
                      "e.easter_offset", F.col("l.length").alias("length_days"), F.greatest("iso_hits", "easter_hits").alias("hits"))


def apply_recurrence(rules: DataFrame, by: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Predicted start and end dates of every rule in the given years."""
    from ..functions.calendar import easter, iso_week_date

    rows = rules.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    start = F.when(F.col("rule") == "easter", F.date_add(easter("year"), F.col("easter_offset"))).otherwise(
        iso_week_date(F.col("year"), F.col("iso_week"), F.col("iso_weekday")))
    return rows.select(*by, "year", start.alias("start"), F.date_add(start, F.col("length_days")).alias("end"))


def day_matrix(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """One row per (key, day) that any interval covers, ends included."""
    return df.select(*by, F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("day")).distinct()


def leave_one_year_out(df: DataFrame, by: Sequence[str], start: str, end: str, years: Sequence[int], entity: Sequence[str], min_years: int = 3) -> DataFrame:
    """Recall and precision, in days, of rules fitted without the year they predict.

    Every row joins the fits of all other years at once (years are a short list).
    """
    tagged = df.withColumn("held_out", F.explode(F.array(*[F.lit(y) for y in years]))).where(F.year(start) != F.col("held_out"))
    rules = fit_recurrence(tagged, [*by, "held_out"], start, end, min_years).withColumn("year", F.col("held_out"))
    from ..functions.calendar import easter, iso_week_date

    s = F.when(F.col("rule") == "easter", F.date_add(easter("year"), F.col("easter_offset"))).otherwise(
        iso_week_date(F.col("year"), F.col("iso_week"), F.col("iso_weekday")))
    pred = rules.select(*entity, "year", s.alias("start"), F.date_add(s, F.col("length_days")).alias("end"))
    pred_days = day_matrix(pred, [*entity, "year"], "start", "end").where(F.year("day") == F.col("year")).drop("year").withColumn("p", F.lit(1))
    true_days = day_matrix(df, list(entity), start, end).where(F.year("day").isin(*years)).withColumn("t", F.lit(1))
    both = true_days.join(pred_days, [*entity, "day"], "full").fillna(0, ["p", "t"])
    out = both.groupBy(F.year("day").alias("year")).agg(F.sum("t").alias("days_true"), F.sum("p").alias("days_predicted"), F.sum(F.col("t") * F.col("p")).alias("days_both"))
    return out.withColumns({"recall": F.col("days_both") / F.greatest("days_true", F.lit(1)), "precision": F.col("days_both") / F.greatest("days_predicted", F.lit(1))})
