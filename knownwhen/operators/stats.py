"""Statistics over tables: the heavy part is always a grouped sum, any solve is on a k x k matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions.distributions import f_tail
from ..functions.numeric import corr, draw, normal_two_sided
from ..session import cut_lineage
from . import ordered as O
from .ordered import group_key
from .lags import lagged_grams, lagged_sums
from .ranks import average_ranks, quantiles, ranked_values
from .shaping import within



# ---------------------------------------------------------------- correlation
def feature_rows(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(by, feature, x, y) rows with both values present."""
    wide = df.select(*by, F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(x) for x in xs])
    long = wide.unpivot([*by, "y"], list(xs), "feature", "x")
    return long.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def driver_correlations(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], group: Sequence[str] = (),
                        min_n: int = 1, min_distinct: int = 3, min_group: int = 2, min_varying: float = 0.0) -> DataFrame:
    """Spearman and Pearson correlation of y with every feature, optionally pooled within groups.

    Within groups, ranks and values are demeaned per group; features that vary in too few
    groups are left out.

    No row is given a rank of y. Features are ranked on their counts of values, the rows are collapsed to one per value of y with the
    sums of the features' ranks, and running counts rank those. Pooled correlations are sums of the groups' central moments.
    """
    cells = [*by, *group]
    names = list(xs)
    wide = df.where(F.col(y).isNotNull()).select(*cells, F.col(y).cast("double").alias("_kw_y"), *[F.col(x).cast("double").alias(f"_kw_x{i}") for i, x in enumerate(names)])
    values = wide.unpivot(cells, [F.col(f"_kw_x{i}").alias(x) for i, x in enumerate(names)], "feature", "x").where(F.col("x").isNotNull())
    least = min_group if group else 1
    # One row per value of a feature in a cell: how many rows have it, and its rank about the mean rank of the cell.
    table = ranked_values(values, [*cells, "feature"], "x").where(F.col("all_n") >= least)
    table = cut_lineage(table.select(*cells, "feature", "x", "n", "all_n", (F.col("before_n") + (F.col("n") + 1) / 2 - (F.col("all_n") + 1) / 2).alias("r")))
    for i, x in enumerate(names):
        ranks = table.where(F.col("feature") == x).select(group_key(cells).alias("_kw_g"), F.col("x").alias("_kw_v"), F.col("r").alias(f"_kw_r{i}"))
        wide = wide.withColumn("_kw_k", group_key(cells)).join(ranks, (F.col("_kw_k") == F.col("_kw_g")) & (F.col(f"_kw_x{i}") == F.col("_kw_v")), "left").drop("_kw_k", "_kw_g", "_kw_v")
    used = {i: F.col(f"_kw_r{i}").isNotNull() for i in range(len(names))}
    per_y = {f"n{i}": F.when(used[i], F.lit(1)).otherwise(F.lit(0)).cast("long") for i in used}
    per_y |= {f"r{i}": F.coalesce(F.col(f"_kw_r{i}"), F.lit(0.0)) for i in used}
    at = ranked_values(wide, cells, "_kw_y", per_y)
    # The moments of values take one pass over the rows, those of ranks one over the values.
    here = {i: {c: F.when(used[i], F.col(c)) for c in ("_kw_y", f"_kw_x{i}")} for i in used}
    pearson = wide.groupBy(*cells).agg(*[F.struct(F.count(F.when(used[i], F.lit(1))).alias("k"), F.covar_pop(*here[i].values()).alias("xy"), F.var_pop(here[i][f"_kw_x{i}"]).alias("xx"),
                                                  F.var_pop(here[i]["_kw_y"]).alias("yy")).alias(f"p{i}") for i in used])
    rank = {i: F.col(f"before_n{i}") + (F.col(f"n{i}") + 1) / 2 - (F.col(f"all_n{i}") + 1) / 2 for i in used}
    spearman = at.groupBy(*cells).agg(*[F.struct(F.sum(rank[i] * F.col(f"r{i}")).alias("xy"), F.sum(F.col(f"n{i}") * rank[i] * rank[i]).alias("yy")).alias(f"s{i}") for i in used])
    moments = pearson.transform(match, spearman, cells)
    moments = moments.select(*cells, F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"p{i}").alias("p"), F.col(f"s{i}").alias("s")) for i, x in enumerate(names)]))).where("p.k > 0")
    size = table.groupBy(*cells, "feature").agg(F.sum(F.col("n") * F.col("r") * F.col("r")).alias("rxx"), F.count(F.lit(1)).alias("kinds"))
    k = F.col("p.k")
    ratio = lambda xy, xx, yy: F.sum(xy) / F.nullif(F.sqrt(F.sum(xx)) * F.sqrt(F.sum(yy)), F.lit(0.0))
    out = moments.transform(match, size, [*cells, "feature"]).groupBy(*by, "feature").agg(
        F.sum(k).alias("n"), ratio(F.col("s.xy"), F.col("rxx"), F.col("s.yy")).alias("spearman"), ratio(k * F.col("p.xy"), k * F.col("p.xx"), k * F.col("p.yy")).alias("pearson"),
        F.avg((F.col("kinds") > 1).cast("double")).alias("varying"))
    distinct = table.groupBy(*by, "feature", "x").agg(F.lit(1).alias("one")).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    out = out.transform(match, distinct, [*by, "feature"]).where((F.col("n") >= min_n) & (F.col("n_distinct") >= min_distinct))
    out = out.select(*by, "feature", "n", "spearman", "pearson", "n_distinct", *(["varying"] if group else []))
    return out.where(F.col("varying") >= min_varying) if group else out


def corr_stability(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], period: Column, top: int) -> DataFrame:
    """Correlation of the top features per period and the share of periods with the pooled sign."""
    rows = feature_rows(df.withColumn("_kw_period", period), [*by, "_kw_period"], y, xs)
    pooled = rows.groupBy(*by, "feature").agg(corr("x", "y").alias("pooled"))
    w = Window.partitionBy(*by).orderBy(F.abs("pooled").desc(), "feature")
    best = pooled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    per = rows.groupBy(*by, "feature", F.col("_kw_period").alias("period")).agg(corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    out = per.transform(match, best, [*by, "feature"])
    return out.groupBy(*by, "feature", "rank", "pooled").agg(
        F.count("r").alias("periods"), F.avg((F.signum("r") == F.signum("pooled")).cast("double")).alias("same_sign"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"))


def corr_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise correlations of columns as (a, b, r) rows from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    wide = df.groupBy(*by).agg(*[corr(a, b).alias(f"{b}|{a}") for a, b in pairs])
    long = wide.unpivot(list(by), [F.col(f"`{b}|{a}`") for a, b in pairs], "pair", "r")
    return long.select(*by, F.split("pair", "[|]")[0].alias("a"), F.split("pair", "[|]")[1].alias("b"), "r")


def level_shape_corr(df: DataFrame, by: Sequence[str], a: str, b: str, day: Column) -> DataFrame:
    """Correlation of the values, of their daily means, and within the day."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_kw_day", day)
    centred = within(rows, [*by, "_kw_day"], [a, b])
    values = centred.groupBy(*by).agg(corr(a, b).alias("r_all"), corr(f"{a}__w", f"{b}__w").alias("r_within_day"))
    daily = rows.groupBy(*by, "_kw_day").agg(F.avg(a).alias("a"), F.avg(b).alias("b")).groupBy(*by).agg(
        corr("a", "b").alias("r_daily"), F.count(F.lit(1)).alias("days"))
    return values.transform(match, daily, list(by))


# ---------------------------------------------------------------- least squares on Gram matrices
def gram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), intercept: bool = False) -> DataFrame:
    """One row per group: ``n`` and ``g`` = flattened symmetric matrix of cross products."""
    cols = [F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in (["1"] if intercept else []) + list(columns)]
    complete = None
    for c in columns:
        term = F.col(c).isNotNull()
        complete = term if complete is None else complete & term
    rows = df.where(complete)
    k = len(cols)
    aggs = {(i, j): F.sum(cols[i] * cols[j]).alias(f"_kw_{i}_{j}") for i in range(k) for j in range(i, k)}
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs.values())
    flat = F.array(*[F.col(f"_kw_{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return out.select(*by, "n", flat.alias("g"))


def _solve(g: np.ndarray, cols: Sequence[int], y: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares of column ``y`` on ``cols`` from a Gram matrix."""
    if not len(cols):
        return np.zeros(0), float(g[y, y])
    b = np.linalg.lstsq(g[np.ix_(cols, cols)], g[cols, y], rcond=None)[0]
    return b, float(g[y, y] - b @ g[cols, y])


def _bic(rss: float, n: float, k: int) -> float:
    return n * math.log(max(rss, 1e-300) / n) + k * math.log(n)


def fe_ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], effects: Sequence[str], max_terms: int = 12,
           select: bool = True) -> DataFrame:
    """Fixed-effects regression in within-group standard deviations, forward selection by BIC.

    Rows are demeaned and reduced to one Gram matrix per series in Spark; selection and solve
    happen on that k x k matrix, one tiny task per series.
    """
    complete = df
    for c in (y, *xs):
        complete = complete.where(F.col(c).isNotNull())
    names = [f"{c}__w" for c in (y, *xs)]
    centred = within(complete, [*by, *effects], [y, *xs])
    matrices = gram(centred, names, by)
    features = list(xs)
    k = len(names)
    types = {f.name: f.dataType.simpleString() for f in matrices.schema}
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["feature string", "step int", "coef double", "coef_sd double", "n bigint", "r2_within double", "bic double"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec in batch.to_dict("records"):
                g = np.asarray(rec["g"], dtype=float).reshape(k, k)
                n = float(rec["n"])
                sd = np.sqrt(np.diag(g) / max(n - 1, 1))
                usable = [i for i in range(1, k) if sd[i] > 1e-9]
                chosen: list[int] = [] if select else usable
                best = _bic(_solve(g, [], 0)[1], n, 0)
                while select and len(chosen) < max_terms:
                    trials = [(_bic(_solve(g, chosen + [i], 0)[1], n, len(chosen) + 1), i) for i in usable if i not in chosen]
                    if not trials or min(trials)[0] >= best - 1e-9:
                        break
                    best, pick = min(trials)
                    chosen.append(pick)
                b, rss = _solve(g, chosen, 0)
                for s, (i, coef) in enumerate(zip(chosen, b)):
                    rows.append([*[rec[x] for x in by], features[i - 1], s + 1, coef, coef * sd[i], int(n), 1 - rss / g[0, 0], _bic(rss, n, len(chosen))])
            yield pd.DataFrame(rows, columns=[*by, "feature", "step", "coef", "coef_sd", "n", "r2_within", "bic"])

    return matrices.mapInPandas(fit, schema)


def lagged_products(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], lags: int,
                    chunk: str | int = "30 days") -> DataFrame:
    """``s`` = flattened matrix of ``sum x_i(t) x_j(t - lag)`` for lag 0..lags, per series; rows are shipped once, not once per lag."""
    rows = O.row_index(df.select(*by, order, *columns), by, order, "_kw_i", chunk=chunk)
    return lagged_sums(rows, by, "_kw_i", columns, range(lags + 1))


def sandwich(df: DataFrame, by: Sequence[str], order: str, y: str, xs: Sequence[str], lags: int, chunk: str | int = "30 days") -> DataFrame:
    """(*by, beta, cov, n): OLS coefficients and their flattened Newey-West covariance.

    Two reductions: Gram matrices give the coefficients, then the lagged products of the scores (regressor times residual) give the
    middle of the sandwich.
    """
    k = len(xs)
    mats = gram(df, [y, *xs], by)
    btypes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mats.schema if f.name in by)
    lead = btypes + ", " if btypes else ""

    def coefficients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec in batch.to_dict("records"):
                g = np.asarray(rec["g"], dtype=float).reshape(k + 1, k + 1)
                b, _ = _solve(g, list(range(1, k + 1)), 0)
                inv = np.linalg.pinv(g[1:, 1:])
                rows.append([*[rec[c] for c in by], b.tolist(), inv.ravel().tolist(), int(rec["n"])])
            yield pd.DataFrame(rows, columns=[*by, "beta", "inv", "n"])

    fits = cut_lineage(mats.mapInPandas(coefficients, f"{lead}beta array<double>, inv array<double>, n bigint"))
    complete = df
    for c in (y, *xs):
        complete = complete.where(F.col(c).isNotNull())
    known = fits.select(*by, F.col("beta").alias("_kw_beta"))
    joined = complete.transform(match, known, list(by)) if by else complete.join(F.broadcast(known))
    residual = F.col(y) - sum((F.col("_kw_beta")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    joined = joined.withColumn("_kw_e", residual)
    scored = joined.select(*by, order, *[(F.col(x) * F.col("_kw_e")).alias(f"u{i}") for i, x in enumerate(xs)])
    products = lagged_products(scored, by, order, [f"u{i}" for i in range(k)], lags, chunk)
    packed = products.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lag", "s"))).alias("p"))
    table = packed.transform(match, fits, list(by)) if by else packed.join(F.broadcast(fits))

    def middle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec in batch.to_dict("records"):
                inv = np.asarray(rec["inv"], dtype=float).reshape(k, k)
                meat = np.zeros((k, k))
                for item in rec["p"]:
                    m = np.asarray(item["s"], dtype=float).reshape(k, k)
                    lag = int(item["lag"])
                    meat += m if lag == 0 else (1 - lag / (lags + 1)) * (m + m.T)
                n = rec["n"]
                rows.append([*[rec[c] for c in by], rec["beta"], (inv @ meat @ inv * n / max(n - k, 1)).ravel().tolist(), int(n)])
            yield pd.DataFrame(rows, columns=[*by, "beta", "cov", "n"])

    return table.mapInPandas(middle, f"{lead}beta array<double>, cov array<double>, n bigint")


def newey_west(df: DataFrame, by: Sequence[str], order: str, y: str, xs: Sequence[str], lags: int, chunk: str | int = "30 days") -> DataFrame:
    """OLS coefficients with Newey-West standard errors for a fixed set of regressors."""
    k = len(xs)
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col("beta")[i].alias("coef"), F.sqrt(F.greatest(F.col("cov")[i * k + i], F.lit(0.0))).alias("se")) for i, x in enumerate(xs)]))
    out = sandwich(df, by, order, y, xs, lags, chunk).select(*by, cells.alias("c"), "n").select(*by, "c.*", "n")
    return out.select(*by, "feature", "coef", "se", (F.col("coef") / F.nullif(F.col("se"), F.lit(0.0))).alias("t"), "n")


def break_study(df: DataFrame, by: Sequence[str], order: str, y: str, xs: Sequence[str], at: str, effects: Sequence[str] = (),
                placebo_days: Sequence[int] = (), lags: int = 7, chunk: str | int = "30 days") -> DataFrame:
    """Did slopes change at a date? The model is y on [x, x * post], demeaned by the effects, with Newey-West covariances.

    One row per series, design (0: the date itself; d: a placebo d days earlier, on rows before the date only) and feature: slopes before and after, change, its t
    and p-value, the joint robust Wald statistic ``wald_f`` of all changes with ``p_joint``, and ``q_bh`` over the joint tests of the
    result. All designs are fitted together; rows travel once per design.
    """
    day = F.col(order).cast("date")
    designs = F.explode(F.array(*[F.lit(int(d)) for d in (0, *placebo_days)]))
    rows = df.withColumn("design", designs)
    start = F.date_sub(F.lit(at).cast("date"), F.col("design"))
    rows = rows.where((F.col("design") == 0) | (day < F.lit(at).cast("date"))).withColumn("_kw_post", (day >= start).cast("double"))
    for c in (y, *xs):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumns({f"{x}_post": F.col(x) * F.col("_kw_post") for x in xs})
    names, keys = [y, *xs, *[f"{x}_post" for x in xs]], [*by, "design"]
    rows = cut_lineage(within(rows, [*keys, *effects], names).select(*keys, order, *[f"{c}__w" for c in names]))
    fits = sandwich(rows, keys, order, f"{y}__w", [f"{c}__w" for c in names[1:]], lags, chunk)
    half, k = len(xs), 2 * len(xs)
    lead = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fits.schema if f.name in keys)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec in batch.to_dict("records"):
                b, cov = np.asarray(rec["beta"], float), np.asarray(rec["cov"], float).reshape(k, k)
                change, spread = b[half:], cov[half:, half:]
                wald = float(change @ np.linalg.pinv(spread) @ change) / half
                for i, x in enumerate(xs):
                    se = math.sqrt(max(spread[i, i], 0.0))
                    out.append([*[rec[c] for c in keys], x, b[i], b[i] + change[i], change[i], change[i] / se if se > 0 else None, wald, int(rec["n"])])
            yield pd.DataFrame(out, columns=[*keys, "feature", "slope_before", "slope_after", "slope_change", "t_change", "wald_f", "n"])

    found = cut_lineage(fits.mapInPandas(test, f"{lead}, feature string, slope_before double, slope_after double, slope_change double, t_change double, wald_f double, n bigint"))
    found = found.withColumns({"p_change": normal_two_sided("t_change"), "p_joint": f_tail(F.col("wald_f"), F.lit(half), F.col("n") - k)})
    joint = bh(found.select(*keys, "p_joint").distinct(), "p_joint").select(*keys, "q_bh")
    return found.transform(match, joint, keys)


def granger(df: DataFrame, by: Sequence[str], order: str, y: str, xs: str | Sequence[str], lags: Sequence[int], min_n: int = 30,
            both: bool = False, chunk: str | int = "30 days") -> DataFrame:
    """Does the past of a driver add to a regression of the target on its own past? One row per series, driver and lag order.

    ``both`` tests the target as a driver of each of ``xs`` too. ``q_bh`` adjusts the p-values over all rows of the result. All drivers, directions
    and orders come from one pass over the rows.
    """
    xs = [xs] if isinstance(xs, str) else list(xs)
    pairs = [(y, x) for x in xs] + ([(x, y) for x in xs] if both else [])
    rows = O.row_index(df.select(*by, order, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *xs])]), by, order, "_kw_i", chunk=chunk)
    out = lagged_grams(rows, by, "_kw_i", pairs, lags)
    btypes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in by)
    lead = btypes + ", " if btypes else ""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            res = []
            for rec in batch.to_dict("records"):
                size, n = int(rec["lags"]), int(rec["n"])
                k = 2 * size + 2
                g = np.asarray(rec["g"], dtype=float).reshape(k, k)
                _, small = _solve(g, [0, *range(2, 2 + size)], 1)
                _, full = _solve(g, [0, *range(2, k)], 1)
                dof = n - (2 * size + 1)
                stat = ((small - full) / size) / (full / dof) if n >= min_n and dof > 0 and full > 0 else None
                res.append([*[rec[b] for b in by], rec["target"], rec["driver"], size, n, stat])
            yield pd.DataFrame(res, columns=[*by, "target", "driver", "lags", "n", "f_stat"])

    found = out.mapInPandas(test, f"{lead}target string, driver string, lags int, n bigint, f_stat double")
    found = found.withColumn("p_value", f_tail(F.col("f_stat"), F.col("lags"), F.col("n") - 2 * F.col("lags") - 1))
    return bh(cut_lineage(found), "p_value")


def break_test(df: DataFrame, by: Sequence[str], order: str, y: str, xs: Sequence[str], post: Column, effects: Sequence[str] = ()) -> DataFrame:
    """Slopes before a break and their change after it, with the joint F of all changes.

    The model is y on [x, x * post] (demeaned by the effects); both residual sums come from one
    Gram matrix. Run it at other dates for placebo breaks.
    """
    rows = df.withColumn("_kw_post", F.when(post, 1.0).otherwise(0.0))
    rows = rows.withColumns({f"{x}_post": F.col(x) * F.col("_kw_post") for x in xs})
    names = [y, *xs, *[f"{x}_post" for x in xs]]
    rows = within(rows, [*by, *effects], names) if (by or effects) else rows.withColumns({f"{c}__w": F.col(c) for c in names})
    m = gram(rows, [f"{c}__w" for c in names], by)
    k, half = len(names), len(xs)
    btypes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.schema if f.name in by)
    lead = btypes + ", " if btypes else ""
    feats = list(xs)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            res = []
            for rec in batch.to_dict("records"):
                g = np.asarray(rec["g"], dtype=float).reshape(k, k)
                n = int(rec["n"])
                _, small = _solve(g, list(range(1, 1 + half)), 0)
                b, full = _solve(g, list(range(1, k)), 0)
                dof = n - 2 * half
                joint = ((small - full) / half) / (full / dof) if dof > 0 and full > 0 else None
                for i, x in enumerate(feats):
                    res.append([*[rec[c] for c in by], x, b[i], b[half + i], joint, n])
            yield pd.DataFrame(res, columns=[*by, "feature", "slope_before", "slope_change", "joint_f", "n"])

    return m.mapInPandas(test, f"{lead}feature string, slope_before double, slope_change double, joint_f double, n bigint")


def before_after(df: DataFrame, breaks: DataFrame, by: Sequence[str], ts: str, value: str, at: str, window: int, placebo_days: int = 365) -> DataFrame:
    """Median, IQR and cv of a daily series before and after each break, and one year earlier.

    ``breaks`` (key, date) is a small table; each row meets only the breaks of its own series.
    The window ends at the neighbouring break.
    """
    b = breaks.select(*by, F.col(at).cast("date").alias("_kw_at")).distinct()
    w = Window.partitionBy(*by).orderBy("_kw_at")
    b = b.withColumns({"_kw_lo": F.greatest(F.date_sub("_kw_at", window), F.coalesce(F.lag("_kw_at").over(w), F.date_sub("_kw_at", window))),
                       "_kw_hi": F.least(F.date_add("_kw_at", window), F.coalesce(F.lead("_kw_at").over(w), F.date_add("_kw_at", window)))})
    designs = F.explode(F.array(F.struct(F.lit("break").alias("design"), F.lit(0).alias("shift")),
                                F.struct(F.lit("placebo").alias("design"), F.lit(placebo_days).alias("shift"))))
    b = b.withColumn("d", designs).select(*by, F.col("_kw_at").alias("break_at"), "d.design", *[
        F.date_sub(c, F.col("d.shift")).alias(c) for c in ("_kw_at", "_kw_lo", "_kw_hi")])
    rows = df.withColumn("_kw_day", F.col(ts).cast("date")).transform(match, b, list(by))
    rows = rows.where((F.col("_kw_day") >= F.col("_kw_lo")) & (F.col("_kw_day") < F.col("_kw_hi")) & F.col(value).isNotNull())
    rows = rows.withColumn("side", F.when(F.col("_kw_day") < F.col("_kw_at"), "before").otherwise("after"))
    keys = [*by, "break_at", "design"]
    q = quantiles(rows, [*keys, "side"], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    m = rows.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))
    s = q.transform(match, m, [*keys, "side"])
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    out = s.groupBy(*keys).agg(
        pick("n", "before").alias("n_before"), pick("n", "after").alias("n_after"),
        pick("median", "before").alias("median_before"), pick("median", "after").alias("median_after"),
        (pick("q75", "after") - pick("q25", "after") - pick("q75", "before") + pick("q25", "before")).alias("iqr_change"),
        (pick("cv", "after") - pick("cv", "before")).alias("cv_change"))
    return out.withColumn("log_median_change", F.log(F.col("median_after") / F.col("median_before")))


# ---------------------------------------------------------------- tests
def bh(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "q_bh") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values per family; a family is a list of tests, not data rows."""
    fam = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    asc, desc = fam.orderBy(F.col(p).asc()), fam.orderBy(F.col(p).desc())
    present = df.where(F.col(p).isNotNull())
    m = F.count(F.lit(1)).over(fam)
    raw = present.withColumn("_kw_raw", F.col(p) * m / F.row_number().over(asc))
    back = desc.rangeBetween(Window.unboundedPreceding, 0)
    out = raw.withColumn(name, F.least(F.min("_kw_raw").over(back), F.lit(1.0))).drop("_kw_raw")
    return out.unionByName(df.where(F.col(p).isNull()), allowMissingColumns=True)


def holm(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Holm step-down adjusted p-values per family."""
    fam = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    asc = fam.orderBy(F.col(p).asc())
    present = df.where(F.col(p).isNotNull())
    raw = present.withColumn("_kw_raw", (F.count(F.lit(1)).over(fam) - F.row_number().over(asc) + 1) * F.col(p))
    up = asc.rangeBetween(Window.unboundedPreceding, 0)
    out = raw.withColumn(name, F.least(F.max("_kw_raw").over(up), F.lit(1.0))).drop("_kw_raw")
    return out.unionByName(df.where(F.col(p).isNull()), allowMissingColumns=True)


def ztest(df: DataFrame, by: Sequence[str], flag: Column, outcome: Column) -> DataFrame:
    """Two-proportion z-test of an outcome with and without a flag (pooled variance)."""
    known = outcome.isNotNull()
    on, off = known & F.coalesce(flag, F.lit(False)), known & ~F.coalesce(flag, F.lit(False))
    hit = F.coalesce(outcome.cast("boolean"), F.lit(False))
    out = df.groupBy(*by).agg(F.count_if(on & hit).alias("k1"), F.count_if(on).alias("n1"), F.count_if(off & hit).alias("k0"), F.count_if(off).alias("n0"))
    p = (F.col("k1") + F.col("k0")) / (F.col("n1") + F.col("n0"))
    se = F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n0")))
    z = (F.col("k1") / F.col("n1") - F.col("k0") / F.col("n0")) / F.nullif(se, F.lit(0.0))
    out = out.withColumn("z", F.when((F.col("n1") >= 5) & (F.col("n0") >= 5), z))
    return out.withColumns({"share_on": F.col("k1") / F.nullif(F.col("n1"), F.lit(0)), "share_off": F.col("k0") / F.nullif(F.col("n0"), F.lit(0)),
                            "p": normal_two_sided("z")})


def binomial_ztest(df: DataFrame, by: Sequence[str], outcome: Column, expected: float, min_n: int = 30) -> DataFrame:
    """Share of an outcome per group against a fixed expected share: z, two-sided p-value; NULL below ``min_n`` rows."""
    share = df.where(outcome.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(outcome).alias("k"))
    z = (F.col("k") / F.col("n") - expected) / F.sqrt(F.lit(expected * (1 - expected)) / F.col("n"))
    return share.withColumn("share", F.col("k") / F.col("n")).withColumn("z", F.when(F.col("n") >= min_n, z)).withColumn("p", normal_two_sided("z"))


def std_diff(df: DataFrame, by: Sequence[str], event: Column, xs: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Standardised mean difference of every feature between event and other rows, optionally demeaned."""
    rows = df.withColumn("_kw_event", event)
    if group:
        rows = within(rows, [*by, *group], xs).drop(*xs).withColumnsRenamed({f"{x}__w": x for x in xs})
    long = feature_rows(rows.withColumn("_kw_y", F.col("_kw_event").cast("double")), by, "_kw_y", xs)
    on, off = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    out = long.groupBy(*by, "feature").agg(
        F.count(on).alias("n_event"), F.count(off).alias("n_other"), F.avg(on).alias("mean_event"), F.avg(off).alias("mean_other"),
        F.stddev_samp("x").alias("sd"))
    return out.withColumn("std_diff", (F.col("mean_event") - F.col("mean_other")) / F.nullif(F.col("sd"), F.lit(0.0)))


def dm_test(df: DataFrame, by: Sequence[str], order: str, difference: str, lags: int, min_n: int = 30, chunk: str | int = "365 days") -> DataFrame:
    """Diebold-Mariano statistic of a loss difference with a Newey-West variance."""
    rows = df.where(F.col(difference).isNotNull())
    mean = rows.groupBy(*by).agg(F.avg(difference).alias("mean_diff"), F.count(F.lit(1)).alias("n"))
    keyed = rows.transform(match, mean, list(by)) if by else rows.join(F.broadcast(mean))
    centred = keyed.select(*by, order, (F.col(difference) - F.col("mean_diff")).alias("d"))
    products = lagged_products(centred, by, order, ["d"], lags, chunk)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (lags + 1)))
    var = products.groupBy(*by).agg(F.sum(weight * F.col("s")[0]).alias("_kw_v"))
    out = mean.transform(match, var, list(by)) if by else mean.join(F.broadcast(var))
    v = F.col("_kw_v") / F.col("n")
    out = out.withColumn("stat", F.when((F.col("n") >= min_n) & (v > 0), F.col("mean_diff") / F.sqrt(v / F.col("n"))))
    return out.withColumn("p", normal_two_sided("stat")).drop("_kw_v")


# ---------------------------------------------------------------- resampling
def moving_block_bootstrap(df: DataFrame, by: Sequence[str], order: str, value: str, length: int, draws: int, seed: int,
                           levels: tuple[float, float] = (0.025, 0.975), chunk: str | int = "365 days") -> DataFrame:
    """Percentile interval of the mean from blocks of ``length`` consecutive rows.

    Block sums are differences of prefix sums, so a draw needs two look-ups per block.
    """
    x = F.col(value).cast("double")
    rows = O.running(df.where(x.isNotNull()), by, order, {"_kw_i": F.lit(1).cast("long"), "_kw_s": x}, chunk=chunk)
    prefix = rows.select(*by, "_kw_i", "_kw_s")
    size = prefix.groupBy(*by).agg(F.max("_kw_i").alias("n"), F.max_by("_kw_s", "_kw_i").alias("_kw_t"))
    origin = size.select(*by, F.lit(0).cast("long").alias("_kw_i"), F.lit(0.0).alias("_kw_s"))
    prefix = prefix.unionByName(origin)
    slots = size.withColumn("_kw_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "_kw_k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / length) - 1)))
    starts = draw(seed, F.greatest(F.col("n") - length, F.lit(1)), F.col("_kw_b"), F.col("_kw_k"))
    slots = slots.withColumn("_kw_a", starts).withColumn("_kw_e", F.least(F.col("_kw_a") + F.least(F.lit(length), F.col("n") - F.col("_kw_k") * length), F.col("n")))
    ends = slots.select(*by, "n", "_kw_b", F.explode(F.array(
        F.struct(F.col("_kw_a").alias("i"), F.lit(-1.0).alias("sign")), F.struct(F.col("_kw_e").alias("i"), F.lit(1.0).alias("sign")))).alias("x"))
    ends = ends.select(*by, "n", "_kw_b", F.col("x.i").alias("_kw_i"), "x.sign")
    means = ends.transform(match, prefix, [*by, "_kw_i"]).groupBy(*by, "_kw_b").agg((F.sum(F.col("sign") * F.col("_kw_s")) / F.first("n")).alias("_kw_m"))
    ci = means.groupBy(*by).agg(F.percentile("_kw_m", F.lit(levels[0])).alias("ci_low"), F.percentile("_kw_m", F.lit(levels[1])).alias("ci_high"))
    point = size.select(*by, "n", (F.col("_kw_t") / F.col("n")).alias("estimate"))
    return point.transform(match, ci, list(by)) if by else point.join(F.broadcast(ci))


# ---------------------------------------------------------------- forecasts and contributions
def forecast_quality(df: DataFrame, by: Sequence[str], actual: str, forecast: str, tol: float = 1e-9) -> DataFrame:
    a, f = F.col(actual), F.col(forecast)
    rows = df.where(a.isNotNull() & f.isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), corr(a, f).alias("r"), (100 * F.avg(F.abs(f - a) / F.nullif(F.abs(a), F.lit(0.0)))).alias("mape"),
        F.avg(f - a).alias("bias"), F.avg((F.abs(f - a) <= tol).cast("double")).alias("share_identical"))


def contribution_summary(long: DataFrame, by: Sequence[str], feature: str, value: str, contribution: str) -> DataFrame:
    """Mean absolute contribution, its share and rank, and the direction (Spearman with the value)."""
    keys = [*by, feature]
    size = long.groupBy(*keys).agg(F.avg(F.abs(contribution)).alias("mean_abs"), F.count(F.lit(1)).alias("n"))
    total = size.groupBy(*by).agg(F.sum("mean_abs").alias("_kw_t")) if by else size.agg(F.sum("mean_abs").alias("_kw_t"))
    size = (size.transform(match, total, list(by)) if by else size.join(F.broadcast(total))).withColumn("share", F.col("mean_abs") / F.col("_kw_t")).drop("_kw_t")
    ranked = average_ranks(long, keys, {value: "_kw_rv", contribution: "_kw_rc"})
    direction = ranked.groupBy(*keys).agg(corr("_kw_rv", "_kw_rc").alias("direction"))
    w = Window.partitionBy(*by).orderBy(F.col("mean_abs").desc(), feature) if by else Window.partitionBy(F.lit(0)).orderBy(F.col("mean_abs").desc(), feature)
    return size.transform(match, direction, keys).withColumn("rank", F.row_number().over(w).cast("long"))


def contribution_dependence(long: DataFrame, by: Sequence[str], feature: str, value: str, contribution: str, row_id: str, k: int = 10) -> DataFrame:
    """Mean value and contribution per decile of the feature value."""
    from .ranks import equal_bins

    binned = equal_bins(long, [*by, feature], value, row_id, k)
    return binned.groupBy(*by, feature, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("value"), F.avg(contribution).alias("contribution"))


def ratio_table(df: DataFrame, by: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Median ratio, its quartiles and the share above one."""
    rows = df.withColumn("_kw_r", F.col(numerator) / F.nullif(F.col(denominator), F.lit(0.0))).where(F.col("_kw_r").isNotNull())
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_kw_r") > 1).cast("double")).alias("share_above_1"))
    return quantiles(rows, by, "_kw_r", {"q25": 0.25, "median": 0.5, "q75": 0.75}).transform(match, n, list(by))


def same_partition(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows that agree under the best label map, in both directions."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("k"))
    total = cells.agg(F.sum("k").alias("n"))
    fwd = cells.groupBy(a).agg(F.max("k").alias("m")).agg(F.sum("m").alias("fwd"), F.count(F.lit(1)).alias("labels_a"))
    back = cells.groupBy(b).agg(F.max("k").alias("m")).agg(F.sum("m").alias("back"), F.count(F.lit(1)).alias("labels_b"))
    out = total.join(F.broadcast(fwd)).join(F.broadcast(back))
    return out.select((F.col("fwd") / F.col("n")).alias("agree_a"), (F.col("back") / F.col("n")).alias("agree_b"), "labels_a", "labels_b")


def jaccard(df: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    both, either = F.count_if(a & b), F.count_if(a | b)
    return df.groupBy(*by).agg(both.alias("both"), either.alias("either"), (both / F.greatest(either, F.lit(1))).alias("jaccard"))
