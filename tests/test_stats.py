"""Regressions, tests and calibration against numpy on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from knownwhen.operators import evaluate as E
from knownwhen.operators import stats as S


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    n = 240
    pdf = pd.DataFrame({"k": "s", "t": np.arange(n), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf["y"] = 0.6 * pdf.x + 0.3 * pdf.x.shift(1).fillna(0) + rng.normal(scale=0.5, size=n)
    pdf["g"] = pdf.t % 4
    return spark.createDataFrame(pdf), pdf


def test_granger_is_the_f_ratio(panel):
    df, pdf = panel
    got = {r.lags: r for r in S.granger(df, ["k"], "t", "y", "x", [1, 2], chunk=50).collect()}
    for lags in (1, 2):
        d = pd.DataFrame({"y": pdf.y, **{f"y{i}": pdf.y.shift(i) for i in range(1, lags + 1)}, **{f"x{i}": pdf.x.shift(i) for i in range(1, lags + 1)}})
        # Both orders are fitted on the rows that have every lag of the longest order or of their own.
        d = pd.DataFrame({**d, "c": 1.0}).dropna()
        small, full = d[["c"] + [f"y{i}" for i in range(1, lags + 1)]], d.drop(columns="y")
        rss = [float(((d.y - a @ np.linalg.lstsq(a.to_numpy(), d.y.to_numpy(), rcond=None)[0]) ** 2).sum()) for a in (small, full)]
        f = ((rss[0] - rss[1]) / lags) / (rss[1] / (len(d) - 2 * lags - 1))
        assert got[lags].n == len(d) and got[lags].f_stat == pytest.approx(f)


def test_newey_west_standard_errors(panel):
    df, pdf = panel
    got = {r.feature: r for r in S.newey_west(df, ["k"], "t", "y", ["x", "z"], 4, chunk=31).collect()}
    a, y, n = pdf[["x", "z"]].to_numpy(), pdf.y.to_numpy(), len(pdf)
    inv = np.linalg.pinv(a.T @ a)
    b = inv @ a.T @ y
    u = a * (y - a @ b)[:, None]
    mid = u.T @ u
    for lag in range(1, 5):
        g = u[lag:].T @ u[:-lag]
        mid += (1 - lag / 5) * (g + g.T)
    se = np.sqrt(np.diag(inv @ mid @ inv) * n / (n - 2))
    assert [got["x"].coef, got["z"].coef, got["x"].se, got["z"].se] == pytest.approx([*b, *se])


def test_forward_selection_finds_the_driver(panel):
    df, _ = panel
    got = S.fe_ols(df, ["k"], "y", ["z", "x"], ["g"]).collect()
    assert got[0].feature == "x" and got[0].r2_within > 0.4


def test_break_test_sees_a_slope_change(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": "s", "t": np.arange(400), "x": rng.normal(size=400)})
    pdf["y"] = np.where(pdf.t < 200, 1.0, 3.0) * pdf.x + rng.normal(scale=0.1, size=400)
    r = S.break_test(spark.createDataFrame(pdf), ["k"], "t", "y", ["x"], F.col("t") >= 200).first()
    assert r.slope_before == pytest.approx(1.0, abs=0.1) and r.slope_change == pytest.approx(2.0, abs=0.1) and r.joint_f > 100


def test_dm_statistic(panel):
    df, pdf = panel
    d = (pdf.y - pdf.x).abs() - (pdf.y - pdf.z).abs()
    r = S.dm_test(df.withColumn("d", F.abs(F.col("y") - F.col("x")) - F.abs(F.col("y") - F.col("z"))), ["k"], "t", "d", 4, chunk=40).first()
    c = (d - d.mean()).to_numpy()
    v = c @ c / len(c) + sum(2 * (1 - k / 5) * (c[k:] @ c[:-k]) / len(c) for k in range(1, 5))
    z = d.mean() / math.sqrt(v / len(c))
    assert r.stat == pytest.approx(z) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=3e-7)


def test_holm_and_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    h = {r.p: r.p_holm for r in S.holm(df, "p").collect()}
    b = {r.p: r.q_bh for r in S.bh(df, "p").collect()}
    assert h == pytest.approx({0.01: 0.03, 0.03: 0.06, 0.04: 0.06, None: None}) and b[0.01] == pytest.approx(0.03) and b[0.03] == pytest.approx(0.04)


@pytest.mark.parametrize("slices", [4, 64])
def test_conformal_rank_of_earlier_folds(spark, slices):
    rows = [("s", 0, float(i)) for i in range(1, 31)] + [("s", 1, 500.0)] * 70 + [("s", 2, 0.0)]
    df = spark.createDataFrame(rows, "k string, fold int, v double")
    n = F.col("n")
    rank = F.ceil(F.round((n - 1) * F.least(F.ceil((n + 1) * 80 / 100) / n, F.lit(1.0)), 9)) + 1
    got = {r.fold: (r.n_past, r.value) for r in E.earlier_folds_rank(df, ["k"], "fold", "v", rank, 30, slices).collect()}
    scores = np.array([float(i) for i in range(1, 31)] + [500.0] * 70)
    assert got == {1: (30, 26.0), 2: (100, np.quantile(scores, math.ceil(101 * 0.8) / 100, method="higher"))}


def test_fold_plan_boundaries(frame):
    rows = [("s", "2020-12-01 00:00", "2021-01-01 00:00"), ("s", "2021-03-31 00:00", "2021-04-01 00:00"), ("s", "2021-05-10 00:00", "2021-05-11 00:00")]
    df = frame(rows, "k string, a timestamp_ntz, b timestamp_ntz")
    got = {r.fold: r for r in E.fold_plan(df, ["k"], "a", "b", "2021-01-01", 3, 1).collect()}
    assert str(got[1].fold_start) == "2021-04-01 00:00:00" and got[1].n_train == 2 and got[0].n_train == 1


def test_ridge_folds_use_only_the_past(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": "s", "fold": np.repeat([0, 1, 2], 60), "a": rng.normal(size=180), "b": rng.normal(size=180)})
    pdf["y"] = 2 * pdf.a - pdf.b + rng.normal(scale=0.2, size=180)
    got = E.ridge_backtest(spark.createDataFrame(pdf), ["k"], "fold", "y", ["a", "b"], 1.0).toPandas().sort_values(["fold", "a"])
    for f in (1, 2):
        tr, te = pdf[pdf.fold < f], pdf[pdf.fold == f].sort_values("a")
        mu, sd = tr[["a", "b"]].mean(), tr[["a", "b"]].std(ddof=0)
        z = ((tr[["a", "b"]] - mu) / sd).clip(-5, 5).to_numpy()
        beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (tr.y - tr.y.mean()).to_numpy())
        p = ((te[["a", "b"]] - mu) / sd).clip(-5, 5).to_numpy() @ beta + tr.y.mean()
        assert got[got.fold == f].p.tolist() == pytest.approx(p.tolist())


def test_prob_above_zero(spark):
    df = spark.createDataFrame([(-2.0, -1.0, 1.0), (1.0, 2.0, 3.0), (-3.0, -2.0, -1.0), (0.0, 1.0, 2.0)], "a double, b double, c double")
    got = [r.p_above for r in E.prob_above(df, [0.1, 0.5, 0.9], ["a", "b", "c"]).collect()]
    mid = math.exp(math.log(0.5) + 0.5 * (math.log(0.1) - math.log(0.5)))
    assert got[0] == pytest.approx(mid) and got[1] > 0.9 and got[2] < 0.1 and got[3] == pytest.approx(0.9)


def test_policy_revenue(spark):
    df = spark.createDataFrame([(5.0, 6.0), (7.0, 6.0), (-1.0, 6.0), (None, 6.0)], "b double, c double")
    assert [r.r for r in df.select(E.revenue("b", "c").alias("r")).collect()] == [5.0, 0.0, 0.0, 0.0]


def test_corr_of_a_constant_is_null(spark):
    from knownwhen.functions.numeric import corr

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(corr("x", "y").alias("r")).first().r is None


@pytest.mark.parametrize("group", [[], ["g"]])
def test_driver_correlations_keep_counts_only(spark, monkeypatch, group):
    """Against pandas, with missing values and a group of one row; what is written is one row per feature value, not one per row and feature."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 900), "g": rng.integers(0, 4, 900), "a": rng.integers(0, 6, 900).astype(float), "b": rng.integers(0, 9, 900).astype(float)})
    pdf["y"] = np.round(pdf.a + rng.normal(0, 3, 900), 1)
    pdf.loc[pdf.index[-1], "g"] = 9
    pdf.loc[::17, "a"] = np.nan
    pdf.loc[::29, "y"] = np.nan
    written = []

    def counted(df):
        written.append(df.count())
        return df

    monkeypatch.setattr(S, "cut_lineage", counted)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "k int, g int, a double, b double, y double")
    got = {(r.k, r.feature): r for r in S.driver_correlations(df, ["k"], "y", ["a", "b"], group).collect()}
    assert sum(written) < 200
    assert len(got) == 4
    for (k, f), r in got.items():
        x = pdf[(pdf.k == k) & pdf[f].notna() & pdf.y.notna()].copy()
        x = x[x.groupby("g")[f].transform("size") >= 2] if group else x
        cols = {"x": x[f], "y": x.y}
        ranks = {c: (v.groupby(x.g).rank() if group else v.rank()) for c, v in cols.items()}
        less = lambda v: v - v.groupby(x.g).transform("mean") if group else v
        assert r.n == len(x) and r.n_distinct == x[f].nunique()
        assert r.pearson == pytest.approx(np.corrcoef(less(cols["x"]), less(cols["y"]))[0, 1], abs=1e-9)
        assert r.spearman == pytest.approx(np.corrcoef(less(ranks["x"]), less(ranks["y"]))[0, 1], abs=1e-9)
