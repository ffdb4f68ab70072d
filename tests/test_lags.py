"""Lag kernel and tail probabilities against plain loops and quadrature."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownwhen.functions import distributions as D
from knownwhen.operators import lags as G
from knownwhen.operators import quality as Y
from knownwhen.operators import stats as S


@pytest.fixture(scope="module")
def series():
    rng = random.Random(6)
    return [(k, i, None if rng.random() < 0.1 else rng.gauss(0, 1), rng.gauss(0, 2)) for k in ("a", None) for i in range(300) if rng.random() < 0.9]


@pytest.mark.parametrize("width", [12, 50, None])
def test_lagged_sums_do_not_depend_on_chunks(spark, series, width, monkeypatch):
    if width:
        monkeypatch.setattr(G, "WIDTH", width)
    df = spark.createDataFrame(series, "k string, i long, x double, y double")
    got = {(r.k, r.lag): (r.n, r.s) for r in G.lagged_sums(df, ["k"], "i", ["x", "y"], [-3, 0, 1, 11]).collect()}
    for k in ("a", None):
        at = {i: (x or 0.0, y) for kk, i, x, y in series if kk == k}
        for lag in (-3, 0, 1, 11):
            pairs = [(at[i], at[i - lag]) for i in at if i - lag in at]
            want = [sum(p[a] * q[b] for p, q in pairs) for a in (0, 1) for b in (0, 1)]
            assert got[k, lag][0] == len(pairs) and got[k, lag][1] == pytest.approx(want)


def test_rows_shipped_do_not_grow_with_lags(spark, series):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(40_000)], "k string, i long, x double")
    from knownwhen.operators import ordered as O

    for n in (2, 200):
        assert O.halo(df, ["k"], "i", n, 0, max(G.WIDTH, 4 * n)).count() < 1.05 * 40_000


@pytest.mark.parametrize("a,b", [(0.5, 0.5), (1.0, 3.0), (600.0, 0.5), (2.5, 1200.0), (40.0, 40.0)])
def test_incomplete_beta(spark, a, b):
    points = [0.001, 0.1, 0.37, 0.5, 0.9, 0.999]
    got = [r.v for r in spark.createDataFrame([(x,) for x in points], "x double").select(D.beta_inc(F.col("x"), F.lit(a), F.lit(b)).alias("v")).collect()]
    theta = np.linspace(0, 1, 200_001)[1:]
    for x, v in zip(points, got):
        t = theta * math.asin(math.sqrt(x))
        with np.errstate(divide="ignore"):
            f = 2 * np.exp((2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        first = 2 * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if a == 0.5 else 0.0
        assert v == pytest.approx(np.trapezoid(np.r_[first, f], np.r_[0.0, t]), abs=1e-7)


def test_tails_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 10), (None, 10), (0.0, 10), (-2.0, 10)], "t double, n int")
    got = [r.p for r in df.select(D.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.07338803, abs=1e-7) and got[1] is None and got[2] == 1.0 and got[3] == got[0]


def test_granger_both_ways(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = np.r_[0.0, 0.8 * x[:-1]] + 0.3 * rng.normal(size=400)
    noise = rng.normal(size=400)
    df = spark.createDataFrame([(None, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, x, noise))], "k string, t long, y double, x double, z double")
    got = {(r.target, r.driver, r.lags): r for r in S.granger(df, ["k"], "t", "y", ["x", "z"], [1, 3], both=True, chunk=64).collect()}
    assert len(got) == 8 and got["y", "x", 1].p_value < 1e-12 and got["y", "x", 3].q_bh < 1e-10
    assert all(r.p_value > 0.001 for (target, driver, _), r in got.items() if (target, driver) != ("y", "x"))
    past = np.stack([np.ones(399), y[:-1], x[:-1]], 1)
    rss = [np.linalg.lstsq(past[:, :c], y[1:], rcond=None)[1][0] for c in (2, 3)]
    assert got["y", "x", 1].f_stat == pytest.approx((rss[0] - rss[1]) / (rss[1] / 396))


def test_best_lag_against_loops(spark, frame):
    rng = random.Random(8)
    base = [rng.gauss(0, 1) for _ in range(200)]
    a = [(k, f"2025-01-0{1 + i // 96} {i % 96 // 4:02d}:{i % 4 * 15:02d}:00", base[i]) for k in ("a", None) for i in range(150) if rng.random() < 0.95]
    b = [(k, f"2025-01-0{1 + (i + 2) // 96} {(i + 2) % 96 // 4:02d}:{(i + 2) % 4 * 15:02d}:00", base[i] + 0.01 * rng.random()) for k in ("a", None) for i in range(150)]
    da, db = frame(a, "k string, ts timestamp_ntz, v double"), frame(b, "k string, ts timestamp_ntz, v double")
    got = Y.best_lag(da, db, "ts", "v", [-3, 0, 2, 3], "15 minutes", ["k"], F.col("ts").cast("date"), min_n=20).collect()
    assert len(got) == 4 and all(r.best_lag == 2 and r.corr_best > 0.99 and r.mae_best < 0.02 and abs(r.corr_lag0) < 0.5 for r in got)
