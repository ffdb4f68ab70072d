"""Cross-fitted ridge-logistic models against a plain Newton fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownwhen.operators.logistic import cross_logit


def fit(x, y, penalty):
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.r_[0.0, np.full(x.shape[1], penalty)]
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * b)
    return b


@pytest.mark.parametrize("earlier", [False, True])
def test_equals_separate_fits(spark, earlier):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=300), rng.exponential(size=300) * 50, np.ones(300)])
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0] * 2 + x[:, 1] / 50))).astype(float)
    gaps = rng.random(300) < 0.2
    fold = rng.integers(0, 3, 300)
    rows = [(int(i), int(fold[i]) if i != 7 else None, float(y[i]) if i != 9 else None, None if gaps[i] else float(x[i, 0]), float(x[i, 1]), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, fold int, y double, a double, b double, flat double")
    scored, fits = cross_logit(df, "fold", "y", {"one": ["a"], "two": ["b", "flat"]}, 3.0, earlier=earlier)
    got = {r.id: r for r in scored.collect()}
    assert len(got) == 300 and got[7].p_two is None and got[9].p_one is not None or earlier
    for f in range(3):
        train = np.array([r[1] is not None and r[2] is not None and (r[1] < f if earlier else r[1] != f) for r in rows])
        if not train.any():
            assert all(got[r[0]].p_one is None for r in rows if r[1] == f)
            continue
        filled = x.copy()
        filled[gaps, 0] = np.nan
        median = np.nanmedian(filled[train], axis=0)
        filled = np.where(np.isnan(filled), median, filled)
        mean, sd = filled[train].mean(0), filled[train].std(0, ddof=1)
        z = np.clip((filled - mean) / np.where(sd > 0, sd, 1), -6, 6)
        for name, columns in (("one", [0]), ("two", [0, 1, 2])):
            b = fit(z[train][:, columns], y[train], 3.0)
            p = 1 / (1 + np.exp(-(b[0] + z[:, columns] @ b[1:])))
            assert [got[r[0]][f"p_{name}"] for r in rows if r[1] == f] == pytest.approx([p[r[0]] for r in rows if r[1] == f], abs=1e-8)
            own = {r.feature: r for r in fits.where((F.col("fold") == f) & (F.col("model") == name)).collect()}
            assert own["a"].coef == pytest.approx(b[1], abs=1e-8) and own["a"].odds_ratio == pytest.approx(np.exp(b[1])) and all(abs(r.score) < 1e-7 for r in own.values())


def test_separable_and_one_sided(spark):
    df = spark.createDataFrame([(i, i % 2, float(i >= 10), float(i)) for i in range(20)], "id int, fold int, y double, a double")
    scored, fits = cross_logit(df, "fold", "y", {"m": ["a"]}, 0.5)
    assert all((r.p_m > 0.5) == (r.y == 1) for r in scored.collect() if r.id not in range(7, 13)) and fits.count() == 4
    scored, fits = cross_logit(df.withColumn("y", F.lit(1.0)), "fold", "y", {"m": ["a"]}, 0.5)
    assert scored.where("p_m is not null").isEmpty() and fits.isEmpty()
