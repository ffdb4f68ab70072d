"""Cross products and pruning of hundreds of columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownwhen.operators import wide as W


def test_six_hundred_columns(spark):
    rng = np.random.default_rng(0)
    seeds = rng.integers(1, 10**6, 600).tolist()
    df = spark.range(400, numPartitions=5).select(*[F.rand(int(s)).alias(f"c{i}") for i, s in enumerate(seeds)]).persist()
    n, g = W.wide_gram(df, df.columns)
    x = np.array([tuple(r) for r in df.collect()])
    x = np.column_stack([np.ones(400), x])
    assert n == 400 and g.shape == (601, 601) and np.allclose(g, x.T @ x)


def test_pairwise_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) + 1e6
    x[:, 3] = x[:, 0] * 2 + 1e-3 * rng.normal(size=200)
    x[:, 4] = 7.0
    gaps = rng.random(x.shape) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(r, m)) for r, m in zip(x, gaps)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    missing, r = W.pairwise_corr(df, df.columns)
    assert missing.tolist() == pytest.approx(gaps.mean(0).tolist())
    for i in range(4):
        for j in range(4):
            both = ~gaps[:, i] & ~gaps[:, j]
            assert r[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
    assert np.isnan(r[4]).all() and [q["column"] for q in W.column_report(df, df.columns, 0.5).where("kept").collect()] == ["a", "b", "c"]
    assert W.column_report(df.limit(0), df.columns).where("kept").isEmpty()
