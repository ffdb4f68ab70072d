"""Hard negatives against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownwhen.llm import negatives


def brute(rows, anchors, positives=5, k=3):
    out = []
    for a in anchors:
        s = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        others = [r for r in rows if r is not a and len(r[2]) == len(a[2])]
        mine = sorted((-s(r), r[0]) for r in others if r[1] == a[1])[:positives]
        bad = sorted((-s(r), r[0]) for r in others if r[1] != a[1])
        for score, p in mine:
            fine = [(-x, n) for x, n in bad if 50 * -score <= 100 * -x <= 95 * -score][:k]
            out += [(a[0], p, rank, n, -score, x) for rank, (x, n) in enumerate(fine, 1)]
    return Counter(out)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.05), (3, 1e5)])
def test_against_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    made = [(int(i), int(rng.integers(0, 3)) if i % 3 else 0, [float(x) for x in np.round(rng.normal(size=6) * spread, 2)]) for i in range(150)]
    made += [(200 + k, 1 + k % 2, made[10][2]) for k in range(40)]  # ties, one very common vector
    made += [(50, 1, made[50][2]), (50, 2, made[3][2]), (10, 1, made[10][2])]  # repeated ids
    made += [(300, 0, [1.0, 2.0]), (301, 1, [1.0, 1.5]), (302, 0, [1.0, 2.5])]  # other lengths
    odd = [(None, 1, made[1][2]), (400, None, made[1][2]), (401, 1, None), (402, 1, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (403, 2, [float("nan")] * 6), (404, 2, [float("inf")] * 6)]
    table = spark.createDataFrame(made + odd, "vec_id long, label int, embedding array<double>")
    for name in ("row", "v", "place", "score", "slot", "p"):
        table = table.withColumn(name, F.lit(1))
    vectors = negatives.written(negatives.labelled_vectors(table.repartition(3)))
    rows = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in made]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert sum(want.values()) > 5
    for sizes in ({}, {"block": 7, "anchors_per_cell": 3, "rows_per_cell": 20}):
        got = negatives.hard_negatives(vectors, vectors.where("vec_id % 50 = 0"), **sizes).collect()
        assert Counter(map(tuple, got)) == want


def test_empty_and_large(spark):
    schema = "vec_id long, label int, embedding array<double>"
    empty = negatives.written(negatives.labelled_vectors(spark.createDataFrame([], schema)))
    assert negatives.hard_negatives(empty, empty).collect() == []
    rows = [(0, 1, [1e6, 1.0]), (1, 1, [1.4e6, 1.0]), (2, 2, [1.2e6, 2.0]), (3, 2, [1.0, 1.0]), (4, 3, [1e15, 1.0])]  # products beyond 2^53: exact all the same
    vectors = negatives.written(negatives.labelled_vectors(spark.createDataFrame(rows, schema)))
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    got = Counter(map(tuple, negatives.hard_negatives(vectors, vectors.where("vec_id = 0")).collect()))
    assert got == brute(whole, whole[:1]) and sum(got.values()) == 1


def test_kept_is_the_best(spark):
    rng = random.Random(4)
    kept, every = negatives._Kept(2, 3, 4), []
    for _ in range(30):
        part = [(rng.randrange(6), rng.randrange(8), rng.randrange(50), rng.randrange(10**6)) for _ in range(rng.randrange(20))]
        every += part
        if part:
            kept.offer(*(np.array(c, np.int64) for c in zip(*part)))
    for cell in range(6):
        want = sorted((-s, i, r) for c, s, i, r in every if c == cell)[:4]
        assert [(-s, i, r) for c, s, i, r in kept.found.tolist() if c == cell] == want
