"""Nearest neighbours on the sphere against brute force: poles, the date line, crowds, lonely points, few right points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from knownwhen.operators import intervals as I


def km(a, b):
    (la, lo), (lb, lp) = ([math.radians(x) for x in p] for p in (a, b))
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)))


@pytest.mark.parametrize("n_right", [0, 2, 300])
def test_nearest(spark, n_right):
    rng = random.Random(n_right)
    crowd = [(47.0 + rng.random() / 100, 8.0 + rng.random() / 100) for _ in range(n_right // 2)]
    right = (crowd + [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n_right)])[:max(n_right, 0)]
    left = [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -179.999), (47.005, 8.005), (-40.0, 175.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    dl = spark.createDataFrame([(i, *p) for i, p in enumerate(left)] + [(99, None, 1.0)], "id int, lat double, lon double").withColumn("extra", F.lit(1))
    dr = spark.createDataFrame([(i, *p) for i, p in enumerate(right)] + [(999, 1.0, None)], "station int, slat double, slon double")
    found = I.nearest(dl, dr, ("lat", "lon"), ("slat", "slon"), "id", "station", 3, finest_km=1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = {(r.id, r["rank"]): (r.station, r.km) for r in found.collect()}
    want = {(i, n): (s, d) for i, p in enumerate(left) for n, (d, s) in enumerate(sorted((km(p, q), s) for s, q in enumerate(right))[:3], 1)}
    assert got.keys() == want.keys()
    for key, (s, d) in want.items():
        assert got[key][1] == pytest.approx(d, abs=1e-6)


def test_nearest_crowded_positions(spark):
    """Points that share positions, and regions far denser than the finest size, meet few others: no join makes more than some pairs a position."""
    left = spark.range(4000).select(F.col("id"), (F.col("id") % 400 / 4000).alias("lat"), (F.col("id") % 97 / 970).alias("lon"))
    right = spark.range(3000).select(F.col("id").alias("station"), (F.col("id") % 300 / 3000).alias("slat"), (F.col("id") % 89 / 890).alias("slon"), (F.col("id") * 2).alias("more"))
    found = I.nearest(left, right, ("lat", "lon"), ("slat", "slon"), "id", "station", 3, finest_km=1000.0)
    got = {}
    for r in found.collect():
        assert r.more == 2 * r.station
        got.setdefault(r.id, []).append((r["rank"], r.station, r.km))
    places = [(r.station, r.slat, r.slon) for r in right.collect()]
    for r in left.where("id % 211 = 0").collect():
        want = sorted((round(km((r.lat, r.lon), (la, lo)), 7), s) for s, la, lo in places)[:3]
        assert [(round(d, 7), s) for _, s, d in sorted(got[r.id])] == want
    assert len(got) == 4000
    close = I._close_pairs(left, right, ("lat", "lon"), ("slat", "slon"), "station", 3, 1000.0).groupBy("_kw_0", "_kw_1").count().agg(F.max("count"), F.avg("count")).first()
    assert close[0] <= 100 and close[1] <= 30  # of 3,000 within one cube of 1,000 km
