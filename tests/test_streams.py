"""Append-mode streams over late landings, and the bucketed upsert: bounded state, lost rows, replays, failures."""

import json

import pytest
from pyspark.sql import functions as F

from knownwhen.streaming import intervals as L
from knownwhen.workload import streams as W

SF_DIR = "/root/testdata/sf0.001"


def test_state_is_bounded_and_late_rows_are_lost(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    progress = []
    landed = W.landings(events).cache()
    assert landed.where("event_id % 97 = 0").count() > 0
    out = W.appended(landed, W.SLICES, lambda s: L.interval_features(s, ["event_type"], "ts", F.col("value"), "15 minutes", "1 day", [50], 200.0), progress)
    rows = out.groupBy("event_type", "bucket").count()
    assert rows.where("count > 1").isEmpty() and rows.count() > 500  # a window is appended once
    reports = [json.loads(p.json) if hasattr(p, "json") else p for p in progress]
    state = [s for r in reports for s in r["stateOperators"]]
    assert max(s["numRowsTotal"] for s in state) < rows.count() / 2  # closed windows leave the state
    dropped = sum(s["numRowsDroppedByWatermark"] for s in state)
    want = events.count() - out.agg(F.sum("n")).first()[0]
    open_rows = events.where(F.col("ts") > events.agg(F.max("ts")).first()[0] - F.expr("interval 1 day 15 minutes")).count()
    assert 0 < dropped <= want <= dropped + open_rows


@pytest.fixture()
def batch(spark):
    return lambda rows: spark.createDataFrame(rows, "doc string, rev int, v string")


def rows_of(spark, t):
    return {r.doc: (r.rev, r.v) for r in L.read_latest(spark, t).collect()}


def test_revisions_in_any_order_and_replays(spark, batch, tmp_path):
    t = str(tmp_path / "docs")
    put = lambda rows, k, feed="a": L.upsert_latest(spark, batch(rows), t, ["doc"], "rev", batch_id=k, feed=feed, buckets=4)
    with pytest.raises(FileNotFoundError):
        L.read_latest(spark, t)
    assert put([("d1", 2, "b")], 0) and put([("d1", 1, "a"), ("d2", 1, "x"), (None, 1, "n")], 1) and put([], 2) and put([("d1", 3, "c")], 3)
    want = {"d1": (3, "c"), "d2": (1, "x"), None: (1, "n")}
    assert rows_of(spark, t) == want
    before = sorted(map(tuple, L.commits(spark, t).collect()), key=str)
    assert not put([("d1", 9, "never")], 1) and not put([], 2)  # a committed batch changes nothing, whatever it holds now
    assert rows_of(spark, t) == want and sorted(map(tuple, L.commits(spark, t).collect()), key=str) == before
    assert put([("d2", 5, "y")], 1, feed="b") and rows_of(spark, t) == want | {"d2": (5, "y")}


def test_only_the_buckets_met_are_rewritten(spark, batch, tmp_path):
    t = str(tmp_path / "docs")
    L.upsert_latest(spark, batch([(f"d{i}", 1, "x") for i in range(200)]), t, ["doc"], "rev", batch_id=0, buckets=8)
    L.upsert_latest(spark, batch([("d7", 2, "y")]), t, ["doc"], "rev", batch_id=1, buckets=8)
    done = L.commits(spark, t)
    assert done.where("version = 0").count() == 8 and done.where("version = 1").count() == 1
    assert spark.read.parquet(f"{t}/rows/version=1").count() < 60
    got = rows_of(spark, t)
    assert len(got) == 200 and got["d7"] == (2, "y") and got["d8"] == (1, "x")


def test_failed_batch_and_broken_commit(spark, batch, tmp_path):
    t = str(tmp_path / "docs")
    L.upsert_latest(spark, batch([("d", 1, "a")]), t, ["doc"], "rev", batch_id=0)
    batch([("d", 8, "half")]).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{t}/rows/version=1")  # written, never committed
    assert rows_of(spark, t) == {"d": (1, "a")}
    assert L.upsert_latest(spark, batch([("d", 2, "b"), ("e", 1, "c")]), t, ["doc"], "rev", batch_id=1)
    assert rows_of(spark, t) == {"d": (2, "b"), "e": (1, "c")}
    spark.createDataFrame([("nonsense",)], "value string").write.mode("append").text(f"{t}/_commits")
    with pytest.raises(Exception, match="unreadable commit"):
        L.upsert_latest(spark, batch([("d", 9, "z")]), t, ["doc"], "rev", batch_id=2)
