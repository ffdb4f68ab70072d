"""Operators whose memory follows the width of an exchange instead of the size of the table."""

from pyspark.sql import functions as F

from knownwhen.operators import aggregates as A
from knownwhen.operators import intervals as I
from knownwhen.operators import ordered as O
from knownwhen.operators import quality as Y
from knownwhen.session import WIDE


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_are_distinct_neighbours(spark):
    """Equal values, NULLs and values in different chunks; the values are shuffled as rows once and never held in a hash table."""
    rows = [("a", 5), ("a", 5), ("a", 7), ("a", 900), ("a", None), ("a", None), ("b", 1), (None, 3), (None, 4), (None, 4)]
    df = spark.createDataFrame(rows, "k string, t int")
    out = O.steps(df, ["k"], "t", "next", chunk=10)
    got = sorted(((r.k, r.t, r.next) for r in out.collect()), key=str)
    assert got == sorted([("a", None, 5), ("a", 5, 7), ("a", 7, 900), ("a", 900, None), ("b", 1, None), (None, 3, 4), (None, 4, None)], key=str)


def test_gap_scan_makes_no_grid(spark):
    """Two stamps a century apart: one gap of its length, without a row for each missing hour."""
    df = spark.sql("SELECT 1 AS k, t FROM VALUES (TIMESTAMP_NTZ '1925-01-01 00:10:00'), (TIMESTAMP_NTZ '2025-01-01 00:20:00') AS v(t)")
    out = Y.gap_scan(df, ["k"], "t", "1 hour", F.lit("1925-01-01").cast("timestamp_ntz"), F.lit("2025-01-01 01:00:00").cast("timestamp_ntz"))
    assert "Generate explode" not in _plan(out)
    assert [(r.kind, str(r.start_utc), str(r.end_utc), r.n_missing) for r in out.collect()] == [("gap", "1925-01-01 01:00:00", "2025-01-01 00:00:00", 36525 * 24 - 1)]


def test_segments_and_revisions_use_wide_exchanges(spark):
    """What a task holds follows the width of the exchange: no hash table of points, and all distinct counts of documents after one wide exchange."""
    iv = spark.range(100).selectExpr("id % 3 AS u", "id AS s", "id + 2 AS e", "id % 7 AS r")
    points = I.segments(iv, ["u"], "s", "e", 20)
    assert "hashpartitioning(_kw_group" in _plan(points) and f", {WIDE}), REPARTITION_BY_NUM" in _plan(points)
    assert sorted(tuple(r) for r in points.where("u = 0 AND p < 6").collect()) == [(0, 0, 2), (0, 2, 3), (0, 3, 5), (0, 5, 6)]
    d = spark.sql("SELECT id % 5 AS doc, id % 3 AS rev, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS c, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS s FROM range(60)")
    stats = A.revision_stats(d, "doc", "rev", "c", "s")
    assert f", {WIDE}), REPARTITION_BY_NUM" in _plan(stats) and "ENSURE_REQUIREMENTS" not in _plan(stats).replace("SinglePartition, ENSURE_REQUIREMENTS", "")
    r = stats.first()
    assert (r.documents, r.mean_revisions, r.mean_lead_hours) == (5, 3.0, 24.0)


def test_resolve_latest_searches_crowded_bins_only(spark, monkeypatch):
    """Bins of few pieces move once; a crowded bin still loses its hidden pieces before it is cut."""
    searched = []
    search = I._visible_only
    monkeypatch.setattr(I, "_visible_only", lambda pieces: searched.append(pieces.count()) or search(pieces))
    t = "timestamp_micros(({0}) * 86400000000L)"
    few = spark.range(40).selectExpr("id % 4 AS u", f"CAST({t.format('id')} AS TIMESTAMP_NTZ) AS s", f"CAST({t.format('id + 3')} AS TIMESTAMP_NTZ) AS e", "id AS created", "id AS mw")
    out = I.resolve_latest(few, ["u"], "s", "e", ["created"], {"mw": "mw"}, "20 days").collect()
    assert not searched and sorted(r.mw for r in out if r.u == 0) == sorted([*range(0, 40, 4)] + [m for m in range(0, 40, 4) if m // 20 != (m + 2) // 20])
    many = few.where("u = 0").unionByName(spark.range(100, 400).selectExpr("9L AS u", f"CAST({t.format('id % 5')} AS TIMESTAMP_NTZ) AS s", f"CAST({t.format('20')} AS TIMESTAMP_NTZ) AS e", "id AS created", "id AS mw"))
    out = I.resolve_latest(many, ["u"], "s", "e", ["created"], {"mw": "mw"}, "20 days").where("u = 9").collect()
    assert searched == [300] and sorted((r.seg_start.day, r.mw) for r in out) == [(1, 395), (2, 396), (3, 397), (4, 398), (5, 399)]
