"""Chunked operators: the chunk width must never change a result, and brute force agrees."""

import random

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from knownwhen.operators import aggregates as A
from knownwhen.operators import asof
from knownwhen.operators import intervals as I
from knownwhen.operators import ordered as O
from knownwhen.operators import pit
from knownwhen.operators import ranks as R
from knownwhen.operators import sequences as Q


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", None]), rng.randrange(0, 4000), i, rng.choice([None, float(rng.randrange(50))])) for i in range(1500)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "id", "v"])
    return spark.createDataFrame(rows, "k string, t long, id long, v double"), pdf


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_scan_matches_pandas(series, chunk):
    df, pdf = series
    got = O.scan(df, ["k"], "t", last={"l": "v"}, upcoming={"n": "v"}, before={"p": "id"}, after={"q": "id"},
                 sums={"s": F.coalesce("v", F.lit(0.0))}, ties=["id"], chunk=chunk).toPandas().sort_values("id").reset_index(drop=True)
    want = []
    for _, g in pdf.sort_values(["t", "id"]).groupby(pdf.k.fillna("~")):
        g = g.copy()
        g["l"], g["n"], g["p"], g["q"], g["s"] = g.v.ffill(), g.v.bfill(), g.id.shift(1), g.id.shift(-1), g.v.fillna(0).cumsum()
        want.append(g)
    want = pd.concat(want).sort_values("id").reset_index(drop=True)
    for c in "lnpqs":
        assert got[c].astype(float).fillna(-1).tolist() == pytest.approx(want[c].astype(float).fillna(-1).tolist()), c


@pytest.mark.parametrize("chunk", [11, 5000])
def test_asof_matches_pandas(series, spark, chunk):
    df, pdf = series
    left = spark.createDataFrame([(k, t) for k in ("hot", "a") for t in range(0, 4100, 13)], "k string, at long")
    got = asof.asof_join(left, df, "at", "t", ["k"], {"id": "id", "v": "v"}, ties=["id"], chunk=chunk).toPandas().sort_values(["k", "at"])
    right = pdf[pdf.k.notna()].sort_values(["t", "id"])
    want = pd.merge_asof(left.toPandas().sort_values("at"), right, left_on="at", right_on="t", by="k").sort_values(["k", "at"])
    assert got.id.fillna(-1).tolist() == want.id.fillna(-1).tolist()


def test_span_sums_match_brute_force(series, spark):
    df, pdf = series
    w = spark.createDataFrame([("hot", a, a + b) for a in range(0, 4000, 111) for b in (1, 50, 900)], "k string, a long, b long")
    for closed in ("left", "right"):
        got = asof.span_sums(w, df, "a", "b", "t", ["k"], {"s": F.col("v"), "c": F.lit(1.0)}, closed, chunk=100).collect()
        for r in got:
            g = pdf[pdf.k == "hot"]
            hit = g[(g.t >= r.a) & (g.t < r.b)] if closed == "left" else g[(g.t > r.a) & (g.t <= r.b)]
            assert (r.s, r.c) == pytest.approx((hit.v.sum(), float(len(hit))))


def test_lookback_counts_the_publication_at_the_origin(frame):
    rows = [("s", f"2025-01-01 0{h}:00", float(h + 1)) for h in range(4)]
    s = frame(rows, "k string, ts timestamp_ntz, v double").withColumn("pub", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    o = frame([("s", "2025-01-01 03:00"), ("s", "2025-01-01 00:30")], "k string, t0 timestamp_ntz")
    f = {"m": ("mean", F.col("v")), "x": ("max", F.col("v")), "s": ("sum", F.col("v"))}
    got = {r.t0.hour: r for r in pit.pit_lookback(s, o, ["k"], "ts", "pub", "t0", f, 2, 1).collect()}
    assert (got[3].m, got[3].x, got[3].s) == (2.5, 3.0, 5.0) and got[0].m is None
    thin = s.withColumn("v", F.when(F.col("v") == 3, F.col("v")))
    got = pit.pit_lookback(thin, o, ["k"], "ts", "pub", "t0", {"m": ("mean", F.col("v"))}, 4, 2).collect()
    assert all(r.m is None for r in got)


def test_metamorphic_origin_in_the_future_equals_everything(frame):
    rows = [("s", f"2025-01-0{d} 00:00", float(d)) for d in range(1, 8)]
    s = frame(rows, "k string, ts timestamp_ntz, v double").withColumn("pub", F.col("ts"))
    o = frame([("s", "2100-01-01 00:00")], "k string, t0 timestamp_ntz")
    assert pit.pit_lookback(s, o, ["k"], "ts", "pub", "t0", {"m": ("mean", F.col("v"))}, 7, 1).first().m == 4.0


def brute_latest(rows):
    out = {}
    for hour in range(0, 60):
        live = [r for r in rows if r[1] <= hour < r[2]]
        if live:
            out[hour] = max(live, key=lambda r: r[3])[4]
    return out


@pytest.mark.parametrize("bin", ["4 hours", "1 day", "90 days"])
def test_latest_created_wins(spark, bin):
    rng = random.Random(2)
    rows = [("u", a := rng.randrange(0, 50), a + rng.randrange(1, 15), i, float(i)) for i in range(80)]
    ts = lambda c: F.timestamp_micros(F.col(c) * 3_600_000_000).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "u string, a long, b long, created int, mw double").withColumns({"s": ts("a"), "e": ts("b")})
    got = {}
    for r in I.resolve_latest(df, ["u"], "s", "e", ["created"], {"mw": "mw"}, bin).collect():
        a, b = (int((x - pd.Timestamp("1970-01-01")).total_seconds() // 3600) for x in (pd.Timestamp(r.seg_start), pd.Timestamp(r.seg_end)))
        for h in range(a, b):
            assert h not in got
            got[h] = r.mw
    assert got == brute_latest(rows)


@pytest.mark.parametrize("leaf,fan", [(64, 16), (3, 2), (5, 16)])
def test_a_crowded_bin_is_split(spark, leaf, fan, monkeypatch):
    """All intervals in one bin, many begin together, one covers everything; pieces compared together stay few, without Python workers."""
    monkeypatch.setattr(I, "LEAF", leaf)
    monkeypatch.setattr(I, "FAN", fan)
    rng = random.Random(3)
    rows = [(None, a := rng.choice([7, 8, 9, rng.randrange(0, 55)]), a + rng.randrange(1, 6), i, float(i)) for i in range(200)] + [(None, 0, 60, -1, -1.0)]
    ts = lambda c: F.timestamp_micros(F.col(c) * 3_600_000_000).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "u string, a long, b long, created int, mw double").withColumns({"s": ts("a"), "e": ts("b")})
    segs = I.resolve_latest(df, ["u"], "s", "e", ["created"], {"mw": "mw"}, "90 days")
    assert "InPandas" not in segs._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in segs.select("mw", (F.unix_micros(F.col("seg_start").cast("timestamp")) / 3_600_000_000).alias("a"), (F.unix_micros(F.col("seg_end").cast("timestamp")) / 3_600_000_000).alias("b")).collect():
        for h in range(60):
            over = min(r.b, h + 1) - max(r.a, h)
            if over > 0:
                assert got.get(h, (r.mw, 0))[0] == r.mw
                got[h] = r.mw, got.get(h, (0, 0))[1] + over
    assert {h: v for h, (v, _) in got.items()} == brute_latest(rows) and all(n == pytest.approx(1) for _, n in got.values())


def test_overlap_join_emits_each_pair_once(spark):
    ts = lambda c: F.timestamp_micros(F.col(c) * 3_600_000_000).cast("timestamp_ntz")
    e = spark.createDataFrame([(i, i * 3, i * 3 + 500) for i in range(40)], "i int, a long, b long").withColumns({"s": ts("a"), "e": ts("b")}).drop("a", "b")
    w = spark.createDataFrame([(i, i * 24, i * 24 + 24) for i in range(30)], "w int, c long, d long").withColumns({"ws": ts("c"), "we": ts("d")}).drop("c", "d")
    got = I.overlap_join(e, w, ("s", "e"), ("ws", "we"), bin="12 hours").select("i", "w").collect()
    want = {(i, j) for i in range(40) for j in range(30) if i * 3 < j * 24 + 24 and i * 3 + 500 > j * 24}
    assert len(got) == len(want) and {(r.i, r.w) for r in got} == want


def test_ranks_with_one_value_in_most_rows(spark):
    rng = random.Random(1)
    rows = [(i, 5.0 if rng.random() < 0.8 else round(rng.random() * 10, 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double")
    pdf = pd.DataFrame(rows, columns=["id", "v"])
    got = R.average_ranks(df, [], {"v": "r"}).toPandas().sort_values("id")
    assert got.r.tolist() == pdf.v.rank().tolist()
    got = R.row_rank(df, [], "v", "id", "r", "n").toPandas().sort_values("id")
    assert got.r.tolist() == pdf.sort_values(["v", "id"]).assign(r=range(1, 2001)).sort_values("id").r.tolist() and set(got.n) == {2000}
    bins = R.equal_bins(df, [], "v", "id", 7).toPandas().sort_values("id")
    want = pd.qcut(pdf.sort_values(["v", "id"]).assign(r=range(1, 2001)).sort_values("id").r, 7, labels=False)
    assert bins.bin.tolist() == want.tolist()
    q = R.quantiles(df, [], "v", {"a": 0.03, "b": 0.5, "c": 0.97}).first()
    assert (q.a, q.b, q.c) == pytest.approx(tuple(pdf.v.quantile([0.03, 0.5, 0.97])))


def test_null_ends_an_episode(frame):
    df = frame([("s", i, v) for i, v in enumerate([True, True, None, True, False, True])], "k string, t long, on boolean")
    got = sorted((r.start, r.end, r.length) for r in Q.episodes(df, ["k"], "t", F.col("on"), chunk=2).collect())
    assert got == [(0, 1, 2), (3, 3, 1), (5, 5, 1)]


def test_decluster_keeps_short_misses_together(frame):
    x = [9, 0, 0, 0, 9, 0, 0, 0, 0, 0, 8]
    df = frame([("s", i, float(v)) for i, v in enumerate(x)], "k string, t long, v double")
    got = sorted((r.start, r.end, r.n_exceed, r.excess) for r in Q.decluster(df, ["k"], "t", "v", F.lit(5.0), 4, chunk=3).collect())
    assert got == [(0, 4, 2, 4.0), (10, 10, 1, 3.0)]


def test_interpolation_span_and_edges(frame):
    v = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    df = frame([("s", f"2025-01-01 {h:02d}:00", x) for h, x in enumerate(v)], "k string, ts timestamp_ntz, v double")
    got = Q.interpolate(df, ["k"], "ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"), ["v"], "2 hours", chunk="3 hours").orderBy("ts").collect()
    assert [r.v for r in got] == pytest.approx([None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None], nan_ok=True)
    assert [r.v_imputed for r in got] == [False, False, True, True] + [False] * 6


def test_decumulate_weeks(frame):
    rows = [("2025-01-06", None), ("2025-01-07", 2.0), ("2025-01-08", None), ("2025-01-09", 5.0), ("2025-01-13", 1.0)]
    df = frame([("s", d, v) for d, v in rows], "k string, ts timestamp_ntz, c double")
    got = Q.decumulate(df, ["k"], "ts", "c", F.date_trunc("week", "ts"), "x", chunk="2 days").orderBy("ts").collect()
    assert [r.x for r in got] == [0.0, 2.0, 0.0, 3.0, 1.0]


@pytest.mark.parametrize("chunk", [3, 50, 4096])
def test_decay_state_is_the_recurrence(spark, chunk):
    n = [1.0 if i % 17 in (0, 3) else 0.0 for i in range(300)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(n)], "k string, t long, n double")
    got = [r.state for r in Q.decay_state(df, ["k"], "t", "n", 4.0, chunk=chunk, rows_chunk=40).orderBy("t").collect()]
    want, s, d = [], 0.0, 2 ** (-1 / 4)
    for x in n:
        want.append(s)
        s = d * s + x
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("half_life,chunk", [(1e6, 8), (1e6, 4096), (30.0, 5), (0.5, 4096)])
def test_long_and_short_half_lives(spark, half_life, chunk):
    rows = [(k, i, 1.0 if i % (3 + (k or 0)) == 0 else None) for k in (None, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t long, n double")
    out = Q.decay_state(df, ["k"], "t", "n", half_life, chunk=chunk, rows_chunk=100)
    got = {(r.k, r.t): r.state for r in out.collect()}
    want, d = {}, 2 ** (-1 / half_life)
    for k in (None, 1):
        s = 0.0
        for _, i, x in [r for r in rows if r[0] == k]:
            want[k, i] = s
            s = d * s + (x or 0.0)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], rel=1e-9, abs=1e-12) for c in want)


@pytest.mark.parametrize("days", [1, 3, 40])
def test_moving_quantiles_from_count_tables(spark, days):
    rng = np.random.default_rng(days)
    rows = [(k, int(d), None if rng.random() < 0.1 else float(np.round(rng.normal() * 4))) for k in ("a", None) for d in range(60) if rng.random() < 0.8 for _ in range(int(rng.integers(1, 30)))]
    rows += [("a", 30, 1.0)] * 2000 + [("a", None, 3.0), ("empty", 3, None)]  # a hot value, a missing day, a series without values
    df = spark.createDataFrame(rows, "k string, d int, v double").withColumn("day", F.date_from_unix_date("d"))
    got = Q.rolling_thresholds(df, ["k"], "day", "v", {"q1": 0.1, "q5": 0.5, "top": 1.0}, days, 3).join(Q.robust_stats(df, ["k"], "day", "v", days, 3).withColumnRenamed("k", "k2").withColumnRenamed("day", "day2"),
                                                                                                        F.expr("k <=> k2 and day <=> day2")).select("*", F.unix_date("day").alias("d")).collect()
    assert {(r.k, r.d) for r in got} == {(k, d) for k, d, _ in rows} and len(got) == len({(k, d) for k, d, _ in rows})
    for r in got:
        past = [v for k, d, v in rows if k == r.k and v is not None and d is not None and r.d is not None and r.d - days <= d < r.d]
        assert r.n_past == len(past)
        if len(past) < 3:
            assert r.q1 is r.top is r.mad is None
        else:
            assert [r.q1, r.q5, r.top] == pytest.approx(list(np.quantile(past, [0.1, 0.5, 1.0])))
            assert r.median == r.q5 and r.mad == pytest.approx(1.4826 * np.median(np.abs(np.array(past) - r.q5)))


def test_spike_logic(frame):
    df = frame([(None, 1.0, False, -1.0), (5.0, None, False, -1.0), (5.0, 1.0, True, 1.0), (5.0, 1.0, True, -1.0), (5.0, 1.0, True, None), (0.5, 1.0, False, None)],
               "p double, thr double, single boolean, imb double")
    got = [r.s for r in df.select(Q.spikes(df, "p", F.col("thr"), True, F.col("single"), "imb").alias("s")).collect()]
    assert got == [None, None, 0, 1, None, 0]


def test_dedup_collapses_copies_map_side(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    plan = A.dedup(df, ["k"], F.col("v"))
    assert plan.first().v == 999
    assert "partial_max_by" in plan._jdf.queryExecution().executedPlan().toString()
