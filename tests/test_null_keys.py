"""A NULL series key is a series: keyed operators give it what they give the same series under a name."""

import pytest
from pyspark.sql import functions as F

from knownwhen.functions import timeaxis as T
from knownwhen.operators import aggregates as B
from knownwhen.operators import ordered as O
from knownwhen.operators import pit, quality, sequences, shaping
from knownwhen.plans import aggregation as P
from knownwhen.sources import tables
from knownwhen.streaming import intervals as L


@pytest.fixture(scope="module")
def series(spark):
    """Two equal series on an hourly grid with gaps; one key is named and one is to become NULL."""
    one = spark.range(240).select((F.timestamp_seconds(F.col("id") * 3600 + 1735689600)).cast("timestamp_ntz").alias("ts"), F.col("id"),
                                  F.when(F.col("id") % 17 > 1, (F.col("id") * 7 % 23).cast("double")).alias("v"))
    return one.crossJoin(spark.createDataFrame([("a",), ("b",)], "k string")).where("id % 40 < 35")


def rows(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(sorted((c, plain(r[c])) for c in df.columns if c != "k"))) for r in df.collect())


OPERATORS = {
    "label_episodes": lambda s: sequences.label_episodes(s, ["k"], "ts", F.col("v") > 9, "2 days"),
    "null_runs": lambda s: sequences.null_runs(s, ["k"], "ts", "v", chunk="2 days"),
    "acf": lambda s: sequences.acf(s.where("v is not null"), ["k"], "ts", "v", [1, 3], "2 days"),
    "lag_join": lambda s: pit.lag_join(s, ["k"], "ts", ["v"], [1, 2]),
    "pit_lookback": lambda s: pit.pit_lookback(s.withColumn("pub", T.plus("ts", "1 hour")), s.where("id % 24 = 5").select("k", F.col("ts").alias("o")), ["k"], "ts", "pub", "o",
                                               {"m": ("mean", F.col("v")), "x": ("max", F.col("v"))}, 8, 3),
    "gap_scan": lambda s: quality.gap_scan(s, ["k"], "ts", "1 hour", F.lit("2024-12-31").cast("timestamp_ntz"), F.lit("2025-01-12").cast("timestamp_ntz")),
    "replace_copied": lambda s: quality.replace_copied(s.withColumns({"w": F.col("v"), "z": F.lit(1.0)}), "v", "w", "z", F.floor(F.col("id") / 50), ["k"]),
    "climatology": lambda s: sequences.climatology(s.withColumns({"y": (F.col("v") > 9).cast("int"), "cell": F.col("id") % 3}), ["cell"], "ts", "y", 10, 3, ["k"], "2 days"),
    "latest_revision": lambda s: B.latest_revision(s, "k", "id"),
    "merge_by_key": lambda s: tables.merge_by_key(s.withColumn("r", F.lit("old")), s.withColumn("r", F.lit("new")), ["k", "ts"]),
    "prefer_new": lambda s: shaping.prefer_new(s, s.withColumn("v", F.lit(0.0)), ["k", "ts"]),
    "missing_buckets": lambda s: quality.missing_buckets(s, s.where("id % 3 = 0"), ["k", "ts"]),
    "dense_rank_of": lambda s: shaping.dense_rank_of(s, ["k"], "v", "rank"),
    "flag_exists": lambda s: shaping.flag_exists(s, s.where("id < 50"), ["k", "ts"], "seen"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_null_series_equals_named_series(series, name):
    out = OPERATORS[name](series.withColumn("k", F.nullif(F.col("k"), F.lit("b"))))
    named, null = rows(out.where("k = 'a'")), rows(out.where("k is null"))
    assert named == null
    assert named or name == "missing_buckets"


def test_rows_without_order_value_stay(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("a", None, 5.0), (None, None, 6.0), (None, 3, 1.0)], "k string, t long, v double")
    out = O.rolling_time(df, ["k"], "t", {"s": F.sum("v")}, before=2).collect()
    assert len(out) == 13 and {r.s for r in out if r.t is None} == {None}
    assert {r.t: r.s for r in out if r.k == "a" and r.t is not None}[5] == 12.0
    assert O.rolling_rows(df, ["k"], "t", {"s": F.sum("v")}, 2, F.col("v"), chunk=4).count() == 13


def test_order_needs_an_exact_axis(spark):
    df = spark.createDataFrame([(1.5, 2)], "x double, y int")
    with pytest.raises(TypeError):
        T.order_key(df, "x")
    big = spark.createDataFrame([(2**62 + 3,), (-(2**62) - 1,)], "n long").select(T.floor_div(F.col("n"), 2).alias("q")).collect()
    assert [r.q for r in big] == [2**61 + 1, -(2**61) - 1]


def test_long_plan_equals_wide_plan(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, True, "x", 5), ("a", 0, 3.0, 1.0, None, "y", None), ("a", 0, None, 4.0, False, "y", 7), (None, 0, 2.0, 0.0, False, None, 1)],
                               "k string, bad int, p double, w double, f boolean, m string, n long")
    plan = P.Plan({"p": "vwmean", "w": "mean", "f": "any", "m": "mode", "n": "sum"}, {"p": "w"}, {"w": ["bad"]})
    wide, long = P.aggregate(df, ["k"], plan), P.aggregate_long(df, ["k"], plan)
    assert long.dtypes == wide.dtypes
    assert sorted(map(str, long.collect())) == sorted(map(str, wide.collect()))
    with pytest.raises(ValueError):
        P.aggregate_long(df, ["k"], P.Plan({"p": "median"}))


def test_numbers_names_and_contracts(spark):
    from knownwhen.functions.text import snake
    from knownwhen.sources import ingest as N

    df = spark.createDataFrame([("1.234,56", "1'000.5", "n.a."), ("-7", "None", "12")], "de string, ch string, x string")
    assert [tuple(r) for r in N.cast_if_clean(df, ["de", "ch", "x"]).collect()] == [(1234.56, 1000.5, None), (-7.0, None, 12.0)]
    assert snake(["a", "a", "a_2"]) == ["a", "a_3", "a_2"] and snake(["Preis (+)", "Preis (-)", "Anteil %"]) == ["preis_pos", "preis_neg", "anteil_pct"]
    with pytest.raises(ValueError):
        N.enforce_contract(df, {"de": ("a", "de"), "ch": ("b", "ch"), "x": ("c", "x")}, max_bad=0)
    with pytest.raises(ValueError):
        N.enforce_contract(df.select("x"), {"x": ("c", "load")}, headers={"x": "Price EUR"})


def test_assemble_and_gates_can_refuse(spark):
    from knownwhen.plans import publication as U

    a = spark.createDataFrame([(1, 10), (1, 20)], "k int, price int")
    with pytest.raises(Exception, match="key repeats"):
        shaping.assemble({"a": a, "b": a.selectExpr("k", "price as other")}, ["k"]).collect()
    blocks = spark.createDataFrame([("p",), ("q",)], "s string").withColumn("b", F.lit("2025-06-02 22:00:00").cast("timestamp_ntz"))
    gates = {"p": U.Gate("g", {None: (1, "10:00")})}
    assert U.gate_closure(blocks, "b", gates, "s", "Europe/Zurich").where("gate_closure_utc is null").count() == 1
    with pytest.raises(Exception, match="no gate closure rule"):
        U.gate_closure(blocks, "b", gates, "s", "Europe/Zurich", strict=True).collect()
