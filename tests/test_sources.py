"""Files in and out, schema drift, contracts, validation and the upsert of revisions."""

import pytest
from pyspark.sql import functions as F

from knownwhen.functions import text as X
from knownwhen.operators import quality as Y
from knownwhen.operators import shaping as S
from knownwhen.plans import aggregation as P
from knownwhen.sources import ingest as N
from knownwhen.sources import tables as B


def test_views_series_and_drift(spark, frame, tmp_path):
    a = frame([("2025-01-01 00:00", 1.0), ("2025-01-01 01:00", 2.0)], "ts timestamp_ntz, v double")
    b = frame([("2025-01-01 01:00", 9.0, 5.0)], "ts timestamp_ntz, v double, extra double")
    a.coalesce(1).write.parquet(str(tmp_path / "lake/old/load.parquet"))
    b.coalesce(1).write.parquet(str(tmp_path / "lake/new/load.parquet"))
    assert B.register_views(spark, str(tmp_path / "lake")) == ["new__load_parquet", "old__load_parquet"]
    assert spark.sql("SELECT count(*) AS n FROM old__load_parquet").first().n == 2
    s = B.scan_series(spark, [[str(tmp_path / "lake/old/load.parquet")], [str(tmp_path / "lake/new/load.parquet")]], "ts")
    got = {r.ts.hour: (r.v, r.extra) for r in s.collect()}
    assert got == {0: (1.0, None), 1: (9.0, 5.0)}
    u = B.read_union(spark, [str(tmp_path / "lake/old/load.parquet"), str(tmp_path / "lake/new/load.parquet")])
    assert sorted(u.columns) == ["extra", "ts", "v"] and u.count() == 3
    m = B.file_manifest(u, "ts", ["v", "extra"])
    assert sorted((r.rows, r.null_share) for r in m.collect()) == [(1, 0.0), (2, 0.5)]


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("# note\nzeit;wert\n2025;1,5\n", encoding="latin-1")
    df = N.read_csv(spark, [str(tmp_path / "ok.csv")], ["zeit", "wert"], encoding="ISO-8859-1", comment="#")
    assert N.cast_if_clean(df, ["wert", "zeit"], decimal=",").first().asDict() == {"zeit": 2025.0, "wert": 1.5}
    (tmp_path / "bad.csv").write_text("zeit;other\n2025;1\n")
    with pytest.raises(Exception):
        N.read_csv(spark, [str(tmp_path / "bad.csv")], ["zeit", "wert"]).collect()


def test_cast_only_if_everything_parses(spark):
    df = spark.createDataFrame([("1", "a"), ("n/a", "2"), (None, "3")], "x string, y string")
    out = N.cast_if_clean(df, ["x", "y"])
    assert dict(out.dtypes) == {"x": "double", "y": "string"}


def test_header_contract(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "`Load MW` string, `Price EUR` string")
    values, bad = N.enforce_contract(df, {"Load MW": ("load", "load"), "Price EUR": ("price", "price")})
    assert values.columns == ["load", "price"] and {r["column"]: r.not_numeric for r in bad.collect()} == {"load": 0, "price": 1}
    with pytest.raises(ValueError):
        N.enforce_contract(df, {"Load MW": ("load", "load")})


def test_xml_file_source(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><ts><t>2025-01-01</t><v>1.5</v></ts><ts><t>2025-01-02</t><v>2.5</v></ts></r>")
    rows = N.read_xml(spark, [str(tmp_path / "a.xml")], "ts", "t string, v double").orderBy("t").collect()
    assert [(r.t, r.v) for r in rows] == [("2025-01-01", 1.5), ("2025-01-02", 2.5)]


def test_dynamic_partition_write(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(2020, 1), (2021, 2)], "year int, v int")
    assert B.write_table(df, path, ["year"]) is False
    B.write_table(df, path, ["year"], dry_run=False)
    B.write_table(spark.createDataFrame([(2021, 9)], "year int, v int"), path, ["year"], dry_run=False)
    assert sorted((r.year, r.v) for r in spark.read.parquet(path).collect()) == [(2020, 1), (2021, 9)]
    todo = B.missing_partitions(df, spark.read.parquet(path).where("year = 2020"), ["year"])
    assert [r.year for r in todo.collect()] == [2021]


def test_clean_sink_validates_before_writing(spark, frame, tmp_path):
    pattern = X.grammar(["ch"], ["mw"])
    df = frame([("2025-01-01 00:00", 1.0), ("2025-01-01 01:00", None), ("2026-01-01 00:00", 5.0)], "ts_utc timestamp_ntz, ch_load_mw double")
    d = [{"column": "ch_load_mw", "aggregation_rule": "mean"}]
    out = B.write_clean(df, str(tmp_path / "c"), "ts_utc", pattern, d, "2025-01-01", "2025-12-31", dry_run=False).first()
    assert out.null_share == 0.5 and str(out.end_utc) == "2025-01-01 00:00:00" and spark.read.parquet(str(tmp_path / "c")).count() == 2
    for bad in (df.withColumnRenamed("ch_load_mw", "load"), df.union(df)):
        with pytest.raises(ValueError):
            B.write_clean(bad, str(tmp_path / "d"), "ts_utc", pattern, d, "2025-01-01", "2025-12-31", dry_run=False)
    assert not (tmp_path / "d").exists()


def test_validated_join_fails_on_repeated_keys(spark):
    left, right = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert S.join_validated(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="not unique"):
        S.join_validated(left, right.union(right), ["k"]).collect()


def test_strict_mapping_and_renames(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    assert [r.m for r in S.map_values(df, "c", {"a": "A"}, "m", strict=False).collect()] == ["A", None]
    with pytest.raises(Exception, match="no mapping"):
        S.map_values(df, "c", {"a": "A"}, "m").collect()
    with pytest.raises(KeyError):
        S.rename_strict(df, {"x": "y"})
    assert S.rename_strict(df, {"c": "d"}).schema["d"].metadata == {"source": "c"}


def test_expectations_block_a_failing_table(spark):
    e = Y.Expectations().never("positive", F.col("id") < 0).holds("three rows", F.count(F.lit(1)) == 3)
    assert e.enforce(spark.range(3)).count() == 3
    with pytest.raises(ValueError, match="three rows"):
        e.enforce(spark.range(4))


def test_assemble_refuses_unruled_duplicates(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(1, 3.0), (2, 4.0)], "k int, v double")
    with pytest.raises(ValueError):
        S.assemble({"a": a, "b": b}, ["k"])
    assert {r.k: r.v for r in S.assemble({"a": a, "b": b}, ["k"], shared=["v"]).collect()} == {1: 2.0, 2: 4.0}


def test_roles_and_feature_columns():
    plan = P.build_plan([{"column": "load", "aggregation_rule": "mean", "flags": None}])
    names = ["load__lb24h", "load__dw", "load__pf", "block_start", "cal_dow", "load", "load_imputed"]
    d = [{"column": c, "role": P.role_of(c, c.split("__")[0] in plan.kinds)} for c in names]
    assert P.feature_columns(d, names) == ["load__lb24h", "load__dw", "cal_dow", "load", "load_imputed"]
    assert P.feature_columns(d, names, perfect=True) == ["load__lb24h", "load__pf", "cal_dow", "load", "load_imputed"]
    with pytest.raises(ValueError):
        P.rule_kind("median of something")
    with pytest.raises(KeyError):
        P.build_plan([{"column": "p", "aggregation_rule": "volume-weighted mean", "flags": ""}])


def test_view_dictionary(spark):
    plan = P.build_plan([{"column": "load", "aggregation_rule": "mean", "flags": ""}])
    got = {r["column"]: (r.role, r.base, r.window, r.aggregation) for r in P.view_dictionary(spark, "v", ["load__lb7d", "load"], plan).collect()}
    assert got == {"load__lb7d": ("lookback", "load", "lb7d", "mean"), "load": ("feature", "load", None, "mean")}


def test_prune_columns(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("copy"), F.lit(1.0).alias("flat"),
                                 F.when(F.col("id") < 50, F.rand(1)).alias("gappy"), F.rand(2).alias("b"))
    assert S.prune_columns(df, ["a", "copy", "flat", "gappy", "b"]) == ["a", "b"]


def test_conservation_and_merge(spark):
    a = spark.createDataFrame([(1, 8.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0)] * 4, "k int, v double")
    assert Y.conserved(a, b, {"v": "v"}).first().conserved
    m = B.merge_by_key(spark.createDataFrame([(1, "old"), (2, "old")], "k int, r string"), spark.createDataFrame([(2, "new")], "k int, r string"), ["k"])
    assert {r.k: r.r for r in m.collect()} == {1: "old", 2: "new"}
