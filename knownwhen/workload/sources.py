"""Ingestion, layout changes, copies, manifests and source merging on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import quality as Y
from ..operators import shaping as S
from ..operators.aggregates import dedup
from ..sources import ingest as N
from ..sources import tables as B
from .registry import query, rounded


@query("series_two_trees", """WITH a AS (SELECT event_id, ts, value, 0 AS tree FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, ts, value + 1 AS value, 1 AS tree FROM events WHERE event_id % 3 <> 1)
SELECT event_id, arg_max(ts, tree) AS ts, round(arg_max(value, tree), 4) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def series_two_trees(t):
    e = t("events").select("event_id", "ts", "value")
    old = e.where(F.col("event_id") % 3 != 0).withColumn("tree", F.lit(0))
    new = e.where(F.col("event_id") % 3 != 1).withColumns({"tree": F.lit(1), "value": F.col("value") + 1})
    return rounded(dedup(S.union_all([old, new]), ["event_id"], F.col("tree")).drop("tree"), 4)


@query("union_missing_cols", """SELECT 'orders' AS source, o_orderkey AS k, o_totalprice AS amount, NULL AS flag FROM orders UNION ALL SELECT 'lines', l_orderkey, l_extendedprice, l_returnflag FROM lineitem""")
def union_missing_cols(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    l = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("flag"))
    return S.union_all([o, l], "source", ["orders", "lines"])


@query("json_arrays_to_rows", """SELECT user_id, epoch_ms(CAST(floor(epoch(ts)) AS BIGINT) * 1000)::TIMESTAMP AS ts, event_type AS name, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def json_arrays_to_rows(t):
    # Pack each user-hour into the array layout as JSON text, then read that text back into rows.
    e = t("events").select("user_id", F.date_trunc("hour", "ts").alias("day"), F.floor(T.micros("ts") / 1_000_000).alias("sec"), "event_type", "value", "event_id")
    per = e.groupBy("user_id", "day", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "sec", "value"))).alias("p"))
    packed = per.select("user_id", F.to_json(F.struct(F.col("p.sec").alias("unix_seconds"),
                        F.array(F.struct(F.col("event_type").alias("name"), F.col("p.value").alias("data"))).alias("series"))).alias("doc"))
    parsed = N.parse_json(packed, "doc", "unix_seconds array<bigint>, series array<struct<name:string, data:array<double>>>").select("user_id", "doc.*")
    rows = N.arrays_to_rows(parsed, ["user_id"], "unix_seconds", "series")
    return rows.groupBy("user_id", "ts", "name").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


@query("xml_points", """WITH p AS (SELECT o_orderkey, l_linenumber AS pos, max(l_quantity) AS q, any_value(o_orderdate) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
n AS (SELECT *, lead(pos) OVER (PARTITION BY o_orderkey ORDER BY pos) AS nxt FROM p)
SELECT o_orderkey, s + (pos - 1) * INTERVAL 1 DAY AS start_utc, CASE WHEN nxt IS NULL THEN s + INTERVAL 7 DAY ELSE s + (nxt - 1) * INTERVAL 1 DAY END AS end_utc, q AS quantity FROM n""")
def xml_points(t):
    # Build the nested document text of every order, parse it as XML, flatten to one row per point.
    li = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    tag = F.concat(F.lit("<Point><position>"), F.col("l_linenumber"), F.lit("</position><quantity>"), F.col("q"), F.lit("</quantity></Point>"))
    docs = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(tag), "").alias("pts")).join(
        t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    text = F.concat(F.lit("<Period><start>"), stamp(F.col("o_orderdate")), F.lit("</start><end>"), stamp(T.plus("o_orderdate", "7 days")),
                    F.lit("</end><resolution>P1D</resolution>"), F.col("pts"), F.lit("</Period>"))
    schema = "start string, end string, resolution string, Point array<struct<position:int, quantity:double>>"
    d = N.parse_xml(docs.select("o_orderkey", text.alias("x")), "x", schema).select(
        "o_orderkey", F.col("x.start").cast("timestamp_ntz").alias("s"), F.col("x.end").cast("timestamp_ntz").alias("e"),
        F.col("x.resolution").alias("res"), F.col("x.Point").alias("points"))
    return N.explode_points(d, ["o_orderkey"], "s", "e", N.resolution_micros("res"), "points")


@query("unpivot_hours", """WITH h AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hr, count(*) AS value FROM events GROUP BY 1, 2)
SELECT timezone('UTC', timezone('Europe/Zurich', CAST(day AS TIMESTAMP) + hr * INTERVAL 1 HOUR)) AS start_utc, timezone('UTC', timezone('Europe/Zurich', CAST(day AS TIMESTAMP) + hr * INTERVAL 1 HOUR)) + INTERVAL 1 HOUR AS end_utc, CAST(value AS DOUBLE) AS value FROM h""")
def unpivot_hours(t):
    wide = (t("events").select(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"))
            .groupBy("day").pivot("hour", list(range(24))).count())
    wide = wide.toDF("day", *[f"Hour {h + 1}" for h in range(24)])
    return N.unpivot_hours(wide, [], "day", {f"Hour {h + 1}": str(h + 1) for h in range(24)}, "Europe/Zurich")


@query("stack_levels", """SELECT l_suppkey, l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3""")
def stack_levels(t):
    li = t("lineitem").withColumn("label", F.concat_ws("|", "l_returnflag", "l_linestatus"))
    labels = [f"{a}|{b}" for a in "ANR" for b in "FO"]
    wide = li.groupBy("l_suppkey").pivot("label", labels).agg(F.sum("l_quantity"))
    return N.stack_levels(wide, ["l_suppkey"], labels, ["flag", "status"]).where(F.col("value").isNotNull())


@query("best_copy", """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS file, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY 1, 2),
b AS (SELECT day, min_by(file, (-n, -newest, file)) AS file FROM f GROUP BY 1)
SELECT o.o_orderkey, b.day, b.file FROM orders o JOIN b ON b.day = CAST(o_orderdate AS DATE) AND b.file = o.o_orderpriority""")
def best_copy(t):
    o = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("file"))
    return B.pick_best_copy(o, ["day"], "file", {"n": F.count(F.lit(1)), "newest": F.max("o_orderkey")}, [-F.col("n"), -F.col("newest")])


@query("copy_conflicts", """WITH f AS (SELECT o_custkey, o_orderpriority AS file, count(*) AS m FROM orders GROUP BY 1, 2)
SELECT o_custkey, count(*) AS files, count(DISTINCT m) AS variants FROM f GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT m) > 1""")
def copy_conflicts(t):
    return B.copy_conflicts(t("orders").withColumn("file", F.col("o_orderpriority")), ["o_custkey"], "file", F.count(F.lit(1)))


@query("overlap_diff", """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0)
SELECT 'o_totalprice' AS "column", count(*) AS common, count(*) FILTER (WHERE abs(p - o_totalprice) > 0.01) AS different FROM b JOIN orders USING (o_orderkey)
UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (WHERE b.o_orderkey % 7 = 0) FROM b JOIN orders USING (o_orderkey)""")
def overlap_diff(t):
    o = t("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    k = F.col("o_orderkey")
    b = o.where(k % 2 == 0).withColumns({"o_totalprice": F.col("o_totalprice") + F.when(k % 10 == 0, 1).otherwise(0),
                                         "o_custkey": F.when(k % 7 != 0, F.col("o_custkey"))})
    return Y.overlap_diff(o, b, ["o_orderkey"], ["o_totalprice", "o_custkey"], 0.01)


@query("anti_new_wins", """WITH n AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'new' AS layout FROM orders WHERE o_orderpriority = '1-URGENT'), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'old' AS layout FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE day NOT IN (SELECT day FROM n)""")
def anti_new_wins(t):
    o = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    new = o.where(urgent).drop("o_orderpriority").withColumn("layout", F.lit("new"))
    old = o.where(~urgent).drop("o_orderpriority").withColumn("layout", F.lit("old"))
    return S.prefer_new(new, old, ["day"])


@query("manifest_merge", """WITH o AS (SELECT year(o_orderdate) AS year, o_orderpriority AS part, count(*) AS rows, 'old' AS run FROM orders GROUP BY 1, 2), n AS (SELECT year(o_orderdate) AS year, o_orderpriority AS part, count(*) AS rows, 'new' AS run FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1999 GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.year = o.year AND n.part = o.part)""")
def manifest_merge(t):
    def manifest(df, run):
        return df.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).alias("rows")).withColumn("run", F.lit(run))

    o = t("orders")
    return B.merge_by_key(manifest(o, "old"), manifest(o.where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") >= 1999)), "new"), ["year", "part"])


@query("file_manifest", """SELECT 'events.parquet' AS file, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, 0.0::DOUBLE AS null_share FROM events""")
def file_manifest(t):
    m = B.file_manifest(t("events"), "ts", ["value", "user_id", "event_type"])
    return m.select(F.regexp_extract("source_file", r"([^/]+)$", 1).alias("file"), "rows", "first_ts", "last_ts", "null_share")


@query("series_profile", """WITH s AS (SELECT l_suppkey, l_shipdate AS ts, count(*) AS k FROM lineitem GROUP BY 1, 2), d AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY l_suppkey ORDER BY ts)) AS step FROM s),
c AS (SELECT l_suppkey, step, count(*) AS c FROM d WHERE step IS NOT NULL GROUP BY 1, 2), m AS (SELECT l_suppkey, arg_max(step, (c, -step)) AS modal_step_s FROM c GROUP BY 1)
SELECT l_suppkey, CAST(sum(k) AS BIGINT) AS rows, count(*) AS stamps, min(ts) AS first, max(ts) AS last, any_value(modal_step_s) AS modal_step_s, round(1 - count(*) / sum(k), 8)::DOUBLE AS duplicate_share, 0.0::DOUBLE AS null_share FROM s JOIN m USING (l_suppkey) GROUP BY 1""")
def series_profile(t):
    return rounded(Y.series_profile(t("lineitem"), ["l_suppkey"], "l_shipdate", "l_quantity", "365 days"), 8)


@query("column_dictionary", """SELECT 'discounted' AS "column", min(l_shipdate) FILTER (WHERE l_discount > 0.05) AS start_utc, max(l_shipdate) FILTER (WHERE l_discount > 0.05) AS end_utc, round(avg(CASE WHEN l_discount > 0.05 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 8) AS null_share FROM lineitem
UNION ALL SELECT 'returned', min(l_shipdate) FILTER (WHERE l_returnflag = 'R'), max(l_shipdate) FILTER (WHERE l_returnflag = 'R'), round(avg(CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 8) FROM lineitem""")
def column_dictionary(t):
    li = t("lineitem").select("l_shipdate", F.when(F.col("l_discount") > 0.05, 1.0).alias("discounted"), F.when(F.col("l_returnflag") == "R", 1.0).alias("returned"))
    return rounded(Y.column_dictionary(li, "l_shipdate", ["discounted", "returned"]), 8)
