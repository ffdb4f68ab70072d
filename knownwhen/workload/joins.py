"""Joins beyond plain equality, and checked equality joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import intervals as I
from ..operators import shaping as S
from .registry import DAILY_ORDERS, HOURLY, daily_orders, exact_sum, hourly, query, rounded


@query("assemble_tables", f"""WITH {HOURLY},
a AS (SELECT hour, n AS click_n, value AS price FROM hourly WHERE event_type = 'click'),
b AS (SELECT hour, n AS error_n, value AS price FROM hourly WHERE event_type = 'error'),
c AS (SELECT hour, total AS buy_total FROM hourly WHERE event_type = 'purchase'),
d AS (SELECT hour, n AS signup_n FROM hourly WHERE event_type = 'signup'), e AS (SELECT hour, n AS view_n, value AS price FROM hourly WHERE event_type = 'view')
SELECT hour, a.click_n, b.error_n, round(c.buy_total, 4) AS buy_total, d.signup_n, e.view_n, round(coalesce(a.price, b.price, e.price), 6) AS price
FROM a FULL JOIN b USING (hour) FULL JOIN c USING (hour) FULL JOIN d USING (hour) FULL JOIN e USING (hour)""")
def assemble_tables(t):
    h = hourly(t)

    def part(kind, **cols):
        return h.where(F.col("event_type") == kind).select("hour", *[F.col(c).alias(n) for n, c in cols.items()])

    out = S.assemble({"click": part("click", click_n="n", price="value"), "error": part("error", error_n="n", price="value"),
                      "buy": part("purchase", buy_total="total"), "signup": part("signup", signup_n="n"), "view": part("view", view_n="n", price="value")}, ["hour"], shared=["price"])
    return rounded(rounded(out, 4, "buy_total"), 6, "price")


@query("join_validated", """SELECT n_name, r_name, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE, 2) AS total FROM orders
JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def join_validated(t):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = t("nation").withColumnRenamed("n_regionkey", "r_regionkey")
    places = S.join_validated(n, t("region"), ["r_regionkey"])
    out = S.join_validated(t("orders").join(c, "o_custkey"), places, ["n_nationkey"])
    return rounded(out.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total")), 2)


@query("full_outer", """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem WHERE day(l_shipdate) <= 20 GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS ordered FROM orders WHERE day(o_orderdate) >= 10 GROUP BY 1)
SELECT day, shipped, ordered FROM a FULL JOIN b USING (day)""")
def full_outer(t):
    a = t("lineitem").where(F.dayofmonth("l_shipdate") <= 20).groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("shipped"))
    b = t("orders").where(F.dayofmonth("o_orderdate") >= 10).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("ordered"))
    return a.join(b, "day", "full")


@query("semi_anti_exists", """SELECT o_orderpriority, count(*) FILTER (WHERE r) AS with_return, count(*) FILTER (WHERE NOT r) AS without_return,
  count(*) FILTER (WHERE c_custkey IS NULL) AS no_customer
FROM (SELECT o.*, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS r FROM orders o) LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def semi_anti_exists(t):
    back = t("lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    o = S.flag_exists(t("orders"), back, ["o_orderkey"], "r")
    known = t("customer").select(F.col("c_custkey").alias("o_custkey"))
    o = S.flag_exists(o, known, ["o_custkey"], "k")
    return o.groupBy("o_orderpriority").agg(F.count_if("r").alias("with_return"), F.count_if(~F.col("r")).alias("without_return"),
                                            F.count_if(~F.col("k")).alias("no_customer"))


@query("overlap_pairs", """WITH iv AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderdate AS s, o_orderdate + (o_orderkey % 9 + 1) * INTERVAL 1 DAY AS e, o_orderdate - (o_orderkey % 5) * INTERVAL 1 DAY AS created FROM orders),
w AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS ws, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS we FROM orders)
SELECT p, ws, count(*) AS n, CAST(sum(epoch(least(e, we) - greatest(s, ws))) / 86400 AS BIGINT) AS days FROM iv JOIN w ON s < we AND e > ws AND created <= ws + INTERVAL 10 DAY GROUP BY 1, 2""")
def overlap_pairs(t):
    d = F.col("o_orderdate")
    iv = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), d.alias("s"),
                            T.plus(d, (F.col("o_orderkey") % 9 + 1) * T.DAY).alias("e"), T.plus(d, -(F.col("o_orderkey") % 5) * T.DAY).alias("created"))
    w = t("orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ws")).distinct()
    w = w.withColumns({"we": F.add_months(F.col("ws").cast("date"), 1).cast("timestamp_ntz"), "known": T.plus("ws", "10 days")})
    pairs = I.overlap_join(iv, w, ("s", "e"), ("ws", "we"), known=("created", "known"))
    days = T.floor_div(T.micros("clip_end") - T.micros("clip_start"), T.DAY)
    return pairs.groupBy("p", "ws").agg(F.count(F.lit(1)).alias("n"), F.sum(days).alias("days"))


_PLACES = """c AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1700) / 10.0 - 85.0 AS lat, ((c_custkey * 91) % 3600) / 10.0 - 180.0 AS lon FROM customer),
s AS (SELECT s_suppkey AS station, ((s_suppkey * 53) % 1600) / 10.0 - 80.0 AS slat, ((s_suppkey * 29) % 3600) / 10.0 - 180.0 AS slon FROM supplier)"""


@query("nearest_stations", f"""WITH {_PLACES},
d AS (SELECT id, station, 2 * 6371.0 * asin(sqrt(pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))) AS km FROM c, s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, station) AS rank FROM d)
SELECT id, station, round(km, 4) AS km, rank FROM r WHERE rank <= 3""")
def nearest_stations(t):
    def place(df, key, new, lat, lon, a, b, m, off):
        return df.select(F.col(key).alias(new), (((F.col(key) * a) % m) / 10.0 - off).alias(lat), (((F.col(key) * b) % 3600) / 10.0 - 180.0).alias(lon))

    c = place(t("customer"), "c_custkey", "id", "lat", "lon", 37, 91, 1700, 85.0)
    s = place(t("supplier"), "s_suppkey", "station", "slat", "slon", 53, 29, 1600, 80.0)
    out = I.nearest(c, s, ("lat", "lon"), ("slat", "slon"), "id", "station", 3, finest_km=1000.0)
    return rounded(out.select("id", "station", "km", F.col("rank").cast("long").alias("rank")), 4)


@query("explain_runs", f"""WITH {DAILY_ORDERS}, x AS (SELECT priority, day, lag(day) OVER (PARTITION BY priority ORDER BY day) AS before FROM daily),
runs AS (SELECT priority AS series, CAST(before + INTERVAL 1 DAY AS TIMESTAMP) AS start, CAST(day AS TIMESTAMP) AS stop FROM x WHERE day > before + INTERVAL 1 DAY),
known AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS known_start, date_trunc('quarter', o_orderdate) + INTERVAL 40 DAY AS known_stop,
   CASE WHEN quarter(o_orderdate) % 2 = 0 THEN 'URGENT|HIGH' ELSE 'LOW' END AS pattern, 'outage ' || strftime(date_trunc('quarter', o_orderdate), '%Y-%m') AS note FROM orders)
SELECT r.series, r.start, r.stop, string_agg(DISTINCT note, '; ' ORDER BY note) AS notes FROM runs r
LEFT JOIN known ON known_start < stop AND known_stop > start AND regexp_matches(series, pattern) GROUP BY 1, 2, 3""")
def explain_runs(t):
    from ..operators.intervals import interval_gaps

    d = daily_orders(t).select(F.col("priority").alias("series"), F.col("day").cast("timestamp_ntz").alias("s"),
                               T.plus(F.col("day").cast("timestamp_ntz"), "1 day").alias("e"))
    runs = interval_gaps(d, ["series"], "s", "e", "365 days").select("series", F.col("gap_start").alias("start"), F.col("gap_end").alias("stop"))
    q = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    known = t("orders").select(
        q.alias("known_start"), T.plus(q, "40 days").alias("known_stop"),
        F.when(F.quarter("o_orderdate") % 2 == 0, "URGENT|HIGH").otherwise("LOW").alias("pattern"),
        F.concat(F.lit("outage "), F.date_format(q, "yyyy-MM")).alias("note")).distinct()
    return I.explain_runs(runs, known, "series", "pattern", "note")


@query("bound_join", """SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity * 100 > p_retailprice) AS n_above,
  round(sum(CASE WHEN NOT l_quantity * 100 > p_retailprice THEN l_quantity END), 2) AS kept FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def bound_join(t):
    limit = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    df = t("lineitem").join(limit, "l_partkey", "left")
    df = S.flag_and_null(df, "l_quantity", F.col("l_quantity") * 100 > F.col("p_retailprice"), "above")
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if("above").alias("n_above"), F.round(F.sum("l_quantity"), 2).alias("kept"))


@query("parameter_grid", """WITH k AS (SELECT unnest([0.6, 0.9, 1.0, 1.2])::DOUBLE AS k), tau AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS tau)
SELECT k, tau, l_returnflag, round(avg(greatest(tau * (l_quantity - 25 * k), (tau - 1) * (l_quantity - 25 * k))), 6) AS loss FROM lineitem, k, tau GROUP BY 1, 2, 3""")
def parameter_grid(t):
    # Parameters become an array on each row: no join, and the sums are combined map-side.
    grid = [F.struct(F.lit(k).alias("k"), F.lit(q).alias("tau")) for k in (0.6, 0.9, 1.0, 1.2) for q in (0.1, 0.5, 0.9)]
    x = t("lineitem").select("l_returnflag", "l_quantity", F.explode(F.array(*grid)).alias("g")).select("*", "g.*")
    from ..functions.numeric import pinball

    loss = pinball("l_quantity", F.col("k") * 25, F.col("tau"))
    return rounded(x.groupBy("k", "tau", "l_returnflag").agg(F.avg(loss).alias("loss")))
