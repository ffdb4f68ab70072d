"""Features of high-rate series, panels, profiles, breakdowns and availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import aggregates as A
from .grids import FULL_HOURS, full_hours
from .registry import DAILY_ORDERS, HOURLY, daily_orders, exact_sum, hourly, query, rounded


@query("interval_features", """WITH x AS (SELECT event_type, date_trunc('hour', ts) AS bucket, value - 50 AS v FROM events)
SELECT event_type, bucket, count(*) AS n, round(avg(v), 8) AS mean, round(avg(abs(v)), 8) AS mean_abs, round(CASE WHEN count(*) > 1 THEN stddev_samp(v) END, 6) AS std,
  round(max(abs(v)), 6) AS max_abs, round(min(v), 6) AS low, round(max(v), 6) AS high, round(sum(greatest(least(v, 200.0), 0.0) / 200), 6) AS up_equivalent,
  round(sum(greatest(least(-v, 200.0), 0.0) / 200), 6) AS down_equivalent, round(avg(CASE WHEN abs(v) > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_outside_10,
  round(avg(CASE WHEN abs(v) > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_outside_50 FROM x GROUP BY 1, 2""")
def interval_features(t):
    out = A.interval_features(t("events"), ["event_type"], T.floor_time("ts", "1 hour"), F.col("value") - 50, [10, 50], 200.0)
    return rounded(rounded(out, 8, "mean", "mean_abs"), 6, "std", "max_abs", "low", "high", "up_equivalent", "down_equivalent",
                   "share_outside_10", "share_outside_50")


@query("weighted_panel", """WITH p AS (SELECT c_nationkey AS station, o_orderdate AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
w AS (SELECT c_nationkey AS station, sum(abs(c_acctbal)) / (SELECT sum(abs(c_acctbal)) FROM customer) AS weight FROM customer GROUP BY 1)
SELECT day, round(coalesce(sum(CASE WHEN value IS NOT NULL THEN weight END), 0) / (SELECT sum(weight) FROM w), 6) AS coverage,
  round(CASE WHEN sum(weight) / (SELECT sum(weight) FROM w) >= 0.1 THEN sum(value * weight) / sum(weight) END, 3) AS value FROM p JOIN w USING (station) GROUP BY 1""")
def weighted_panel(t):
    c = t("customer")
    panel = t("orders").join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("c_nationkey").alias("station"), F.col("o_orderdate").alias("day")).agg(exact_sum("o_totalprice").alias("value"))
    weights = A.shares_of_total(c.withColumn("w", F.abs("c_acctbal")), ["c_nationkey"], [], "w").select(
        F.col("c_nationkey").alias("station"), F.col("share").alias("weight"))
    out = A.weighted_panel(panel, weights, ["station"], ["day"], "value", "weight", 0.1)
    return rounded(rounded(out, 3, "value"), 6, "coverage")


@query("shares_of_total", """WITH p AS (SELECT year(o_orderdate) AS year, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM orders GROUP BY 1, 2)
SELECT year, o_orderpriority, amount, round(amount / sum(amount) OVER (PARTITION BY year), 8) AS share FROM p""")
def shares_of_total(t):
    o = t("orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("amount_"))
    out = A.shares_of_total(o, ["o_orderpriority"], ["year"], "amount_").withColumn("amount", F.col("amount").cast("double"))
    total = out.groupBy("year").agg(F.sum("amount").alias("all"))
    return out.join(total, "year").select("year", "o_orderpriority", "amount", F.round(F.col("amount") / F.col("all"), 8).alias("share"))


@query("descriptive_stats", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 5) AS mean, round(stddev_samp(o_totalprice), 5) AS std, max(o_totalprice) AS max,
  round(avg(CASE WHEN o_totalprice <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_le_0, round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(stddev_samp(o_totalprice) / avg(o_totalprice), 8) AS cv,
  round(quantile_cont(o_totalprice, 0.99) / quantile_cont(o_totalprice, 0.5), 8) AS p99_over_median,
  round((sum(pow(o_totalprice, 3)) / count(*) - 3 * avg(o_totalprice) * sum(pow(o_totalprice, 2)) / count(*) + 2 * pow(avg(o_totalprice), 3)) / pow(stddev_pop(o_totalprice), 3), 5) AS skew
FROM orders GROUP BY 1, 2""")
def descriptive_stats(t):
    out = A.describe_plus(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    out = rounded(rounded(out, 5, "mean", "std"), 8, "cv", "p99_over_median")
    return rounded(rounded(out, 4, "p05", "median", "p95", "p99"), 5, "skew")


@query("crosstab_year", """SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) AS "P" FROM orders GROUP BY 1""")
def crosstab_year(t):
    return A.crosstab(t("orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus", ["F", "O", "P"], share=True)


@query("seasonal_profile", f"""WITH {DAILY_ORDERS}, x AS (SELECT *, year(day) AS year, month(day) AS month, isodow(day) - 1 AS dow FROM daily),
b AS (SELECT year, quantile_cont(price, 0.5) AS base FROM x GROUP BY 1), r AS (SELECT month, dow, price / base AS rel FROM x JOIN b USING (year))
SELECT month, dow, round(quantile_cont(rel, 0.5), 8) AS relative, count(rel) AS n FROM r GROUP BY 1, 2""")
def seasonal_profile(t):
    x = daily_orders(t).withColumns({"year": F.year("day"), "month": F.month("day"), "dow": F.weekday("day").cast("long")})
    return rounded(A.relative_profile(x, ["year"], ["month", "dow"], "price"), 8)


@query("metrics_breakdown", f"""WITH {DAILY_ORDERS}, x AS (SELECT *, CAST(year(day) AS VARCHAR) AS year, CASE WHEN day >= DATE '1999-01-01' THEN 'new' ELSE 'old' END AS regime, CAST(isodow(day) - 1 AS VARCHAR) AS slot FROM daily)
SELECT CASE WHEN GROUPING(year) = 0 THEN 'year' WHEN GROUPING(regime) = 0 THEN 'regime' WHEN GROUPING(slot) = 0 THEN 'slot' ELSE 'pooled' END AS dimension, coalesce(year, regime, slot, 'all') AS label,
  count(*) AS days, CAST(sum(n) AS BIGINT) AS orders, round(avg(price), 3) AS price FROM x GROUP BY GROUPING SETS ((), (year), (regime), (slot))""")
def metrics_breakdown(t):
    x = daily_orders(t).withColumns({"year": F.year("day"), "regime": F.when(F.col("day") >= F.lit("1999-01-01").cast("date"), "new").otherwise("old"),
                                     "slot": F.weekday("day")})
    out = A.breakdown(x, ["year", "regime", "slot"], [F.count(F.lit(1)).alias("days"), F.sum("n").alias("orders"), F.avg("price").alias("price")])
    return rounded(out, 3)


@query("extreme_counts", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE value > 150) AS above_150, count(*) FILTER (WHERE value < 5) AS below_5, count(*) FILTER (WHERE event_type = 'error' AND value > 150) AS error_above FROM events GROUP BY 1""")
def extreme_counts(t):
    e = t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return A.extreme_counts(e, ["day"], {"above_150": F.col("value") > 150, "below_5": F.col("value") < 5,
                                         "error_above": (F.col("event_type") == "error") & (F.col("value") > 150)})


@query("family_availability", f"""WITH {FULL_HOURS}, w AS (SELECT hour, event_type, max(value) AS v FROM full_hours GROUP BY 1, 2)
SELECT date_trunc('day', hour) AS day, f.family, round(avg(CASE WHEN v IS NULL THEN 0 ELSE 1 END), 6) AS availability
FROM w JOIN (VALUES ('click', 'traffic'), ('view', 'traffic'), ('error', 'quality'), ('purchase', 'sales'), ('signup', 'sales')) f(c, family) ON c = event_type GROUP BY 1, 2""")
def family_availability(t):
    families = {"click": "traffic", "view": "traffic", "error": "quality", "purchase": "sales", "signup": "sales"}
    w = A.pivot_sum(full_hours(t), ["hour"], "event_type", "value", list(families))
    w = w.withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    return rounded(A.availability(w, families, ["day"]))


@query("flag_share_by_year", """SELECT year(l_shipdate) AS year, round(avg(CASE WHEN l_discount > 0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS flag_discount, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS flag_return FROM lineitem GROUP BY 1""")
def flag_share_by_year(t):
    li = t("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.avg((F.col("l_discount") > 0.08).cast("double")).alias("flag_discount"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("flag_return"))
    return rounded(li, 8)


@query("bucket_uniformity", """WITH b AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS period, o_orderdate AS bucket, count(DISTINCT o_orderstatus) AS nd, max(round(o_totalprice, 2)) - min(round(o_totalprice, 2)) AS spread, count(DISTINCT round(o_totalprice, 2)) AS nv FROM orders GROUP BY 1, 2, 3)
SELECT o_orderpriority, period, count(*) AS buckets, round(avg(CASE WHEN nv = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_identical, round(avg(spread), 7) AS mean_range, round(avg(CASE WHEN spread = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_zero_range FROM b GROUP BY 1, 2""")
def bucket_uniformity(t):
    out = A.bucket_uniformity(t("orders"), ["o_orderpriority"], F.col("o_orderdate"), "o_totalprice", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return rounded(rounded(out, 7, "mean_range"), 6, "share_identical", "share_zero_range")


@query("step_means", f"""WITH {HOURLY}, w AS (SELECT DISTINCT event_type, date_trunc('day', hour) + INTERVAL 3 HOUR AS s, date_trunc('day', hour) + INTERVAL 40 HOUR AS e FROM hourly)
SELECT w.event_type, w.s, w.e, round(avg(h.value), 7) AS mean FROM w LEFT JOIN hourly h ON h.event_type = w.event_type AND h.hour >= w.s AND h.hour < w.e GROUP BY 1, 2, 3""")
def step_means(t):
    h = hourly(t)
    day = F.date_trunc("day", "hour")
    w = h.select("event_type", T.plus(day, "3 hours").alias("s"), T.plus(day, "40 hours").alias("e")).distinct()
    return rounded(A.step_means(w, h, "s", "e", "hour", ["event_type"], "value", "mean", "7 days"), 7)
