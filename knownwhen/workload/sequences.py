"""Runs, thresholds, moving windows, clusters, ranks and decay on ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T

from ..operators import ordered as O
from ..operators import ranks as R
from ..operators import sequences as Q
from ..operators import shaping as S
from .grids import FULL_HOURS, full_hours
from .registry import DAILY_ORDERS, HOURLY, RATE, daily_orders, hourly, query, rounded

_RUNS = f"""{FULL_HOURS}, f AS (SELECT *, coalesce({{pred}}, false) AS onx FROM full_hours),
s AS (SELECT *, CASE WHEN onx AND NOT coalesce(lag(onx) OVER (PARTITION BY event_type ORDER BY hour), false) THEN 1 ELSE 0 END AS st FROM f),
r AS (SELECT *, sum(st) OVER (PARTITION BY event_type ORDER BY hour) AS id FROM s)"""


@query("episodes", f"""WITH {_RUNS.format(pred='value > 55')}
SELECT event_type, min(hour) AS start, max(hour) AS "end", count(*) AS length, round(max(value), 6) AS peak, round(avg(value - 55), 6) AS mean_excess FROM r WHERE onx GROUP BY event_type, id""")
def episodes(t):
    out = Q.episodes(full_hours(t), ["event_type"], "hour", F.col("value") > 55,
                     [F.max("value").alias("peak"), F.avg(F.col("value") - 55).alias("mean_excess")], "7 days")
    return rounded(out)


@query("episode_labels", f"""WITH {_RUNS.format(pred='value > 55')}
SELECT event_type, hour, CASE WHEN onx THEN min(hour) OVER w END AS episode_start, CASE WHEN onx THEN count(*) OVER w END AS episode_length, st = 1 AS is_start
FROM r WINDOW w AS (PARTITION BY event_type, id, onx)""")
def episode_labels(t):
    out = Q.label_episodes(full_hours(t), ["event_type"], "hour", F.col("value") > 55, "7 days")
    return out.select("event_type", "hour", "episode_start", "episode_length", "is_start")


@query("episode_catalogue", f"""WITH {_RUNS.format(pred='value > 55')}, e AS (SELECT event_type, min(hour) AS start, count(*) AS length FROM r WHERE onx GROUP BY event_type, id)
SELECT event_type, CAST(isodow(start) - 1 AS BIGINT) AS dow, count(*) AS episodes, max(length) AS longest, quantile_cont(length, 0.5)::DOUBLE AS median_length FROM e GROUP BY 1, 2""")
def episode_catalogue(t):
    e = Q.episodes(full_hours(t), ["event_type"], "hour", F.col("value") > 55, chunk="7 days")
    return Q.episode_catalogue(e.withColumn("dow", F.weekday("start").cast("long")), ["event_type", "dow"])


@query("null_runs", f"""WITH {_RUNS.format(pred='value IS NULL')}, b AS (SELECT event_type, min(hour) AS a, max(hour) AS z FROM hourly GROUP BY 1)
SELECT event_type, min(hour) AS start, max(hour) AS "end", count(*) AS length FROM r JOIN b USING (event_type) WHERE onx AND hour > a AND hour < z GROUP BY event_type, id HAVING count(*) >= 2""")
def null_runs(t):
    return Q.null_runs(full_hours(t), ["event_type"], "hour", "value", 2, "7 days")


@query("interpolate_bounded", f"""WITH {FULL_HOURS},
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER lo AS lt, last_value(value IGNORE NULLS) OVER lo AS lv,
  first_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER hi AS nt, first_value(value IGNORE NULLS) OVER hi AS nv FROM full_hours
  WINDOW lo AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, coalesce(value IS NULL AND nt - lt - INTERVAL 1 HOUR <= INTERVAL 2 HOUR, false) AS fill FROM k)
SELECT event_type, hour, round(CASE WHEN fill THEN lv + (nv - lv) * (epoch(hour) - epoch(lt)) / (epoch(nt) - epoch(lt)) ELSE value END, 6) AS value, fill AS value_imputed FROM f""")
def interpolate_bounded(t):
    h = full_hours(t).select("event_type", "hour", "value")
    return rounded(Q.interpolate(h, ["event_type"], "hour", T.plus("hour", "1 hour"), ["value"], "2 hours"))


@query("rolling_threshold", f"""WITH {HOURLY}, h AS (SELECT *, CAST(hour AS DATE) AS day FROM hourly), d AS (SELECT DISTINCT event_type, day FROM h)
SELECT d.event_type, d.day, CASE WHEN count(h.value) >= 40 THEN round(quantile_cont(h.value, 0.9), 6) END AS q90, CASE WHEN count(h.value) >= 40 THEN round(quantile_cont(h.value, 0.1), 6) END AS q10, count(h.value) AS n_past
FROM d LEFT JOIN h ON h.event_type = d.event_type AND h.day < d.day AND h.day >= d.day - INTERVAL 10 DAY GROUP BY 1, 2""")
def rolling_threshold(t):
    h = hourly(t).withColumn("day", F.col("hour").cast("date"))
    return rounded(Q.rolling_thresholds(h, ["event_type"], "day", "value", {"q90": 0.9, "q10": 0.1}, 10, 40))


_MAD = f"""{HOURLY}, h AS (SELECT *, CAST(hour AS DATE) AS day FROM hourly), d AS (SELECT DISTINCT event_type, day FROM h),
m AS (SELECT d.event_type, d.day, CASE WHEN count(h.value) >= 40 THEN quantile_cont(h.value, 0.5) END AS median FROM d LEFT JOIN h ON h.event_type = d.event_type AND h.day < d.day AND h.day >= d.day - INTERVAL 10 DAY GROUP BY 1, 2),
r AS (SELECT m.event_type, m.day, m.median, CASE WHEN m.median IS NOT NULL THEN 1.4826 * quantile_cont(abs(h.value - m.median), 0.5) END AS mad
  FROM m LEFT JOIN h ON h.event_type = m.event_type AND h.day < m.day AND h.day >= m.day - INTERVAL 10 DAY GROUP BY 1, 2, 3)"""


@query("robust_z", f"""WITH {_MAD}
SELECT h.event_type, h.hour, round((h.value - r.median) / greatest(r.mad, 5), 5) AS z, CASE WHEN r.median IS NULL THEN NULL WHEN (h.value - r.median) / greatest(r.mad, 5) > 1.5 THEN 1 ELSE 0 END AS spike
FROM h JOIN r ON r.event_type = h.event_type AND r.day = h.day""")
def robust_z(t):
    h = hourly(t).withColumn("day", F.col("hour").cast("date"))
    z = (F.col("value") - F.col("median")) / F.greatest("mad", F.lit(5.0))
    out = h.join(Q.robust_stats(h, ["event_type"], "day", "value", 10, 40), ["event_type", "day"])
    out = out.withColumn("z", F.round(z, 5))
    return out.select("event_type", "hour", "z", F.when(F.col("median").isNotNull(), (z > 1.5).cast("int")).alias("spike"))


@query("spike_labels", f"""WITH {FULL_HOURS}, x AS (SELECT *, CASE WHEN hour(hour) % 5 = 0 THEN NULL ELSE n - 3 END AS imbalance, day(hour) > 15 AS single FROM full_hours)
SELECT event_type, hour, CASE WHEN value IS NULL OR (single AND imbalance IS NULL) THEN NULL WHEN single AND NOT sign(imbalance) = -1 THEN 0 WHEN value > 60 THEN 1 ELSE 0 END AS short,
  CASE WHEN value IS NULL OR (single AND imbalance IS NULL) THEN NULL WHEN single AND NOT sign(imbalance) = 1 THEN 0 WHEN value < 30 THEN 1 ELSE 0 END AS long FROM x""")
def spike_labels(t):
    x = full_hours(t).withColumns({"imbalance": F.when(F.hour("hour") % 5 != 0, F.col("n") - 3), "single": F.dayofmonth("hour") > 15})
    return x.select("event_type", "hour", Q.spikes(x, "value", F.lit(60.0), True, F.col("single"), "imbalance").alias("short"),
                    Q.spikes(x, "value", F.lit(30.0), False, F.col("single"), "imbalance").alias("long"))


@query("climatology", f"""WITH {FULL_HOURS}, x AS (SELECT event_type, hour, CAST(hour(hour) AS BIGINT) AS cell, CASE WHEN value > 55 THEN 1.0::DOUBLE WHEN value IS NOT NULL THEN 0.0::DOUBLE END AS y FROM full_hours),
c AS (SELECT *, avg(y) OVER p AS prior, avg(y) OVER (PARTITION BY event_type) AS overall, avg(y) OVER e AS ex, CASE WHEN count(y) OVER r >= 3 THEN avg(y) OVER r END AS ro FROM x
  WINDOW p AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY event_type, cell ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY event_type, cell ORDER BY hour ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT event_type, hour, round(least(greatest(coalesce(ex, prior, overall), 0.0001), 0.9999), 6) AS clim_expanding, round(least(greatest(coalesce(ro, ex, prior, overall), 0.0001), 0.9999), 6) AS clim_rolling FROM c""")
def climatology(t):
    x = full_hours(t).withColumns({"cell": F.hour("hour"), "y": F.when(F.col("value").isNotNull(), (F.col("value") > 55).cast("double"))})
    out = Q.climatology(x, ["cell"], "hour", "y", 7, 3, ["event_type"])
    return rounded(out.select("event_type", "hour", "clim_expanding", "clim_rolling"))


@query("decumulate", f"""WITH {FULL_HOURS}, c AS (SELECT event_type, hour, date_trunc('week', hour) AS week, CASE WHEN hour(hour) % 7 <> 3 THEN CAST(sum(n) OVER (PARTITION BY event_type, date_trunc('week', hour) ORDER BY hour) AS DOUBLE) END AS counter FROM full_hours),
l AS (SELECT *, coalesce(last_value(counter IGNORE NULLS) OVER (PARTITION BY event_type, week ORDER BY hour), 0) AS level FROM c)
SELECT event_type, hour, level - coalesce(lag(level) OVER (PARTITION BY event_type, week ORDER BY hour), 0) AS increment FROM l""")
def decumulate(t):
    week = F.date_trunc("week", "hour").cast("timestamp_ntz")
    c = full_hours(t).withColumn("week", week)
    c = O.running(c, ["event_type", "week"], "hour", {"s": F.col("n")}, chunk="7 days")
    c = c.withColumn("counter", F.when((F.hour("hour") % 7 != 3), F.col("s").cast("double")))
    out = Q.decumulate(c, ["event_type"], "hour", "counter", F.col("week"), "increment", "7 days")
    return out.select("event_type", "hour", "increment")


@query("decluster", f"""WITH {FULL_HOURS}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS pos FROM full_hours),
e AS (SELECT *, value - 60 AS excess, CASE WHEN pos - lag(pos) OVER (PARTITION BY event_type ORDER BY hour) <= 4 THEN 0 ELSE 1 END AS fresh FROM i WHERE value > 60),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY hour) AS id FROM e)
SELECT event_type, min(hour) AS start, max(hour) AS "end", count(*) AS n_exceed, round(max(excess), 6) AS excess, 60.0::DOUBLE AS threshold, round(max(value), 6) AS peak FROM c GROUP BY event_type, id""")
def decluster(t):
    return rounded(Q.decluster(full_hours(t), ["event_type"], "hour", "value", F.lit(60.0), 4))


@query("rolling_rows", f"""WITH {DAILY_ORDERS}
SELECT priority, day, round(CASE WHEN count(price) OVER a >= 3 THEN avg(price) OVER a END, 4) AS trailing_mean, round(CASE WHEN count(price) OVER a >= 3 THEN quantile_cont(price, 0.5) OVER a END, 4) AS trailing_median,
  round(CASE WHEN count(price) OVER c >= 4 THEN avg(price) OVER c END, 4) AS centred_mean FROM daily
WINDOW a AS (PARTITION BY priority ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), c AS (PARTITION BY priority ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling_rows(t):
    d = daily_orders(t).select("priority", "day", "price")
    p = F.col("price")
    out = O.rolling_rows(d, ["priority"], "day", {"trailing_mean": F.avg(p), "trailing_median": F.percentile(p, F.lit(0.5))}, 7, p, 3, chunk="365 days")
    out = O.rolling_rows(out, ["priority"], "day", {"centred_mean": F.avg(p)}, 7, p, 4, center=True, chunk="365 days")
    return rounded(out.drop("price"), 4)


@query("rolling_range", f"""WITH {DAILY_ORDERS}
SELECT priority, day, round(avg(price) OVER a, 4) AS mean_7d, round(quantile_cont(price, 0.5) OVER b, 4) AS median_30d, count(*) OVER b AS n_30d FROM daily
WINDOW a AS (PARTITION BY priority ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY priority ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""")
def rolling_range(t):
    d = daily_orders(t).select("priority", "day", "price")
    p = F.col("price")
    out = O.rolling_time(d, ["priority"], "day", {"mean_7d": F.avg(p)}, 6)
    out = O.rolling_time(out, ["priority"], "day", {"median_30d": F.percentile(p, F.lit(0.5)), "n_30d": F.count(F.lit(1))}, 29)
    return rounded(out.drop("price"), 4)


@query("ramps", f"""WITH {DAILY_ORDERS} SELECT priority, day, round(price - lag(price) OVER w, 6) AS price__diff, n - lag(n) OVER w AS n__diff FROM daily WINDOW w AS (PARTITION BY priority ORDER BY day)""")
def ramps(t):
    out = S.changes(daily_orders(t), ["priority"], "day", ["price", "n"], "365 days")
    return rounded(out.select("priority", "day", "price__diff", "n__diff"))


@query("prefix_index", """SELECT user_id, event_id, row_number() OVER w AS i, round(sum(value) OVER w, 4) AS running_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def prefix_index(t):
    out = O.running(t("events"), ["user_id"], "ts", {"i": F.lit(1).cast("long"), "running_value": F.col("value").cast("decimal(18,2)")}, ["event_id"], "6 hours")
    return rounded(out.select("user_id", "event_id", "i", F.col("running_value").cast("double").alias("running_value")), 4)


@query("decay_state", f"""WITH {FULL_HOURS}, x AS (SELECT event_type, hour, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i, CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END AS e FROM full_hours)
SELECT a.event_type, a.hour, round(coalesce(sum(b.e * pow(0.5::DOUBLE, (a.i - 1 - b.i) / 6.0::DOUBLE)), 0), 6) AS state FROM x a LEFT JOIN x b ON b.event_type = a.event_type AND b.i < a.i GROUP BY 1, 2""")
def decay_state(t):
    x = full_hours(t).withColumn("spike", (F.coalesce(F.col("value"), F.lit(0.0)) > 60).cast("double"))
    out = Q.decay_state(x, ["event_type"], "hour", "spike", 6.0, chunk=48, rows_chunk="7 days")
    return rounded(out.select("event_type", "hour", "state"))


@query("acf", f"""WITH {DAILY_ORDERS}, i AS (SELECT priority, day, price - avg(price) OVER (PARTITION BY priority) AS x, row_number() OVER (PARTITION BY priority ORDER BY day) AS i FROM daily), l AS (SELECT unnest([1, 2, 7, 14]) AS lag)
SELECT a.priority, l.lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM i v WHERE v.priority = a.priority), 6) AS acf FROM i a CROSS JOIN l JOIN i b ON b.priority = a.priority AND b.i = a.i - l.lag GROUP BY 1, 2""")
def acf(t):
    return rounded(Q.acf(daily_orders(t), ["priority"], "day", "price", [1, 2, 7, 14], "365 days"))


@query("break_dates", """WITH r AS (SELECT c_mktsegment AS series, o_orderdate AS day, max(o_orderstatus) AS status, CASE WHEN year(o_orderdate) >= 1998 THEN 'new' ELSE 'old' END AS regime FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
u AS (SELECT series, day, 'status' AS flag, status AS label FROM r UNION ALL SELECT series, day, 'regime', regime FROM r),
l AS (SELECT *, lag(label) OVER (PARTITION BY series, flag ORDER BY day) AS before FROM u)
SELECT series, flag, day AS break_at, before, label AS after FROM l WHERE label <> before""")
def break_dates(t):
    r = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("c_mktsegment").alias("series"), F.col("o_orderdate").alias("day")).agg(F.max("o_orderstatus").alias("status"))
    r = r.withColumn("regime", F.when(F.year("day") >= 1998, "new").otherwise("old"))
    return Q.break_dates(r, ["series"], "day", ["status", "regime"])


# ---------------------------------------------------------------- ranks and bins
@query("equal_bins", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CAST(greatest(0, ceil((rn - 1) * 10 / (n - 1)) - 1) AS BIGINT) AS bin FROM r""")
def equal_bins(t):
    return R.equal_bins(t("events"), ["event_type"], "value", "event_id", 10).select("event_id", "bin")


@query("average_ranks", """WITH r AS (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rk, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS c FROM lineitem)
SELECT l_returnflag, l_quantity, count(*) AS n, (max(rk) + (max(c) - 1) / 2)::DOUBLE AS rank FROM r GROUP BY 1, 2""")
def average_ranks(t):
    out = R.average_ranks(t("lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], {"l_quantity": "rank"})
    return out.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))


@query("within_demean", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round((l_quantity - avg(l_quantity) OVER w) / 1.0837::DOUBLE, 6) AS l_quantity__w, round((l_discount - avg(l_discount) OVER w) / 1.0837::DOUBLE, 6) AS l_discount__w FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def within_demean(t):
    out = S.within(t("lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"])
    out = out.withColumns({c: F.col(c) / RATE for c in ("l_quantity__w", "l_discount__w")})
    return rounded(out, 6, "l_quantity__w", "l_discount__w").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity__w", "l_discount__w")


@query("dense_labels", """WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k FROM d)
SELECT o_custkey, o_orderpriority, k FROM r""")
def dense_labels(t):
    out = S.dense_rank_of(t("orders").select("o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", "k")
    return out.select("o_custkey", "o_orderpriority", F.col("k").cast("long").alias("k")).distinct()


@query("top_k_per_group", """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 5""")
def top_k_per_group(t):
    li = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = R.pick_top(li, ["l_suppkey"], 5, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("stable_sort_top", """SELECT o_orderpriority, o_orderdate, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""")
def stable_sort_top(t):
    """Every order with its place in the sorted table."""
    rows = t("orders").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.row_rank(rows, [], "o_totalprice", "o_orderkey", "position", descending=True)


@query("sample_groups", """SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('7|' || o_custkey), o_custkey LIMIT 20) GROUP BY 1""")
def sample_groups(t):
    from ..operators.quality import sample_groups as sample

    return sample(t("orders"), ["o_custkey"], 20, 7).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("source_rank_merge", """WITH p AS (SELECT date_trunc('hour', ts) AS hour, event_type AS source, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value, count(*) / 20.0 AS coverage FROM events GROUP BY 1, 2),
r AS (SELECT *, 10 * CASE WHEN coverage < 0.2 THEN 1 ELSE 0 END + CASE source WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS rk FROM p)
SELECT hour, min_by(source, rk) AS source, min_by(n, rk) AS n, round(min_by(value, rk), 4) AS value FROM r GROUP BY 1""")
def source_rank_merge(t):
    from ..operators.quality import merge_sources
    from .registry import exact_sum

    e = t("events").groupBy(T.floor_time("ts", "1 hour").alias("hour"), F.col("event_type").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum("value").alias("value")).withColumn("coverage", F.col("n") / 20.0)
    parts = {k: e.where(F.col("source") == k).drop("source") for k in ("click", "view", "error", "purchase", "signup")}
    return rounded(merge_sources(parts, ["hour"], "coverage", 0.2).select("hour", "source", "n", "value"), 4)
