"""Merging sources, finding gaps and checking tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import grid as G
from ..operators import intervals as I
from ..operators import quality as Y
from .grids import FULL_HOURS, full_hours
from .registry import DAILY_ORDERS, HOURLY, daily_orders, hourly, query, rounded


FAMILIES = {"click": ("click", "purchase"), "view": ("view", "signup"), "error": ("error",)}


def wide_hours(t):
    """Hourly means side by side: per family of event types the highest of them."""
    cols = {k: F.max(F.when(F.col("event_type").isin(*types), F.col("value"))) for k, types in FAMILIES.items()}
    return full_hours(t).groupBy("hour").agg(*[c.alias(k) for k, c in cols.items()])


WIDE = f"""{FULL_HOURS}, wide AS (SELECT hour, max(CASE WHEN event_type IN ('click', 'purchase') THEN value END) AS click, max(CASE WHEN event_type IN ('view', 'signup') THEN value END) AS view,
  max(CASE WHEN event_type = 'error' THEN value END) AS error FROM full_hours GROUP BY 1)"""


@query("source_merge", f"""WITH {WIDE}
SELECT hour, round(CASE WHEN hour >= TIMESTAMP '2024-01-15' AND view IS NOT NULL THEN view WHEN click IS NOT NULL THEN click ELSE error END, 6) AS price,
  CASE WHEN hour >= TIMESTAMP '2024-01-15' AND view IS NOT NULL THEN 'view' WHEN click IS NOT NULL THEN 'click' WHEN error IS NOT NULL THEN 'error' END AS src_price, round(click, 6) AS price_xchk_click FROM wide""")
def source_merge(t):
    out = Y.coalesce_sources(wide_hours(t), "price", [
        ("view", "view", F.col("hour") >= F.lit("2024-01-15").cast("timestamp_ntz")), ("click", "click", None), ("error", "error", None)], ["click"])
    return rounded(out.select("hour", "price", "src_price", "price_xchk_click"))


@query("copied_series", f"""WITH {WIDE}, x AS (SELECT hour, date_trunc('week', hour) AS wk, click AS a, CASE WHEN day(hour) % 14 < 7 THEN click + 0.1 ELSE view END AS b, error AS c FROM wide),
m AS (SELECT wk, coalesce(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) <= 0.5 THEN 1.0 ELSE 0.0 END END), 0) > 0.9 AS copied FROM x GROUP BY 1)
SELECT hour, copied AS flag_a_copied, round(CASE WHEN copied THEN c ELSE a END, 6) AS a FROM x JOIN m USING (wk)""")
def copied_series(t):
    x = wide_hours(t).select("hour", F.col("click").alias("a"), F.when(F.dayofmonth("hour") % 14 < 7, F.col("click") + 0.1).otherwise(F.col("view")).alias("b"),
                             F.col("error").alias("c"))
    out = Y.replace_copied(x, "a", "b", "c", F.date_trunc("week", "hour"))
    return rounded(out.select("hour", "flag_a_copied", "a"))


@query("override_revised", f"""WITH {WIDE}, x AS (SELECT hour, click AS a, CASE WHEN hour(hour) % 3 = 0 THEN view ELSE click END AS b FROM wide)
SELECT hour, CASE WHEN hour < TIMESTAMP '2024-01-20' AND abs(a - b) > 0.005 THEN 'changed' WHEN hour < TIMESTAMP '2024-01-20' AND a IS NULL AND b IS NOT NULL THEN 'filled' END AS a_change,
  round(CASE WHEN hour < TIMESTAMP '2024-01-20' AND (abs(a - b) > 0.005 OR (a IS NULL AND b IS NOT NULL)) THEN b ELSE a END, 6) AS a FROM x""")
def override_revised(t):
    x = wide_hours(t).select("hour", F.col("click").alias("a"), F.when(F.hour("hour") % 3 == 0, F.col("view")).otherwise(F.col("click")).alias("b"))
    out = Y.override(x, "a", "b", F.col("hour") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return rounded(out.select("hour", "a_change", "a"))


@query("gap_scan", """WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events), b AS (SELECT date_trunc('hour', min(ts)) - INTERVAL 3 HOUR AS a, date_trunc('hour', max(ts)) + INTERVAL 4 HOUR AS z FROM events),
l AS (SELECT user_id, h, lead(h) OVER (PARTITION BY user_id ORDER BY h) AS nxt FROM h), s AS (SELECT user_id, min(h) AS f, max(h) + INTERVAL 1 HOUR AS e FROM h GROUP BY 1)
SELECT user_id, 'gap' AS kind, h + INTERVAL 1 HOUR AS start_utc, nxt AS end_utc, CAST((epoch(nxt) - epoch(h)) / 3600 - 1 AS BIGINT) AS n_missing FROM l WHERE nxt > h + INTERVAL 1 HOUR
UNION ALL SELECT user_id, 'head', a, f, NULL FROM s, b UNION ALL SELECT user_id, 'tail', e, z, NULL FROM s, b WHERE e < z""")
def gap_scan(t):
    e = t("events")
    ends = e.agg(T.plus(T.floor_time(F.min("ts"), "1 hour"), -3 * T.HOUR).alias("a"), T.plus(T.floor_time(F.max("ts"), "1 hour"), "4 hours").alias("z"))
    bounds = ends.first()
    return Y.gap_scan(e.select("user_id", "ts"), ["user_id"], "ts", "1 hour", F.lit(bounds.a), F.lit(bounds.z), chunk="7 days")


@query("gap_scan_resolution", """WITH s AS (SELECT DISTINCT CAST(event_type = 'click' AS INTEGER) AS series, ts FROM (SELECT event_type, date_trunc('hour', ts) AS ts FROM events UNION ALL
   SELECT event_type, date_trunc('hour', ts) + k * INTERVAL 15 MINUTE FROM events, (SELECT unnest([1, 2, 3]) AS k) WHERE day(ts) % 10 > 3)),
b AS (SELECT series, min(ts) AS f, max(ts) AS l FROM s GROUP BY 1), w AS (SELECT series, unnest(generate_series(f, l, INTERVAL 15 MINUTE)) AS bucket FROM b),
x AS (SELECT w.series, w.bucket, s.ts IS NOT NULL AS have FROM w LEFT JOIN s ON s.series = w.series AND s.ts = w.bucket),
h AS (SELECT series, date_trunc('hour', bucket) AS hr, bool_or(have AND bucket = date_trunc('hour', bucket)) AND count(*) FILTER (WHERE NOT have) > 0 AS coarse FROM x GROUP BY 1, 2),
g AS (SELECT *, count(*) FILTER (WHERE NOT coarse) OVER (PARTITION BY series ORDER BY hr) AS id FROM h),
r AS (SELECT series, hr, coarse AND count(*) FILTER (WHERE coarse) OVER (PARTITION BY series, id) >= 6 AS res FROM g),
y AS (SELECT x.*, res, date_trunc('hour', bucket) AS hr, CASE WHEN NOT have AND NOT res THEN 'gap' WHEN NOT have THEN 'resolution' END AS kind FROM x JOIN r ON r.series = x.series AND r.hr = date_trunc('hour', x.bucket)),
gr AS (SELECT series, bucket, CAST(epoch(bucket) / 900 AS BIGINT) - row_number() OVER (PARTITION BY series ORDER BY bucket) AS id FROM y WHERE kind = 'gap'),
rh AS (SELECT series, hr, min(bucket) AS a, max(bucket) AS z, count(*) AS k, CAST(epoch(hr) / 3600 AS BIGINT) - row_number() OVER (PARTITION BY series ORDER BY hr) AS id FROM y WHERE kind = 'resolution' GROUP BY 1, 2)
SELECT series, 'gap' AS kind, min(bucket) AS start_utc, max(bucket) + INTERVAL 15 MINUTE AS end_utc, count(*)::BIGINT AS n_missing FROM gr GROUP BY series, id
UNION ALL SELECT series, 'resolution', min(a), max(z) + INTERVAL 15 MINUTE, sum(k)::BIGINT FROM rh GROUP BY series, id
UNION ALL SELECT series, 'head', TIMESTAMP '1900-01-01', f, NULL FROM b UNION ALL SELECT series, 'tail', l + INTERVAL 15 MINUTE, TIMESTAMP '2100-01-01', NULL FROM b""")
def gap_scan_resolution(t):
    hour = T.floor_time("ts", "1 hour")
    e = t("events").select((F.col("event_type") == "click").cast("int").alias("series"), hour.alias("ts"), F.dayofmonth("ts").alias("d"))
    offsets = F.when(F.col("d") % 10 > 3, F.array(*[F.lit(k) for k in range(4)])).otherwise(F.array(F.lit(0)))
    q = e.withColumn("k", F.explode(offsets)).select("series", T.plus("ts", F.col("k").cast("long") * 15 * T.MICROS["minute"]).alias("ts")).distinct()
    low, high = F.lit("1900-01-01").cast("timestamp_ntz"), F.lit("2100-01-01").cast("timestamp_ntz")
    return Y.gap_scan(q, ["series"], "ts", "15 minutes", low, high, resolution_hours=6, chunk="7 days")


@query("interval_gaps", """WITH iv AS (SELECT l_suppkey, l_shipdate AS s, min(l_shipdate + l_linenumber * INTERVAL 1 DAY) AS e FROM lineitem GROUP BY 1, 2), l AS (SELECT *, lag(e) OVER (PARTITION BY l_suppkey ORDER BY s) AS p FROM iv)
SELECT l_suppkey, p AS gap_start, s AS gap_end, round((epoch(s) - epoch(p)) / 3600, 4)::DOUBLE AS hours FROM l WHERE s > p""")
def interval_gaps(t):
    iv = t("lineitem").select("l_suppkey", F.col("l_shipdate").alias("s"), T.plus("l_shipdate", F.col("l_linenumber").cast("long") * T.DAY).alias("e"))
    return rounded(I.interval_gaps(iv, ["l_suppkey"], "s", "e", "365 days"), 4)


@query("overlap_check", """WITH iv AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate AS s, l_shipdate + l_linenumber * INTERVAL 1 DAY AS e FROM lineitem),
l AS (SELECT *, lead(s) OVER (PARTITION BY l_suppkey ORDER BY s, l_orderkey, l_linenumber, l_partkey) AS n FROM iv) SELECT l_suppkey, count(*) AS n_overlaps FROM l WHERE n < e GROUP BY 1""")
def overlap_check(t):
    iv = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("s"),
                              T.plus("l_shipdate", F.col("l_linenumber").cast("long") * T.DAY).alias("e"))
    return I.overlaps(iv, ["l_suppkey"], "s", "e", ["l_orderkey", "l_linenumber", "l_partkey"], "365 days").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_overlaps"))


@query("missing_by_day", f"""WITH {FULL_HOURS}, x AS (SELECT event_type, date_trunc('day', timezone('Europe/Zurich', timezone('UTC', hour))) AS day, n FROM full_hours)
SELECT event_type, day, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) AS expected, count(*) FILTER (WHERE n IS NULL) = count(*) AS full_day, false AS switch_day FROM x GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n IS NULL) > 0""")
def missing_by_day(t):
    h = hourly(t)
    return Y.missing_by_day(G.span_grid(h, "hour", "1 hour", ["event_type"]), h, ["event_type"], "hour", "Europe/Zurich")


@query("null_share", f"""WITH {WIDE}, u AS (SELECT hour, 'click' AS "column", click AS v FROM wide UNION ALL SELECT hour, 'view', view FROM wide UNION ALL SELECT hour, 'error', error FROM wide)
SELECT date_trunc('day', hour) AS day, "column", round(avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS null_share FROM u GROUP BY 1, 2""")
def null_share(t):
    w = wide_hours(t).withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    return rounded(Y.null_share(w, ["click", "view", "error"], ["day"]))


@query("live_completeness", """WITH x AS (SELECT o_orderdate AS ts, CASE WHEN o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderkey % 10 <> 0 THEN o_totalprice END AS late, CASE WHEN o_orderdate < TIMESTAMP '1999-06-01' THEN o_totalprice END AS early FROM orders),
u AS (SELECT ts, 'late' AS "column", late AS v FROM x UNION ALL SELECT ts, 'early', early FROM x), s AS (SELECT "column", year(min(ts) FILTER (WHERE v IS NOT NULL)) AS y0, year(max(ts) FILTER (WHERE v IS NOT NULL)) AS y1 FROM u GROUP BY 1)
SELECT u."column", year(ts) AS year, round(avg(CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 8) AS complete FROM u JOIN s ON s."column" = u."column" WHERE year(ts) > y0 AND year(ts) < y1 GROUP BY 1, 2""")
def live_completeness(t):
    d, p = F.col("o_orderdate"), F.col("o_totalprice")
    x = t("orders").select(d.alias("ts"), F.when((d >= F.lit("1996-06-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 10 != 0), p).alias("late"),
                           F.when(d < F.lit("1999-06-01").cast("timestamp_ntz"), p).alias("early"))
    return rounded(Y.live_completeness(x, ["late", "early"], "ts"), 8)


@query("coverage_summary", f"""WITH {WIDE}, d AS (SELECT date_trunc('day', hour) AS day, count(click) / count(*) AS click, count(view) / count(*) AS view FROM wide GROUP BY 1), u AS (SELECT 'click' AS "column", click AS c FROM d UNION ALL SELECT 'view', view FROM d)
SELECT "column", round(avg(CASE WHEN c >= 0.999 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS complete, round(avg(CASE WHEN c = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS empty, round(avg(c), 6)::DOUBLE AS mean FROM u GROUP BY 1""")
def coverage_summary(t):
    d = wide_hours(t).groupBy(F.date_trunc("day", "hour").alias("day")).agg(
        (F.count("click") / F.count(F.lit(1))).alias("click"), (F.count("view") / F.count(F.lit(1))).alias("view"))
    return rounded(Y.coverage_summary(d, ["click", "view"]))


@query("agreement", f"""WITH {WIDE}, x AS (SELECT date_trunc('week', hour) AS week, CAST(hour AS DATE) AS day, click AS a, view AS b FROM wide WHERE click IS NOT NULL AND view IS NOT NULL)
SELECT week, count(*) AS n, round(avg(CASE WHEN abs(a - b) <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_equal, round(max(abs(a - b)), 6) AS max_diff, round(avg(abs(a - b)), 6) AS mean_abs_diff, round(avg(b - a), 6) AS bias,
  round(corr(a, b), 6) AS corr, round(avg(b) / avg(a), 6) AS ratio, count(DISTINCT CASE WHEN abs(a - b) > 10 THEN day END) AS days_different FROM x GROUP BY 1""")
def agreement(t):
    x = wide_hours(t).withColumn("week", F.date_trunc("week", "hour").cast("timestamp_ntz"))
    return rounded(Y.agreement(x, "click", "view", 10.0, ["week"], F.col("hour").cast("date")))


_LAG_SQL = f"""WITH {HOURLY}, a AS (SELECT event_type, hour, total AS v FROM hourly), b AS (SELECT event_type, hour + INTERVAL 2 HOUR AS hour, total + n AS v FROM hourly),
ca AS (SELECT x.event_type, x.hour, x.v, x.v - y.v AS d FROM a x LEFT JOIN a y ON y.event_type = x.event_type AND y.hour = x.hour - INTERVAL 1 HOUR), cb AS (SELECT x.event_type, x.hour, x.v, x.v - y.v AS d FROM b x LEFT JOIN b y ON y.event_type = x.event_type AND y.hour = x.hour - INTERVAL 1 HOUR),
l AS (SELECT unnest(generate_series(-4, 4)) AS lag), p AS (SELECT ca.event_type, date_trunc('week', ca.hour) AS period, lag, ca.v AS va, cb.v AS vb, ca.d AS da, cb.d AS db FROM ca, l, cb WHERE cb.event_type = ca.event_type AND cb.hour = ca.hour + lag * INTERVAL 1 HOUR),
s AS (SELECT event_type, period, lag, count(*) FILTER (WHERE da IS NOT NULL AND db IS NOT NULL) AS n, corr(da, db) AS c, avg(abs(va - vb)) AS mae FROM p GROUP BY 1, 2, 3)
SELECT event_type, period, arg_max(lag, (round(c, 9), -lag)) AS best_lag, round(max(c), 6) AS corr_best, round(arg_max(mae, (round(c, 9), -lag)), 6) AS mae_best, round(max(CASE WHEN lag = 0 THEN c END), 6) AS corr_lag0 FROM s WHERE n >= 3 AND c IS NOT NULL AND NOT isnan(c) GROUP BY 1, 2"""


@query("best_lag", _LAG_SQL)
def best_lag(t):
    a = hourly(t).select("event_type", "hour", F.col("total").alias("v"), "n")
    b = a.select("event_type", T.plus("hour", "2 hours").alias("hour"), (F.col("v") + F.col("n")).alias("v"))
    out = Y.best_lag(a, b, "hour", "v", list(range(-4, 5)), "1 hour", ["event_type"], F.date_trunc("week", "hour").cast("timestamp_ntz"), min_n=3)
    return rounded(out.withColumn("best_lag", F.col("best_lag").cast("long")))


@query("splice_report", f"""WITH {HOURLY}, k AS (SELECT unnest(['click', 'view', 'error', 'purchase']) AS k, unnest(['view', 'error', 'purchase', 'signup']) AS l), a AS (SELECT k, hourly.* FROM hourly JOIN k ON event_type = k), b AS (SELECT k, hourly.* FROM hourly JOIN k ON event_type = l),
c AS (SELECT k, a.hour, 'value' AS feature, a.value AS x, b.value AS y FROM a JOIN b USING (k, hour) UNION ALL SELECT k, a.hour, 'n', a.n, b.n FROM a JOIN b USING (k, hour))
SELECT feature, k || ' ' || CAST(date_trunc('week', hour) AS DATE) AS period, count(*) AS n, round(corr(x, y), 6) AS corr, round(avg(y) / avg(x) - 1, 6) AS relative_level FROM c GROUP BY 1, 2""")
def splice_report(t):
    """Each event type spliced to the next one."""
    kinds = ["click", "view", "error", "purchase", "signup"]
    after = F.create_map(*[F.lit(x) for pair in zip(kinds[1:], kinds) for x in pair])
    h = hourly(t).select("event_type", "hour", "value", "n")
    a = h.where(F.col("event_type") != "signup").withColumnRenamed("event_type", "k")
    b = h.select(F.get(F.array(after[F.col("event_type")]), F.lit(0)).alias("k"), "hour", "value", "n").where("k is not null")
    period = F.concat_ws(" ", "k", F.date_trunc("week", "hour").cast("date").cast("string"))
    return rounded(Y.splice_report(a, b, ["k", "hour"], ["value", "n"], period))


@query("conflicting_copies", """SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT (l_quantity, l_discount)) AS variants FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def conflicting_copies(t):
    return Y.conflicts(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity", "l_discount")


@query("validation_report", """SELECT 'quantity positive' AS "check", count(*) FILTER (WHERE l_quantity <= 0) = 0 AS passed FROM lineitem UNION ALL SELECT 'discount below 5%', count(*) FILTER (WHERE l_discount >= 0.05) = 0 FROM lineitem
UNION ALL SELECT 'all flags seen', count(DISTINCT l_returnflag) = 3 FROM lineitem UNION ALL SELECT 'price per unit in range', count(*) FILTER (WHERE l_extendedprice / l_quantity > 1000000) = 0 FROM lineitem""")
def validation_report(t):
    e = (Y.Expectations().never("quantity positive", F.col("l_quantity") <= 0).never("discount below 5%", F.col("l_discount") >= 0.05)
         .holds("all flags seen", F.count_distinct("l_returnflag") == 3).never("price per unit in range", F.col("l_extendedprice") / F.col("l_quantity") > 1000000))
    return e.report(t("lineitem"))


@query("conservation_check", """SELECT 'offered' AS "column", CAST(sum(l_quantity) AS DOUBLE) AS before, CAST(sum(l_quantity) AS DOUBLE) AS after, true AS conserved FROM lineitem
UNION ALL SELECT 'first_only', CAST(sum(l_quantity) AS DOUBLE), (SELECT CAST(sum(m) AS DOUBLE) FROM (SELECT max(l_quantity) AS m FROM lineitem GROUP BY l_orderkey)), false FROM lineitem""")
def conservation_check(t):
    li = t("lineitem").withColumns({"offered": F.col("l_quantity"), "first_only": F.col("l_quantity")})
    per = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"), F.max("l_quantity").alias("m"))
    return Y.conserved(li, per, {"offered": "s", "first_only": "m"})


@query("spot_check", f"""WITH {DAILY_ORDERS}, s AS (SELECT priority, day FROM daily ORDER BY md5('3|' || priority || '|' || day), priority, day LIMIT 200) SELECT priority, day FROM s WHERE day(day) = 7""")
def spot_check(t):
    """The recomputation is off by a hair on the seventh of each month: exactly those of the sampled keys come back."""
    brute = t("orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 1083.7).alias("price"))
    brute = brute.withColumn("price", F.col("price") + F.when(F.dayofmonth("day") == 7, 0.001).otherwise(0.0))
    return Y.spot_check(daily_orders(t), brute, ["priority", "day"], ["price"], n=200, seed=3).select("priority", "day")


@query("largest_gaps", """WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events), l AS (SELECT user_id, h, lead(h) OVER (PARTITION BY user_id ORDER BY h) AS nxt FROM h)
SELECT user_id, h AS gap_after, CAST((epoch(nxt) - epoch(h)) / 3600 AS BIGINT) AS hours FROM l WHERE nxt IS NOT NULL ORDER BY 3 DESC, 1, 2 LIMIT 15""")
def largest_gaps(t):
    from ..operators.ordered import following

    h = t("events").select("user_id", T.floor_time("ts", "1 hour").alias("gap_after")).distinct()
    h = following(h, ["user_id"], "gap_after", {"nxt": "gap_after"}, chunk="7 days").where(F.col("nxt").isNotNull())
    h = h.select("user_id", "gap_after", T.floor_div(T.micros("nxt") - T.micros("gap_after"), T.HOUR).alias("hours"))
    return h.orderBy(F.col("hours").desc(), "user_id", "gap_after").limit(15)
