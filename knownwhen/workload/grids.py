"""Grids, resampling, step functions and the local clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import timeaxis as T
from ..operators import grid as G
from ..operators import intervals as I
from ..session import cut_lineage
from .registry import DAILY_ORDERS, HOURLY, RATE, daily_orders, hourly, query, rounded

ZURICH = "Europe/Zurich"

SQL_GRID = """bounds AS (SELECT min(hour) AS a, max(hour) AS b FROM hourly),
grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour
         FROM (SELECT DISTINCT event_type FROM hourly), bounds)"""


def full_hours(t):
    """hourly() on its complete grid, written once because its users scan it several times."""
    h = hourly(t)
    return cut_lineage(G.on_grid(h, G.span_grid(h, "hour", "1 hour", ["event_type"]), ["event_type", "hour"]))


FULL_HOURS = f"""{HOURLY}, {SQL_GRID},
full_hours AS (SELECT g.event_type, g.hour, h.n, h.value, h.total
               FROM grid g LEFT JOIN hourly h ON h.event_type = g.event_type AND h.hour = g.hour)"""


@query("grid_reindex", f"""WITH {FULL_HOURS}
SELECT event_type, hour, n, round(value, 6) AS value, n IS NULL AS missing FROM full_hours""")
def grid_reindex(t):
    out = full_hours(t).select("event_type", "hour", "n", "value", F.col("n").isNull().alias("missing"))
    return rounded(out)


def _upsampled(t, how):
    day = T.floor_time("ts", "1 day").alias("ts")
    daily = t("events").groupBy("user_id", "event_type", day).agg(F.sum("value").alias("value"))
    return rounded(G.upsample(daily, ["user_id", "event_type"], "ts", ["value"], "4 hours", how, cap="1 day"))


_UPSAMPLE = """WITH daily AS (SELECT user_id, event_type, date_trunc('day', ts) AS ts, sum(value) AS value
  FROM events GROUP BY 1, 2, 3),
steps AS (SELECT unnest(generate_series(0, 5)) AS k)
SELECT user_id, event_type, ts + k * INTERVAL 4 HOUR AS ts, round({value}, 6) AS value FROM daily, steps"""


@query("upsample_repeat", _UPSAMPLE.format(value="value"))
def upsample_repeat(t):
    return _upsampled(t, "repeat")


@query("upsample_split", _UPSAMPLE.format(value="value / 6"))
def upsample_split(t):
    return _upsampled(t, "split")


@query("upsample_mixed_steps", """WITH q AS (
  SELECT DISTINCT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM q),
s AS (SELECT *, greatest(1, CAST(round(least(coalesce(epoch(nxt) - epoch(ts), 3600), 3600) / 900) AS BIGINT)) AS steps FROM n)
SELECT user_id, ts + k * INTERVAL 15 MINUTE AS ts, round(8.0 / steps, 6)::DOUBLE AS value
FROM (SELECT *, unnest(generate_series(0, steps - 1)) AS k FROM s)""")
def upsample_mixed_steps(t):
    q = t("events").select("user_id", T.floor_time("ts", "15 minutes").alias("ts")).distinct()
    return rounded(G.upsample(q.withColumn("value", F.lit(8.0)), ["user_id"], "ts", ["value"], "15 minutes", "split"))


@query("blocks_to_grid", """SELECT o_orderkey, o_totalprice AS level,
  unnest(generate_series(o_orderdate, o_orderdate + (o_orderkey % 5) * INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day
FROM orders""")
def blocks_to_grid(t):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("level"), F.col("o_orderdate").alias("start"),
                           T.plus("o_orderdate", (F.col("o_orderkey") % 5 + 1) * T.DAY).alias("stop"))
    return G.blocks_to_grid(o, "start", "stop", ["level"], "1 day", ["o_orderkey"], "day")


@query("local_steps_dst", """WITH w AS (
  SELECT o_orderpriority, o_totalprice, o_orderkey,
         date_trunc('week', o_orderdate) + INTERVAL 23 HOUR AS ts FROM orders),
l AS (SELECT o_orderpriority AS priority, date_trunc('day', timezone('Europe/Zurich', timezone('UTC', ts)) + INTERVAL 12 HOUR) AS wall,
             max(o_totalprice) AS level FROM w GROUP BY 1, 2),
b AS (SELECT priority, level, timezone('UTC', timezone('Europe/Zurich', wall)) AS s,
             timezone('UTC', timezone('Europe/Zurich', wall + INTERVAL 7 DAY)) AS e FROM l)
SELECT priority, level, s AS block_start_utc,
       least(e, coalesce(lead(s) OVER (PARTITION BY priority ORDER BY s), e)) AS block_end_utc,
       CAST(round((epoch(least(e, coalesce(lead(s) OVER (PARTITION BY priority ORDER BY s), e))) - epoch(s)) / 3600) AS BIGINT) AS hours
FROM b""")
def local_steps_dst(t):
    o = t("orders").groupBy(F.col("o_orderpriority").alias("priority"), T.plus(
        F.date_trunc("week", "o_orderdate"), "23 hours").alias("ts")).agg(F.max("o_totalprice").alias("level"))
    out = G.local_steps(o, "ts", ZURICH, 7, ["level"], ["priority"], chunk="365 days")
    return out.withColumn("hours", T.floor_div(T.micros("block_end_utc") - T.micros("block_start_utc"), T.HOUR))


@query("local_4h_blocks", """WITH x AS (
  SELECT value, timezone('Europe/Zurich', timezone('UTC', ts)) AS wall FROM events)
SELECT timezone('UTC', timezone('Europe/Zurich', date_trunc('day', wall) + (extract(hour FROM wall) // 4) * INTERVAL 4 HOUR)) AS block,
       count(*) AS n, round(sum(value), 4) AS total
FROM x GROUP BY 1""")
def local_4h_blocks(t):
    out = t("events").groupBy(T.local_bucket("ts", ZURICH, 4).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out, 4)


@query("month_steps", """WITH m AS (
  SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, timezone('UTC', timezone('Europe/Zurich', month)) AS block_start_utc,
       timezone('UTC', timezone('Europe/Zurich', month + INTERVAL 1 MONTH)) AS block_end_utc, round(total, 2) AS total FROM m""")
def month_steps(t):
    m = t("orders").groupBy("o_orderstatus", T.plus(F.date_trunc("month", "o_orderdate"), "12 hours").alias("ts")).agg(
        F.sum("o_totalprice").alias("total"))
    return rounded(G.month_steps(m, "ts", ZURICH, ["total"], ["o_orderstatus"]), 2)


@query("resample_complete_hours", """WITH q AS (
  SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS q, avg(value) / 1.0837::DOUBLE AS value, max(value) AS peak FROM events GROUP BY 1)
SELECT date_trunc('hour', q) AS bucket, count(*) AS n_rows, round(avg(value), 6) AS value, max(peak) AS peak,
       min_by(q, q) AS q FROM q GROUP BY 1 HAVING count(*) = 4""")
def resample_complete_hours(t):
    q = t("events").groupBy(T.floor_time("ts", "15 minutes").alias("q")).agg(
        (F.avg("value") / RATE).alias("value"), F.max("value").alias("peak"))
    out = G.resample(q, [], "q", T.floor_time("q", "1 hour"), {"value": "mean", "peak": "max"}, 4)
    first = G.resample(q, [], "q", T.floor_time("q", "1 hour"), {"q": "first"}, 4).select("bucket", "q")
    return rounded(out.join(first, "bucket"))


@query("resample_calendar", f"""WITH {DAILY_ORDERS},
u AS (SELECT 'day' AS unit UNION ALL SELECT 'week' UNION ALL SELECT 'sunday_week' UNION ALL SELECT 'month'),
l AS (SELECT unit, priority, price, CASE unit WHEN 'day' THEN CAST(day AS TIMESTAMP)
    WHEN 'week' THEN date_trunc('week', CAST(day AS TIMESTAMP))
    WHEN 'sunday_week' THEN date_trunc('week', CAST(day AS TIMESTAMP) + INTERVAL 1 DAY) - INTERVAL 1 DAY
    ELSE date_trunc('month', CAST(day AS TIMESTAMP)) END AS label FROM daily, u)
SELECT unit, priority, label, round(avg(price), 4) AS mean, min(price) AS low, max(price) AS high
FROM l GROUP BY 1, 2, 3""")
def resample_calendar(t):
    d = daily_orders(t).withColumn("day", F.col("day").cast("timestamp_ntz"))
    labels = F.explode(F.array(
        F.struct(F.lit("day").alias("unit"), F.col("day").alias("label")),
        F.struct(F.lit("week").alias("unit"), T.calendar_bucket("day", "week").alias("label")),
        F.struct(F.lit("sunday_week").alias("unit"), T.calendar_bucket("day", "week", "sunday").alias("label")),
        F.struct(F.lit("month").alias("unit"), T.calendar_bucket("day", "month").alias("label"))))
    out = (d.select("priority", "price", labels.alias("l"))
           .groupBy(F.col("l.unit").alias("unit"), "priority", F.col("l.label").alias("label"))
           .agg(F.avg("price").alias("mean"), F.min("price").alias("low"), F.max("price").alias("high")))
    return rounded(out, 4, "mean")


@query("regularize_fill", f"""WITH {FULL_HOURS},
r AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN hour END) OVER (PARTITION BY event_type ORDER BY hour) AS prev,
             min(CASE WHEN value IS NOT NULL THEN hour END) OVER (PARTITION BY event_type ORDER BY hour
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM full_hours),
f AS (SELECT r.event_type, r.hour, r.value, r.value IS NULL AND (epoch(nxt) - epoch(prev)) / 3600 - 1 <= 2 AS fill, p.value AS pv
      FROM r LEFT JOIN hourly p ON p.event_type = r.event_type AND p.hour = r.prev)
SELECT event_type, hour, round(CASE WHEN fill THEN pv ELSE value END, 6) AS value, coalesce(fill, false) AS filled FROM f""")
def regularize_fill(t):
    e = t("events").select("event_type", F.col("ts").alias("hour"), (F.col("value") / RATE).alias("value"))
    return rounded(G.regularize(e, ["event_type"], "hour", "value", "1 hour", 2, chunk="7 days"))


@query("infer_grid", """WITH d AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events),
s AS (SELECT event_type, h, (epoch(h) - epoch(lag(h) OVER (PARTITION BY event_type ORDER BY h))) / 60 AS minutes FROM d)
SELECT event_type, count(*) AS n_stamps, coalesce(avg(CASE WHEN minutes = 15 THEN 1.0 WHEN minutes IS NOT NULL THEN 0.0 END), 0)::DOUBLE AS share_15,
       quantile_cont(minutes, 0.5) AS median_minutes,
       CASE WHEN quantile_cont(minutes, 0.5) <= 60 THEN 'h' ELSE 'D' END AS grid_kind
FROM s GROUP BY 1""")
def infer_grid(t):
    d = t("events").select("event_type", T.floor_time("ts", "1 hour").alias("h"))
    return G.native_step(d, ["event_type"], "h", chunk="7 days")


@query("end_to_start_labels", """SELECT o_orderkey, o_orderdate - INTERVAL 15 MINUTE AS start_utc,
  timezone('Europe/Zurich', timezone('UTC', o_orderdate - INTERVAL 15 MINUTE)) AS start_local FROM orders""")
def end_to_start_labels(t):
    start = T.interval_start("o_orderdate", "15 minutes")
    return t("orders").select("o_orderkey", start.alias("start_utc"), T.utc_to_local(start, ZURICH).alias("start_local"))


@query("position_index", """SELECT event_id, user_id,
  TIMESTAMP '2024-01-01' + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * INTERVAL 15 MINUTE AS ts_utc FROM events""")
def position_index(t):
    e = t("events").select("event_id", "user_id")
    return G.from_position(e, ["user_id"], "event_id", F.lit("2024-01-01").cast("timestamp_ntz"), "15 minutes")


@query("fold_from_order", """WITH x AS (
  SELECT user_id, event_id, (event_id // 400) % 3 AS label FROM events),
r AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM label THEN 1 ELSE 0 END AS s FROM x),
q AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, label, run ORDER BY event_id) AS pos,
             count(*) OVER (PARTITION BY user_id, label, run) AS size FROM q),
l AS (SELECT user_id, label, count(DISTINCT run) AS runs, min(run) AS first_run, max(size) AS big FROM p GROUP BY 1, 2)
SELECT p.user_id, p.label, p.event_id, CASE WHEN runs > 1 THEN CASE WHEN run > first_run THEN 1 ELSE 0 END
   ELSE CASE WHEN big % 2 = 0 AND pos > big / 2 THEN 1 ELSE 0 END END AS fold
FROM p JOIN l ON p.user_id = l.user_id AND p.label = l.label""")
def fold_from_order(t):
    e = t("events").select("user_id", "event_id", (F.floor(F.col("event_id") / 400) % 3).alias("label"))
    return G.resolve_fold(e, "user_id", "label", "event_id")


@query("detect_clock", """SELECT o_orderpriority AS series,
  count(*) FILTER (WHERE month(o_orderdate) = 3 AND day(o_orderdate) >= 25) AS spring_rows,
  count(*) FILTER (WHERE month(o_orderdate) = 10 AND day(o_orderdate) >= 25) AS autumn_rows,
  count(DISTINCT o_orderdate) FILTER (WHERE month(o_orderdate) = 10 AND day(o_orderdate) >= 25) AS autumn_stamps,
  CASE WHEN spring_rows = 0 AND autumn_rows > autumn_stamps THEN 'local' WHEN autumn_rows = autumn_stamps THEN 'fixed' ELSE 'unknown' END AS clock
FROM orders GROUP BY 1""")
def detect_clock(t):
    o = t("orders").withColumn("series", F.col("o_orderpriority"))
    late = F.dayofmonth("o_orderdate") >= 25
    return G.detect_clock(o, "o_orderdate", (F.month("o_orderdate") == 3) & late, (F.month("o_orderdate") == 10) & late, ["series"])


@query("expected_vs_present_days", """WITH b AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events),
g AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS h FROM b),
x AS (SELECT date_trunc('day', timezone('Europe/Zurich', timezone('UTC', h))) AS day, count(*) AS expected FROM g GROUP BY 1),
k AS (SELECT DISTINCT event_type FROM events),
p AS (SELECT event_type, date_trunc('day', timezone('Europe/Zurich', timezone('UTC', h))) AS day, count(*) AS present
      FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY 1, 2)
SELECT k.event_type, x.day, expected, coalesce(present, 0) AS present FROM x CROSS JOIN k LEFT JOIN p ON x.day = p.day AND p.event_type = k.event_type""")
def expected_vs_present_days(t):
    e = t("events")
    ends = e.agg(T.floor_time(F.min("ts"), "1 day").alias("a"), T.floor_time(F.max("ts"), "1 hour").alias("z"))
    hours = ends.select(F.explode(G.instants(F.col("a"), T.plus("z", "1 hour"), "1 hour")).alias("h"))
    day = F.date_trunc("day", T.utc_to_local("h", ZURICH)).cast("timestamp_ntz").alias("day")
    expected = hours.groupBy(day).agg(F.count(F.lit(1)).alias("expected"))
    present = (e.select("event_type", T.floor_time("ts", "1 hour").alias("h")).distinct()
               .groupBy("event_type", day).agg(F.count(F.lit(1)).alias("present")))
    wanted = e.select("event_type").distinct().crossJoin(expected)  # a few types by days
    return wanted.join(present, ["event_type", "day"], "left").withColumn("present", F.coalesce("present", F.lit(0)))


# ---------------------------------------------------------------- calendar
_EASTER = """e AS (SELECT *, (h + l - 7 * m + 114) // 31 AS em, (h + l - 7 * m + 114) % 31 + 1 AS ed FROM (
  SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
  SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
  SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
  SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)))))),
easter AS (SELECT y, make_date(y, em, ed) AS sunday FROM e)"""


def _holiday_sql(d: str) -> str:
    return (f"(month({d}) * 100 + day({d}) IN (101, 102, 801, 1225, 1226) OR EXISTS "
            f"(SELECT 1 FROM easter WHERE y = year({d}) AND {d} - sunday IN (-2, 1, 39, 50)))")


@query("holiday_calendar", f"""WITH {_EASTER}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
nb AS (SELECT d, CAST(d + INTERVAL 1 DAY AS DATE) AS nd, CAST(d - INTERVAL 1 DAY AS DATE) AS pd FROM days),
f AS (SELECT d, {_holiday_sql('d')} AS h, {_holiday_sql('nd')} AS nh, {_holiday_sql('pd')} AS ph,
             isodow(d) - 1 AS wd, month(d) * 100 + day(d) AS md FROM nb)
SELECT d, h AS holiday, nh AS day_before_holiday, ph AS day_after_holiday,
       (wd = 0 AND nh) OR (wd = 4 AND ph) AS bridge_day, md >= 1224 OR md <= 106 AS xmas_period FROM f""")
def holiday_calendar(t):
    days = t("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.withColumns(C.day_flags("d"))


@query("calendar_features", """WITH d AS (SELECT DISTINCT o_orderdate AS d, CAST(o_orderkey % 7 + 1 AS INTEGER) AS n FROM orders)
SELECT d, n, isodow(d) - 1 AS dow, week(d) AS iso_week, dayofyear(d) AS doy, quarter(d) AS quarter, strftime(d, '%Y-%m') AS period,
  round(sin(2 * pi() * dayofyear(d) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(d) / 365.25), 6) AS doy_cos,
  round(sin(2 * pi() * 3 * (isodow(d) - 1) / 7), 6) AS dow_sin_3,
  round(list_sum([CASE WHEN isodow(d + k * INTERVAL 1 DAY) >= 6 THEN 1 ELSE 0 END FOR k IN range(n)]) / n, 6)::DOUBLE AS weekend_share FROM d""")
def calendar_features(t):
    d = t("orders").select(F.col("o_orderdate").alias("d"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("n")).distinct()
    doy = C.cyclic(F.dayofyear("d"), 365.25)
    out = d.select("d", "n", F.weekday("d").cast("long").alias("dow"), F.weekofyear("d").cast("long").alias("iso_week"),
                   F.dayofyear("d").cast("long").alias("doy"), F.quarter("d").cast("long").alias("quarter"),
                   F.date_format("d", "yyyy-MM").alias("period"), doy["sin_1"].alias("doy_sin"), doy["cos_1"].alias("doy_cos"),
                   C.cyclic(F.weekday("d"), 7, 3)["sin_3"].alias("dow_sin_3"),
                   C.share_of_days("d", F.col("n"), lambda x: F.weekday(x) >= 5).alias("weekend_share"))
    return rounded(out)


@query("concurrency_grid", """WITH iv AS (SELECT l_linestatus AS line, l_shipdate AS s, l_shipdate + l_linenumber * INTERVAL 1 DAY AS e FROM lineitem),
d AS (SELECT line, t, sum(x) AS x FROM (SELECT line, s AS t, 1 AS x FROM iv UNION ALL SELECT line, e, -1 FROM iv) GROUP BY 1, 2),
b AS (SELECT min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem),
g AS (SELECT line, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS day FROM b, (SELECT DISTINCT line FROM iv)),
r AS (SELECT line, t, sum(x) OVER (PARTITION BY line ORDER BY t) AS o FROM d)
SELECT g.line, g.day, CAST(coalesce(o, 0) AS BIGINT) AS open FROM g ASOF LEFT JOIN r ON g.line = r.line AND g.day >= r.t""")
def concurrency_grid(t):
    iv = t("lineitem").select(F.col("l_linestatus").alias("line"), F.col("l_shipdate").alias("s"),
                              T.plus("l_shipdate", F.col("l_linenumber").cast("long") * T.DAY).alias("e"))
    days = G.span_grid(iv.withColumnRenamed("s", "day"), "day", "1 day", ["line"])
    return I.concurrency_on_grid(iv, days, "s", "e", "day", ["line"], "90 days").withColumn("open", F.col("open").cast("long"))
