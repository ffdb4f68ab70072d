"""As-of joins, look-backs and everything that asks what was known when."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import pit
from ..operators.asof import asof_join
from ..session import cut_lineage
from .grids import FULL_HOURS, full_hours
from .registry import DAILY_ORDERS, HOURLY, RATE, UNITS, daily_orders, hourly, query, rounded, units


def _buys(t):
    e = t("events")
    buys = e.where(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"))
    clicks = e.where(F.col("event_type") == "click").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    return buys, clicks


_ASOF = """WITH b AS (SELECT user_id, ts AS buy_ts, event_id AS buy_id FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts AS click_ts, value AS click_value FROM events WHERE event_type = 'click')
SELECT b.user_id, b.buy_ts, b.buy_id, {cols} FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.buy_ts >= c.click_ts"""


@query("asof_backward", _ASOF.format(cols="c.click_ts, c.click_value"))
def asof_backward(t):
    buys, clicks = _buys(t)
    return asof_join(buys, clicks, "buy_ts", "click_ts", ["user_id"])


@query("asof_tolerance", _ASOF.format(
    cols="CASE WHEN b.buy_ts - c.click_ts <= INTERVAL 2 DAY THEN c.click_value END AS click_value"))
def asof_tolerance(t):
    buys, clicks = _buys(t)
    return asof_join(buys, clicks, "buy_ts", "click_ts", ["user_id"], {"click_value": "click_value"}, tolerance="2 days")


@query("scd_join_last_year", """WITH dim AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, max(o_totalprice) AS cap FROM orders
  WHERE year(o_orderdate) % 2 = 1 GROUP BY 1, 2)
SELECT o_orderkey, year(o_orderdate) AS yr, d.cap, o_totalprice > 0.9 * d.cap AS above FROM orders o
ASOF LEFT JOIN dim d ON o.o_orderpriority = d.p AND year(o.o_orderdate) >= d.y""")
def scd_join_last_year(t):
    o = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.year("o_orderdate").cast("long").alias("yr"), "o_totalprice")
    dim = o.where(F.col("yr") % 2 == 1).groupBy("p", F.col("yr").alias("y")).agg(F.max("o_totalprice").alias("cap"))
    out = asof_join(o, dim, "yr", "y", ["p"], {"cap": "cap"}, chunk=1)
    return out.select("o_orderkey", "yr", "cap", (F.col("o_totalprice") > 0.9 * F.col("cap")).alias("above"))


@query("lag_same_slot", f"""WITH {HOURLY}
SELECT a.event_type, a.hour, a.n, b.n AS n__lag1d, c.n AS n__lag7d FROM hourly a
LEFT JOIN hourly b ON b.event_type = a.event_type AND b.hour = a.hour - INTERVAL 1 DAY
LEFT JOIN hourly c ON c.event_type = a.event_type AND c.hour = a.hour - INTERVAL 7 DAY""")
def lag_same_slot(t):
    return pit.lag_join(hourly(t).select("event_type", "hour", "n"), ["event_type"], "hour", ["n"], [1, 7])


# Day-ahead origins: 18:00 on the day before, values published one hour after the hour ends.
def _origins(t):
    h = hourly(t)
    return h.select("event_type", T.plus(F.date_trunc("day", "hour"), -6 * T.HOUR).alias("t0")).distinct()


_PIT = f"""{FULL_HOURS},
origins AS (SELECT DISTINCT event_type, date_trunc('day', hour) - INTERVAL 6 HOUR AS t0 FROM hourly),
pub AS (SELECT event_type, hour, value, n, hour + INTERVAL 2 HOUR AS pub, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM full_hours),
e AS (SELECT o.event_type, o.t0, max(p.i) AS i FROM origins o LEFT JOIN pub p ON p.event_type = o.event_type AND p.pub <= o.t0 GROUP BY 1, 2)"""


@query("pit_lookback", f"""WITH {_PIT}
SELECT e.event_type, e.t0, round(CASE WHEN count(p.value) >= 12 THEN avg(p.value) END, 6) AS value__lb24h,
  CASE WHEN count(p.value) >= 12 THEN CAST(sum(p.n) AS DOUBLE) END AS n__lb24h, round(CASE WHEN count(p.value) >= 12 THEN max(p.value) END, 6) AS peak__lb24h,
  round(CASE WHEN count(p.value) >= 12 THEN min(p.value) END, 6) AS low__lb24h,
  round(CASE WHEN count(p.value) >= 12 THEN sum(p.value * p.n) / sum(CASE WHEN p.value IS NOT NULL THEN p.n END) END, 6) AS vw__lb24h
FROM e LEFT JOIN pub p ON p.event_type = e.event_type AND p.i > e.i - 24 AND p.i <= e.i GROUP BY 1, 2""")
def pit_lookback(t):
    h = full_hours(t).withColumn("pub", T.plus("hour", "2 hours"))
    v, n = F.col("value"), F.col("n").cast("double")
    out = pit.pit_lookback(h, _origins(t), ["event_type"], "hour", "pub", "t0", {
        "value__lb24h": ("mean", v), "n__lb24h": ("sum", n), "peak__lb24h": ("max", v), "low__lb24h": ("min", v),
        "vw__lb24h": ("vwmean", v)}, 24, 12, {"vw__lb24h": n}, chunk="7 days")
    return rounded(out)


@query("pit_last", f"""WITH {_PIT}
SELECT e.event_type, e.t0, p.hour AS last_hour, round(p.value, 6) AS value__last FROM e LEFT JOIN pub p ON p.event_type = e.event_type AND p.i = e.i""")
def pit_last(t):
    h = full_hours(t).withColumn("pub", T.plus("hour", "2 hours"))
    return rounded(pit.pit_last(h, _origins(t), "pub", "t0", ["event_type"], {"hour": "last_hour", "value": "value__last"}, chunk="7 days"))


@query("pit_completed_window", f"""WITH {_PIT.replace('INTERVAL 2 HOUR AS pub', 'INTERVAL 1 HOUR AS pub')}
SELECT e.event_type, e.t0, round(CASE WHEN count(p.value) >= 2 THEN avg(p.value) END, 6) AS value__last6, CASE WHEN count(p.value) >= 2 THEN CAST(sum(p.n) AS DOUBLE) END AS n__last6
FROM e LEFT JOIN pub p ON p.event_type = e.event_type AND p.i > e.i - 6 AND p.i <= e.i GROUP BY 1, 2""")
def pit_completed_window(t):
    # Six completed hours, one quarter of them (rounded up) must carry a value.
    h = full_hours(t).withColumn("done", T.plus("hour", "1 hour"))
    return rounded(pit.pit_lookback(h, _origins(t), ["event_type"], "hour", "done", "t0", {
        "value__last6": ("mean", F.col("value")), "n__last6": ("sum", F.col("n").cast("double"))}, 6, 2, chunk="7 days"))


@query("past_share", f"""WITH {FULL_HOURS}, s AS (SELECT event_type, hour, CASE WHEN coalesce(n, 0) > 4 THEN 1.0 ELSE 0.0 END AS busy FROM full_hours),
o AS (SELECT DISTINCT event_type, date_trunc('day', hour) - INTERVAL 6 HOUR AS t0 FROM hourly)
SELECT o.event_type, o.t0, round(CAST(coalesce(sum(s.busy), 0) / greatest(count(s.busy), 1) AS DOUBLE), 6) AS busy_share
FROM o LEFT JOIN s ON s.event_type = o.event_type AND s.hour >= o.t0 - INTERVAL 24 HOUR AND s.hour < o.t0 GROUP BY 1, 2""")
def past_share(t):
    s = full_hours(t).withColumn("busy", F.when(F.coalesce("n", F.lit(0)) > 4, 1.0).otherwise(0.0))
    o = _origins(t).withColumn("a", T.plus("t0", -24 * T.HOUR))
    from ..operators.asof import span_sums

    out = span_sums(o, s, "a", "t0", "hour", ["event_type"], {"k": F.col("busy"), "c": F.lit(1.0)}, closed="left", chunk="7 days")
    return rounded(out.select("event_type", "t0", (F.col("k") / F.greatest("c", F.lit(1.0))).alias("busy_share")))


@query("event_window_vwap", f"""WITH {HOURLY}
SELECT o.event_type, o.hour AS t0, count(e.value) AS n_events, round(sum(e.value * (e.event_id % 5 + 1)) / nullif(sum(e.event_id % 5 + 1), 0) / 1.0837::DOUBLE, 6) AS vwap,
  CAST(coalesce(sum(e.event_id % 5 + 1), 0) AS DOUBLE) AS volume
FROM (SELECT DISTINCT event_type, hour FROM hourly) o
LEFT JOIN events e ON e.event_type = o.event_type AND e.ts > o.hour - INTERVAL 4 HOUR AND e.ts <= o.hour GROUP BY 1, 2""")
def event_window_vwap(t):
    o = hourly(t).select("event_type", F.col("hour").alias("t0"))
    e = t("events").withColumn("volume_", (F.col("event_id") % 5 + 1).cast("double"))
    return rounded(pit.event_window(e, o, ["event_type"], "ts", "t0", "4 hours", F.col("value") / RATE, F.col("volume_")))


def _blocks(t):
    """Daily blocks per priority with slot = weekday, gate closure D-1 08:00, result one hour later."""
    d = daily_orders(t).withColumn("start", F.col("day").cast("timestamp_ntz"))
    return d.withColumns({"slot": F.weekday("day").cast("long"), "t0": T.plus("start", -16 * T.HOUR), "known": T.plus("start", -15 * T.HOUR)})


BLOCKS = f"""{DAILY_ORDERS},
blocks AS (SELECT *, CAST(day AS TIMESTAMP) AS start, isodow(day) - 1 AS slot, CAST(day AS TIMESTAMP) - INTERVAL 16 HOUR AS t0,
                  CAST(day AS TIMESTAMP) - INTERVAL 15 HOUR AS known FROM daily)"""


@query("lagged_targets", f"""WITH {BLOCKS},
a AS (SELECT b.priority, b.day, b.slot, round(p.price, 4) AS prev_slot__price, p.n AS prev_slot__n FROM blocks b
      ASOF LEFT JOIN blocks p ON p.priority = b.priority AND p.slot = b.slot AND b.t0 >= p.known),
q AS (SELECT b.priority, b.day, round(p.price, 4) AS prev_auction__price, CAST(p.n AS DOUBLE) AS prev_auction__n FROM blocks b ASOF LEFT JOIN blocks p ON p.priority = b.priority AND b.t0 >= p.known)
SELECT a.*, q.prev_auction__price, q.prev_auction__n FROM a JOIN q ON a.priority = q.priority AND a.day = q.day""")
def lagged_targets(t):
    out = pit.lagged_targets(_blocks(t), ["priority"], "slot", "start", "t0", "known", ["price", "n"], "365 days")
    return rounded(out.select("priority", "day", "slot", "prev_slot__price", "prev_slot__n", "prev_auction__price", "prev_auction__n"), 4)


@query("cross_market", f"""WITH {DAILY_ORDERS},
m AS (SELECT day, avg(price) AS v FROM daily GROUP BY 1),
r AS (SELECT day, v, CASE WHEN count(v) OVER w >= 4 THEN avg(v) OVER w END AS lb, CAST(day AS TIMESTAMP) - INTERVAL 12 HOUR AS known_at FROM m
      WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)),
b AS (SELECT priority, day, CAST(day AS TIMESTAMP) - INTERVAL 16 HOUR AS t0 FROM daily)
SELECT b.priority, b.day, b.t0, CASE WHEN b.t0 - r.known_at <= INTERVAL 3 DAY THEN r.known_at END AS known_at,
  round(CASE WHEN b.t0 - r.known_at <= INTERVAL 3 DAY THEN r.v END, 4) AS prevday, round(CASE WHEN b.t0 - r.known_at <= INTERVAL 3 DAY THEN r.lb END, 4) AS lb7d,
  round(CASE WHEN b.t0 - r.known_at <= INTERVAL 3 DAY THEN s.price END, 4) AS prevday_slot
FROM b ASOF LEFT JOIN r ON b.t0 >= r.known_at LEFT JOIN daily s ON s.day = r.day AND s.priority = b.priority""")
def cross_market(t):
    d = daily_orders(t)
    m = d.groupBy("day").agg(F.avg("price").alias("v")).withColumn("market", F.lit("x"))
    s = d.select(F.lit("x").alias("market"), F.col("priority").alias("slot"), "day", F.col("price").alias("v"))
    o = d.select(
        F.lit("x").alias("market"), F.col("priority").alias("slot"), F.col("day").alias("delivery"), T.plus("day", -16 * T.HOUR).alias("t0"))
    out = pit.cross_market(m, s, o, ["market"], "day", "slot", "v", T.plus("day", -12 * T.HOUR), "t0", chunk="365 days")
    return rounded(out.select(F.col("slot").alias("priority"), F.col("delivery").alias("day"), "t0", "known_at", F.col("prevday"), "lb7d", "prevday_slot"), 4)


@query("freshest_lead", """WITH c AS (SELECT l_shipdate AS h, l_linenumber AS lead, avg(l_extendedprice) AS v, avg(1 - l_discount) AS cov FROM lineitem GROUP BY 1, 2),
n AS (SELECT DISTINCT l_shipdate AS h, date_trunc('week', l_shipdate) AS block, date_trunc('week', l_shipdate) - INTERVAL 36 HOUR AS t0 FROM lineitem),
p AS (SELECT n.h, n.block, n.t0, min(lead) AS lead_used, min_by(v, lead) AS v FROM n LEFT JOIN c ON c.h = n.h AND c.cov >= 0.95 AND c.h - lead * INTERVAL 1 DAY + INTERVAL 6 HOUR <= n.t0 GROUP BY 1, 2, 3)
SELECT block, t0, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 4) AS v, CASE WHEN count(v) = count(*) THEN CAST(max(lead_used) AS BIGINT) END AS lead_max FROM p GROUP BY 1, 2""")
def freshest_lead(t):
    li = t("lineitem")
    cube = li.groupBy(F.col("l_shipdate").alias("h"), F.col("l_linenumber").cast("long").alias("lead")).agg(
        F.avg("l_extendedprice").alias("v"), F.avg(1 - F.col("l_discount")).alias("cov"))
    week = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    need = li.select(F.col("l_shipdate").alias("h"), week.alias("block"), T.plus(week, -36 * T.HOUR).alias("t0")).distinct()
    hours = pit.freshest_lead(cube, need, [], "h", "lead", "v", "cov", "t0", "6 hours", 0.95)
    return rounded(pit.complete_blocks(hours, ["block", "t0"], "v"), 4)


@query("leakage_check", f"""WITH {BLOCKS}, x AS (SELECT b.priority, b.day, b.t0, p.known FROM blocks b ASOF JOIN blocks p ON p.priority = b.priority AND b.t0 >= p.known)
SELECT priority, count(*) AS n, count(*) FILTER (WHERE known > t0) AS n_leaks FROM x GROUP BY 1""")
def leakage_check(t):
    b = _blocks(t)
    out = asof_join(b.select("priority", "t0"), b.select("priority", "known"), "t0", "known", ["priority"], chunk="365 days")
    out = out.where(F.col("known").isNotNull())
    bad = pit.leaks(out, "known", "t0").groupBy("priority").agg(F.count(F.lit(1)).alias("n_leaks"))
    return out.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).join(bad, "priority", "left").fillna(0, ["n_leaks"])


@query("interval_explode_vwap", """WITH x AS (SELECT l_returnflag AS product, unnest(generate_series(l_shipdate, l_shipdate + (l_linenumber - 1) * INTERVAL 1 DAY, INTERVAL 1 DAY)) AS slot,
   l_extendedprice / l_quantity AS price, l_quantity AS volume, o_orderdate AS executed FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT product, slot, round(sum(price * volume) / sum(volume), 6) AS vwap, sum(volume) AS volume, count(*) AS n,
  round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (executed, price)), 6) AS last
FROM x WHERE volume > 0 AND executed <= slot GROUP BY 1, 2""")
def interval_explode_vwap(t):
    u = units(t).select(F.col("kind").alias("product"), "start", "stop", (F.col("l_extendedprice") / F.col("mw")).alias("price"),
                        F.col("mw").alias("volume"), F.col("created").alias("executed"))
    x = I.explode_intervals(u, "start", "stop", "1 day")
    return rounded(pit.slot_statistics(x, ["product"], "slot", "executed", "price", "volume", F.col("slot")))


_LATEST = f"""{UNITS},
pts AS (SELECT unit, start AS p FROM units UNION SELECT unit, stop FROM units),
seg AS (SELECT unit, p, lead(p) OVER (PARTITION BY unit ORDER BY p) AS q FROM pts),
win AS (SELECT s.unit, s.p, s.q, arg_max(u.mw, (u.created, u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_extendedprice)) AS mw,
               arg_max(u.kind, (u.created, u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_extendedprice)) AS kind
        FROM seg s JOIN units u ON u.unit = s.unit AND u.start <= s.p AND u.stop >= s.q WHERE s.q IS NOT NULL GROUP BY 1, 2, 3)"""

RANK = ["created", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query("latest_wins", f"""WITH {_LATEST}
SELECT unit, kind, round(sum(mw * epoch(q - p)) / 3600, 4) AS mwh, round(sum(epoch(q - p)) / 3600, 4)::DOUBLE AS hours FROM win GROUP BY 1, 2""")
def latest_wins(t):
    segs = I.resolve_latest(units(t), ["unit"], "start", "stop", RANK, {"mw": "mw", "kind": "kind"}, "20 days")
    hours = (T.micros("seg_end") - T.micros("seg_start")) / T.HOUR
    return rounded(segs.groupBy("unit", "kind").agg(F.sum(F.col("mw") * hours).alias("mwh"), F.sum(hours).alias("hours")), 4)


@query("segments", """WITH iv AS (SELECT l_suppkey AS unit, l_shipdate AS s, l_shipdate + l_linenumber * INTERVAL 1 DAY AS e FROM lineitem),
pts AS (SELECT unit, s AS p FROM iv UNION SELECT unit, e FROM iv),
seg AS (SELECT unit, p, lead(p) OVER (PARTITION BY unit ORDER BY p) AS q FROM pts)
SELECT unit, p, q FROM seg WHERE q IS NOT NULL""")
def segments(t):
    iv = t("lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("s"),
                              T.plus("l_shipdate", F.col("l_linenumber").cast("long") * T.DAY).alias("e"))
    return I.segments(iv, ["unit"], "s", "e", "365 days")


_OUTAGE = f"""WITH {UNITS},
w AS (SELECT DISTINCT date_trunc('month', start) AS bs, date_trunc('month', start) + INTERVAL 1 MONTH AS be, date_trunc('month', start) - INTERVAL 36 HOUR AS t0 FROM units),
j AS (SELECT w.*, u.unit, u.kind, u.mw, (u.created, u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_extendedprice) AS k,
             greatest(u.start, bs) AS s, least(u.stop, be) AS en FROM w JOIN units u ON u.start < be AND u.stop > bs AND u.created <= {{asof}}),
p AS (SELECT bs, be, t0, unit, s AS p FROM j UNION SELECT bs, be, t0, unit, en FROM j),
seg AS (SELECT *, lead(p) OVER (PARTITION BY bs, unit ORDER BY p) AS q FROM p),
win AS (SELECT g.bs, g.be, g.t0, g.unit, g.p, g.q, arg_max(j.mw, j.k) AS mw, arg_max(j.kind, j.k) AS kind FROM seg g
        JOIN j ON j.bs = g.bs AND j.unit = g.unit AND j.s <= g.p AND j.en >= g.q WHERE g.q IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)
SELECT bs, be, kind, round(sum(mw * epoch(q - p)) / epoch(be - bs), 6) AS mw FROM win GROUP BY 1, 2, 3"""


def _outages(t, always: bool):
    u = units(t)
    month = F.date_trunc("month", "start").cast("timestamp_ntz")
    w = u.select(month.alias("bs")).distinct().withColumns({
        "be": F.add_months(F.col("bs").cast("date"), 1).cast("timestamp_ntz"), "t0": T.plus("bs", -36 * T.HOUR)})
    if always:
        w = w.withColumn("t0", F.lit("2100-01-01").cast("timestamp_ntz"))
    w = cut_lineage(w)  # a row a month: its size is known when the join is planned
    pairs = I.overlap_join(u, w, ("start", "stop"), ("bs", "be"), known=("created", "t0"), bin="30 days")
    segs = I.resolve_latest(pairs, ["unit", "bs", "be"], "clip_start", "clip_end", RANK, {"mw": "mw", "kind": "kind"}, "10 days", ("bs", "be"))
    return rounded(I.time_weighted(segs, "mw", ("bs", "be"), ["kind"], "mw"))


@query("outages_asof", _OUTAGE.format(asof="t0"))
def outages_asof(t):
    return _outages(t, always=False)


@query("outages_expost", _OUTAGE.format(asof="TIMESTAMP '2100-01-01'"))
def outages_expost(t):
    # The same plan with an origin far in the future must equal what was known in the end.
    return _outages(t, always=True)


@query("exante_block_view", f"""WITH {_PIT},
d AS (SELECT event_type, date_trunc('day', hour) AS day, avg(value) AS outcome, count(value) / 24.0 AS coverage FROM full_hours GROUP BY 1, 2),
lb AS (SELECT e.event_type, e.t0, CASE WHEN count(p.value) >= 12 THEN avg(p.value) END AS lb FROM e LEFT JOIN pub p ON p.event_type = e.event_type AND p.i > e.i - 24 AND p.i <= e.i GROUP BY 1, 2),
k AS (SELECT event_type, day, day + INTERVAL 25 HOUR AS known, outcome FROM d)
SELECT d.event_type, d.day, d.day - INTERVAL 6 HOUR AS t0, round(d.outcome, 6) AS outcome, round(d.coverage, 6)::DOUBLE AS coverage,
  round(lb.lb, 6) AS value__lb24h, round(k.outcome, 6) AS prev_block, k.known AS prev_known, isodow(d.day) - 1 AS cal_dow
FROM d LEFT JOIN lb ON lb.event_type = d.event_type AND lb.t0 = d.day - INTERVAL 6 HOUR
ASOF LEFT JOIN k ON k.event_type = d.event_type AND d.day - INTERVAL 6 HOUR >= k.known""")
def exante_block_view(t):
    """Outcome of each daily block beside what was published 18:00 the day before."""
    hours = full_hours(t).withColumn("pub", T.plus("hour", "2 hours"))
    day = F.date_trunc("day", "hour").cast("timestamp_ntz")
    blocks = hours.groupBy("event_type", day.alias("day")).agg(
        F.avg("value").alias("outcome"), (F.count("value") / 24).alias("coverage"))
    blocks = blocks.withColumns({"t0": T.plus("day", -6 * T.HOUR), "known": T.plus("day", 25 * T.HOUR)})
    lb = pit.pit_lookback(hours, blocks.select("event_type", "t0"), ["event_type"], "hour", "pub", "t0",
                          {"value__lb24h": ("mean", F.col("value"))}, 24, 12, chunk="7 days")
    view = asof_join(blocks, blocks.select("event_type", "known", "outcome"), "t0", "known", ["event_type"],
                     {"outcome": "prev_block", "known": "prev_known"}, chunk="30 days")
    out = view.join(lb, ["event_type", "t0"], "left").withColumn("cal_dow", F.weekday("day").cast("long"))
    return rounded(out.select("event_type", "day", "t0", "outcome", "coverage", "value__lb24h", "prev_block", "prev_known", "cal_dow"))


@query("publication_monotone", """WITH p AS (SELECT user_id, event_id, ts + (event_id % 3) * INTERVAL 1 HOUR AS pub, ts FROM events),
l AS (SELECT *, lag(pub) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM p)
SELECT user_id, count(*) AS n_breaks FROM l WHERE pub < before GROUP BY 1""")
def publication_monotone(t):
    p = t("events").withColumn("pub", T.plus("ts", F.col("event_id") % 3 * T.HOUR))
    return pit.publication_breaks(p, ["user_id"], "ts", "pub").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_breaks"))
