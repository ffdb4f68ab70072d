"""Projections, masks, regimes, and the dictionary-driven window aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions import timeaxis as T
from ..operators import aggregates as A
from ..operators import intervals as I
from ..operators import shaping as S
from ..plans import aggregation as P
from ..plans import publication as U
from .registry import query, rounded

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("flag_and_null", """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.08) AS n_flagged,
  count(*) FILTER (WHERE l_tax < 0.02) AS n_suspect, round(avg(CASE WHEN NOT l_discount > 0.08 THEN l_discount END), 6) AS discount
FROM lineitem GROUP BY 1, 2""")
def flag_and_null(t):
    out = S.flag_and_null(t("lineitem"), "l_discount", F.col("l_discount") > 0.08, "flag_discount_implausible")
    out = S.flag(out, "flag_tax_suspect", F.col("l_tax") < 0.02)
    return rounded(out.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flag_discount_implausible").alias("n_flagged"),
        F.count_if("flag_tax_suspect").alias("n_suspect"), F.avg("l_discount").alias("discount")))


@query("mask_by_flags", """SELECT l_linenumber, count(*) FILTER (WHERE NOT (l_tax > 0.06 OR l_returnflag = 'R')) AS n_price,
  count(*) FILTER (WHERE NOT l_returnflag = 'R') AS n_quantity,
  round(avg(CASE WHEN NOT (l_tax > 0.06 OR l_returnflag = 'R') THEN l_extendedprice END), 4) AS price,
  round(avg(CASE WHEN NOT l_returnflag = 'R' THEN l_quantity END), 6) AS quantity FROM lineitem GROUP BY 1""")
def mask_by_flags(t):
    df = S.flag(t("lineitem"), "flag_tax", F.col("l_tax") > 0.06)
    df = S.flag(df, "flag_returned", F.col("l_returnflag") == "R")
    links = S.link_flags(["l_extendedprice", "l_quantity"], {"flag_tax": "price$", "flag_returned": "^l_(ext|qua)"})
    out = S.mask_by_flags(df, links).groupBy("l_linenumber").agg(
        F.count("l_extendedprice").alias("n_price"), F.count("l_quantity").alias("n_quantity"),
        F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("quantity"))
    return rounded(rounded(out, 4, "price"), 6, "quantity")


@query("regime_columns", """SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-07-01' THEN 'four_hour' WHEN o_orderdate >= TIMESTAMP '1998-06-11' THEN 'daily' ELSE 'weekly' END AS regime_auction,
  CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'single' ELSE 'dual' END AS regime_pricing,
  count(*) AS n, count(CASE WHEN o_orderdate < TIMESTAMP '1998-10-01' THEN o_totalprice END) AS n_old_zone,
  count(CASE WHEN o_orderdate >= TIMESTAMP '1998-10-01' THEN o_totalprice END) AS n_new_zone FROM orders GROUP BY 1, 2""")
def regime_columns(t):
    out = P.regimes(t("orders"), "o_orderdate", {
        "regime_auction": [(None, "weekly"), ("1998-06-11", "daily"), ("2000-07-01", "four_hour")],
        "regime_pricing": [(None, "dual"), ("1999-01-01", "single")]})
    out = P.split_at(out, "o_totalprice", "o_orderdate", "1998-10-01", "old_zone", "new_zone")
    return out.groupBy("regime_auction", "regime_pricing").agg(
        F.count(F.lit(1)).alias("n"), F.count("old_zone").alias("n_old_zone"), F.count("new_zone").alias("n_new_zone"))


@query("analysis_window", """SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'test' ELSE 'train' END AS split, o_orderpriority,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND NOT o_orderstatus = 'P' GROUP BY 1, 2""")
def analysis_window(t):
    df = S.flag(t("orders"), "partial_in_sample", F.col("o_orderstatus") == "P")
    out = P.window_filter(df, "o_orderdate", {"baseline": "1999-01-01", "extended": "1997-01-01"}, "extended",
                          "2000-01-01", "partial_in_sample")
    return rounded(out.groupBy("split", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("conditional_fill", """WITH x AS (SELECT l_returnflag, l_linestatus,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS up, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END AS down,
  CASE WHEN l_linenumber > 3 THEN l_discount END AS act FROM lineitem)
SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN (up IS NULL) <> (down IS NULL) THEN coalesce(up, 0) ELSE up END), 4) AS up,
  round(sum(CASE WHEN (up IS NULL) <> (down IS NULL) THEN coalesce(down, 0) ELSE down END), 4) AS down,
  count(CASE WHEN up > 25 THEN act END) AS n_price, count(coalesce(act, CASE WHEN up > 0 THEN 0 END)) AS n_act,
  round(sum(CASE WHEN up IS NULL AND down IS NULL THEN NULL ELSE coalesce(up, 0) + coalesce(down, 0) END), 4) AS both
FROM x GROUP BY 1, 2""")
def conditional_fill(t):
    q = F.col
    df = t("lineitem").select("l_returnflag", "l_linestatus", F.when(q("l_returnflag") != "A", q("l_quantity")).alias("up"),
                              F.when(q("l_returnflag") != "N", q("l_tax")).alias("down"),
                              F.when(q("l_linenumber") > 3, q("l_discount")).alias("act"))
    df = df.withColumns({"both": N.row_sum(["up", "down"]), "price": q("act"), "had": q("up")})
    df = S.xor_zero(df, "up", "down")
    df = S.zero_if(S.null_unless(df, "price", q("had") > 25), "act", q("had") > 0)
    return rounded(df.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("up").alias("up"), F.sum("down").alias("down"), F.count("price").alias("n_price"),
        F.count("act").alias("n_act"), F.sum("both").alias("both")), 4)


@query("unit_conversion", """SELECT l_returnflag, CASE l_linestatus WHEN 'F' THEN 'down' ELSE 'up' END AS direction,
  round(sum(l_quantity * 4 / 1000), 6) AS mw, round(avg(l_extendedprice / l_quantity * 10), 4) AS eur_mwh, round(sum(l_quantity / l_linenumber), 4) AS per_hour
FROM lineitem GROUP BY 1, 2""")
def unit_conversion(t):
    df = S.rename_strict(t("lineitem"), {"l_quantity": "kwh_qh", "l_linestatus": "status"})
    df = S.map_values(df, "status", {"F": "down", "O": "up"}, "direction")
    df = S.convert_units(df, {"mw": ("kwh_qh", 0.004), "eur_mwh": ("l_extendedprice", 10 / F.col("kwh_qh")),
                              "per_hour": ("kwh_qh", 1 / F.col("l_linenumber"))})
    out = df.groupBy("l_returnflag", "direction").agg(F.sum("mw").alias("mw"), F.avg("eur_mwh").alias("eur_mwh"),
                                                      F.sum("per_hour").alias("per_hour"))
    return rounded(rounded(out, 4, "eur_mwh", "per_hour"), 6, "mw")


@query("gate_closure", """WITH d AS (SELECT DISTINCT o_orderdate AS day, o_orderpriority AS p, timezone('UTC', timezone('Europe/Zurich', o_orderdate)) AS block_start FROM orders),
w AS (SELECT *, isodow(day) - 1 AS wd FROM d),
g AS (SELECT *, CASE p WHEN '1-URGENT' THEN date_trunc('week', day) - INTERVAL 6 DAY + INTERVAL 13 HOUR
   WHEN '2-HIGH' THEN day - INTERVAL 2 DAY + INTERVAL 15 HOUR WHEN '3-MEDIUM' THEN day - INTERVAL 1 DAY + INTERVAL 8 HOUR
   WHEN '5-LOW' THEN CASE wd WHEN 0 THEN day - INTERVAL 3 DAY + INTERVAL 870 MINUTE WHEN 1 THEN day - INTERVAL 4 DAY + INTERVAL 930 MINUTE
     WHEN 6 THEN day - INTERVAL 3 DAY + INTERVAL 930 MINUTE ELSE day - INTERVAL 2 DAY + INTERVAL 870 MINUTE END END AS local FROM w)
SELECT p, block_start, timezone('UTC', timezone('Europe/Zurich', local)) AS gate_closure_utc,
  CASE p WHEN '1-URGENT' THEN 'week_tue_1300' WHEN '2-HIGH' THEN 'day_d-2_1500' WHEN '3-MEDIUM' THEN 'four_hour_d-1_0800' WHEN '5-LOW' THEN 'weekday_table' END AS gate_rule,
  CASE WHEN p = '4-NOT SPECIFIED' THEN NULL WHEN p = '3-MEDIUM' OR (p IN ('1-URGENT', '5-LOW') AND day >= TIMESTAMP '2000-01-01') THEN 'calendar' ELSE 'assumed' END AS gate_confidence
FROM g""")
def gate_closure(t):
    blocks = t("orders").select(F.col("o_orderpriority").alias("p"), T.local_to_utc("o_orderdate", "Europe/Zurich").alias("block_start")).distinct()
    return U.gate_closure(blocks, "block_start", GATES, "p", "Europe/Zurich")


# Gate closures as (days before delivery, local closing time) by delivery weekday.
WEEKDAY_TABLE = {0: (3, "14:30"), 1: (4, "15:30"), 2: (2, "14:30"), 3: (2, "14:30"), 4: (2, "14:30"), 5: (2, "14:30"), 6: (3, "15:30")}
GATES = {
    "1-URGENT": U.Gate("week_tue_1300", {None: (6, "13:00")}, "week", "2000-01-01"),
    "2-HIGH": U.Gate("day_d-2_1500", {None: (2, "15:00")}),
    "3-MEDIUM": U.Gate("four_hour_d-1_0800", {None: (1, "08:00")}, confirmed_from="1900-01-01"),
    "5-LOW": U.Gate("weekday_table", WEEKDAY_TABLE, confirmed_from="2000-01-01"),
}


@query("publication_times", """WITH d AS (SELECT DISTINCT o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS ts FROM orders),
l AS (SELECT ts, timezone('Europe/Zurich', timezone('UTC', ts)) AS wall FROM d)
SELECT ts, ts + INTERVAL 135 MINUTE AS observed,
  timezone('UTC', timezone('Europe/Zurich', date_trunc('month', wall) + INTERVAL 1 MONTH + INTERVAL 14 DAY)) AS monthly,
  greatest(timezone('UTC', timezone('Europe/Zurich', date_trunc('day', wall) + INTERVAL 2 DAY)), TIMESTAMP '1998-04-15') AS next_day,
  timezone('UTC', timezone('Europe/Zurich', date_trunc('day', wall) - INTERVAL 1 DAY + INTERVAL 780 MINUTE)) AS day_ahead,
  timezone('UTC', timezone('Europe/Zurich', date_trunc('week', wall) - INTERVAL 3 DAY + INTERVAL 18 HOUR)) AS week_ahead,
  timezone('UTC', timezone('Europe/Zurich', date_trunc('month', wall) - INTERVAL 7 DAY)) AS month_ahead,
  timezone('UTC', timezone('Europe/Zurich', CAST(make_date(year(wall) - 1, 12, 15) AS TIMESTAMP))) AS year_ahead
FROM l""")
def publication_times(t):
    tz = "Europe/Zurich"
    d = t("orders").select(T.plus("o_orderdate", F.col("o_orderkey") % 24 * T.HOUR).alias("ts")).distinct()
    return d.withColumns({
        "observed": U.published("ts", U.Rule("observed", "2 hours"), "15 minutes", tz),
        "monthly": U.published("ts", U.Rule("monthly"), "15 minutes", tz),
        "next_day": U.published("ts", U.Rule("next_day", not_before="1998-04-15"), "15 minutes", tz),
        "day_ahead": U.forecast_published("ts", "D-1 13:00", tz),
        "week_ahead": U.forecast_published("ts", "W-1 Fri 18:00", tz),
        "month_ahead": U.forecast_published("ts", "M-1 -7D", tz),
        "year_ahead": U.forecast_published("ts", "Y-1 15 Dec", tz)})


@query("auction_result_known", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
k AS (SELECT day, CAST(day AS TIMESTAMP) - INTERVAL 1 DAY AS auction FROM d)
SELECT day, timezone('UTC', timezone('Europe/Zurich', auction + CASE WHEN auction >= TIMESTAMP '1998-06-01' THEN INTERVAL 22 HOUR ELSE INTERVAL 1040 MINUTE END)) AS known,
  timezone('UTC', timezone('Europe/Zurich', CAST(day AS TIMESTAMP) - INTERVAL 1 DAY + INTERVAL 18 HOUR)) <= timezone('UTC', timezone('Europe/Zurich', CAST(day AS TIMESTAMP) - INTERVAL 6 HOUR)) AS known_by_evening
FROM k""")
def auction_result_known(t):
    tz = "Europe/Zurich"
    d = t("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    origin = T.local_to_utc(T.plus(F.col("day"), -6 * T.HOUR), tz)
    end = T.local_to_utc(T.plus(F.col("day"), T.DAY), tz)
    return d.withColumns({
        "known": U.result_known("day", [("1900-01-01", "17:00"), ("1998-06-01", "21:40")], "20 minutes", tz, 1),
        "known_by_evening": U.window_known(end, "15 minutes", "D-1 18:00", origin, tz)})


DICTIONARY = [
    {"column": "value", "aggregation_rule": "mean of interval", "flags": ""},
    {"column": "masked", "aggregation_rule": "mean", "flags": "flag_error"},
    {"column": "price", "aggregation_rule": "volume-weighted mean", "flags": "flag_error"},
    {"column": "volume", "aggregation_rule": "sum", "flags": ""},
    {"column": "peak", "aggregation_rule": "max", "flags": ""},
    {"column": "low", "aggregation_rule": "min", "flags": ""},
    {"column": "is_buy", "aggregation_rule": "any", "flags": ""},
    {"column": "event_type", "aggregation_rule": "mode", "flags": ""},
]


def event_measures(t):
    e = t("events")
    v = F.col("value")
    return e.select("ts", "user_id", "event_type", v, v.alias("masked"), v.alias("price"),
                    (F.col("event_id") % 7).cast("double").alias("volume"), v.alias("peak"), v.alias("low"),
                    (F.col("event_type") == "purchase").alias("is_buy"), (F.col("event_type") == "error").alias("flag_error"))


_PLAN_SQL = """count(*) AS n_rows, round(avg(value), 8) AS value, 1.0::DOUBLE AS value__coverage,
  round(avg(CASE WHEN event_type <> 'error' THEN value END), 8) AS masked, round(count(CASE WHEN event_type <> 'error' THEN value END) / count(*), 8)::DOUBLE AS masked__coverage,
  round(sum(CASE WHEN event_type <> 'error' THEN value END * (event_id % 7)) / nullif(sum(CASE WHEN event_type <> 'error' THEN event_id % 7 END), 0), 8) AS price,
  round(count(CASE WHEN event_type <> 'error' THEN value END) / count(*), 8)::DOUBLE AS price__coverage,
  CAST(sum(event_id % 7) AS DOUBLE) AS volume, 1.0::DOUBLE AS volume__coverage, max(value) AS peak, 1.0::DOUBLE AS peak__coverage,
  min(value) AS low, 1.0::DOUBLE AS low__coverage, bool_or(event_type = 'purchase') AS is_buy, 1.0::DOUBLE AS is_buy__coverage"""


@query("expost_block_agg", f"""WITH d AS (SELECT DISTINCT date_trunc('day', timezone('Europe/Zurich', timezone('UTC', ts))) AS day FROM events),
h AS (SELECT day + k * INTERVAL 4 HOUR AS s, day + (k + 1) * INTERVAL 4 HOUR AS e FROM d, (SELECT unnest(generate_series(0, 5)) AS k)
      UNION ALL SELECT day, day + INTERVAL 1 DAY FROM d),
w AS (SELECT DISTINCT timezone('UTC', timezone('Europe/Zurich', s)) AS block_start, timezone('UTC', timezone('Europe/Zurich', e)) AS block_end FROM h),
m AS (SELECT block_start, block_end, event_type, count(*) AS c FROM w JOIN events ON ts >= block_start AND ts < block_end GROUP BY ALL),
top AS (SELECT block_start, block_end, first(event_type ORDER BY c DESC, event_type) AS event_type FROM m GROUP BY ALL)
SELECT a.*, top.event_type, 1.0::DOUBLE AS event_type__coverage FROM (
  SELECT block_start, block_end, {_PLAN_SQL} FROM w JOIN events ON ts >= block_start AND ts < block_end GROUP BY 1, 2) a
JOIN top ON top.block_start = a.block_start AND top.block_end = a.block_end""")
def expost_block_agg(t):
    tz = "Europe/Zurich"
    plan = P.build_plan(DICTIONARY, {"price": "volume"})
    days = t("events").select(T.local_midnight(T.utc_to_local("ts", tz)).alias("day")).distinct()
    spans = [F.struct(F.lit(k * 4 * T.HOUR).alias("a"), F.lit((k + 1) * 4 * T.HOUR).alias("b")) for k in range(6)]
    spans.append(F.struct(F.lit(0).cast("long").alias("a"), F.lit(24 * T.HOUR).alias("b")))
    w = days.withColumn("x", F.explode(F.array(*spans))).select(
        T.local_to_utc(T.plus("day", F.col("x.a")), tz).alias("block_start"), T.local_to_utc(T.plus("day", F.col("x.b")), tz).alias("block_end"))
    out = I.window_aggregate(w, event_measures(t), "block_start", "block_end", "ts", P.expressions(plan))
    return rounded(out, 8)


@query("aggregation_plan_long", f"""WITH m AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), top AS (SELECT user_id, first(event_type ORDER BY c DESC, event_type) AS event_type FROM m GROUP BY 1)
SELECT a.*, top.event_type, 1.0::DOUBLE AS event_type__coverage FROM (SELECT user_id, {_PLAN_SQL} FROM events GROUP BY 1) a JOIN top USING (user_id)""")
def aggregation_plan_long(t):
    return rounded(P.aggregate_long(event_measures(t), ["user_id"], P.build_plan(DICTIONARY, {"price": "volume"})), 8)


@query("wide_pivot", """SELECT user_id, sum(value) FILTER (WHERE event_type = 'click') AS click, sum(value) FILTER (WHERE event_type = 'error') AS error,
  sum(value) FILTER (WHERE event_type = 'purchase') AS purchase, sum(value) FILTER (WHERE event_type = 'signup') AS signup, sum(value) FILTER (WHERE event_type = 'view') AS "view" FROM (SELECT user_id, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2) GROUP BY 1""")
def wide_pivot(t):
    return rounded(A.pivot_sum(t("events"), ["user_id"], "event_type", "value", ["click", "error", "purchase", "signup", "view"]), 4)


@query("smart_cast", r"""WITH s AS (SELECT o_orderkey, replace(replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', ','), '-', '') AS german,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_orderkey // 1000 AS VARCHAR) || '''' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS swiss FROM orders)
SELECT o_orderkey, CAST(replace(german, ',', '.') AS DOUBLE) AS german, TRY_CAST(replace(swiss, '''', '') AS DOUBLE) AS swiss, swiss = 'n/a' AS swiss_missing FROM s""")
def smart_cast(t):
    k = F.col("o_orderkey")
    swiss = F.when(k % 11 == 0, "n/a").otherwise(F.concat(F.floor(k / 1000).cast("string"), F.lit("'"), F.lpad((k % 1000).cast("string"), 3, "0")))
    raw = t("orders").select("o_orderkey", F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",").alias("g"), swiss.alias("s"))
    return raw.select("o_orderkey", X.number("g", decimal=",").alias("german"), X.number("s").alias("swiss"), X.is_null_token("s").alias("swiss_missing"))


@query("date_fallthrough", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END AS parsed FROM orders""")
def date_fallthrough(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd.MM.yyyy"))
            .when(k == 2, F.date_format(d, "MM/dd/yyyy")).otherwise("unknown"))
    return t("orders").select("o_orderkey", X.date_any(text, ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"]).alias("parsed"))


@query("delivery_codes", """WITH x AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 24 AS h FROM orders),
s AS (SELECT k, CASE k % 4 WHEN 0 THEN d + h * INTERVAL 1 HOUR WHEN 1 THEN d + h * INTERVAL 1 HOUR + INTERVAL 15 MINUTE
    WHEN 2 THEN d + h * INTERVAL 1 HOUR + INTERVAL 30 MINUTE ELSE d + (h // 4) * INTERVAL 4 HOUR END AS a,
  CASE k % 4 WHEN 0 THEN 60 WHEN 1 THEN 15 WHEN 2 THEN 30 END AS minutes, d + (h // 4 + 1) * INTERVAL 4 HOUR AS b FROM x),
z AS (SELECT k, a, timezone('UTC', timezone('Europe/Zurich', a)) AS u0, minutes, timezone('UTC', timezone('Europe/Zurich', b)) AS block_end FROM s),
u AS (SELECT k, minutes, block_end, CASE WHEN timezone('Europe/Zurich', timezone('UTC', u0 - INTERVAL 1 HOUR)) = a THEN u0 - INTERVAL 1 HOUR ELSE u0 END AS start_utc FROM z)
SELECT k AS o_orderkey, start_utc, CASE WHEN minutes IS NULL THEN block_end ELSE start_utc + minutes * INTERVAL 1 MINUTE END AS end_utc FROM u""")
def delivery_codes(t):
    k, h = F.col("o_orderkey"), F.col("o_orderkey") % 24
    block = F.floor(h / 4) * 4
    code = (F.when(k % 4 == 0, (h + 1).cast("string")).when(k % 4 == 1, F.concat((h + 1).cast("string"), F.lit("qh2")))
            .when(k % 4 == 2, F.concat((h + 1).cast("string"), F.lit("hh2")))
            .otherwise(F.concat(F.lit("NEG_"), F.lpad(block.cast("string"), 2, "0"), F.lit("_"), F.lpad((block + 4).cast("string"), 2, "0"))))
    w = X.delivery_window(code, "o_orderdate", "Europe/Zurich")
    return t("orders").select("o_orderkey", w["start"].alias("start_utc"), w["end"].alias("end_utc"))
