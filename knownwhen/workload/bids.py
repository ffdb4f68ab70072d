"""Bids, tenders, trades, revisions and supply / demand curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ordered as O
from ..session import WIDE, spread
from .registry import query, rounded



def bids(t):
    li = t("lineitem")
    return li.select("*", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                     F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("awarded"),
                     F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0).alias("settle"))


_BIDS = """bids AS (SELECT *, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS awarded,
  round(l_extendedprice / l_quantity, 0) AS settle FROM lineitem)"""


@query("auction_summary", f"""WITH {_BIDS}
SELECT l_orderkey, count(*) AS n_bids, count(awarded) AS n_accepted, sum(l_quantity) AS offered_mw, sum(awarded) AS awarded_mw,
  round(min(CASE WHEN awarded > 0 THEN price END), 6) AS price_bid_min, round(max(CASE WHEN awarded > 0 THEN price END), 6) AS price_bid_max,
  max(CASE WHEN awarded > 0 THEN settle END) AS price_settle_max, round(avg(CASE WHEN awarded > 0 THEN settle END), 6) AS price_settle_mean,
  count(DISTINCT CASE WHEN awarded > 0 THEN settle END) AS n_settle_prices,
  round(sum(price * awarded) / sum(awarded), 6) AS price_bid_vwap, round(sum(settle * awarded), 6) AS cost FROM bids GROUP BY 1""")
def auction_summary(t):
    return rounded(A.summarize_auctions(bids(t), ["l_orderkey"], "l_quantity", "awarded", "price", "settle", F.col("awarded") > 0))


@query("bid_period_summary", f"""WITH {_BIDS}, b AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS direction FROM bids)
SELECT l_shipdate, direction, count(*) AS n_bids, count(awarded) AS n_activated, sum(l_quantity) AS offered_mw, sum(awarded) AS activated_mw,
  round(min(price), 6) AS price_min, round(max(price), 6) AS price_max, round(sum(price * awarded) / sum(awarded), 6) AS act_price_vwap,
  round(CASE WHEN direction = 'up' THEN max(CASE WHEN awarded > 0 THEN price END) ELSE min(CASE WHEN awarded > 0 THEN price END) END, 6) AS act_price_marginal
FROM b GROUP BY 1, 2""")
def bid_period_summary(t):
    b = bids(t).withColumn("direction", F.when(F.col("l_linestatus") == "O", "up").otherwise("down"))
    return rounded(A.summarize_bids(b, ["l_shipdate"], "direction", "l_quantity", "awarded", "price"))


@query("combine_tenders", """WITH b AS (SELECT l_orderkey, l_returnflag AS tender, count(*) AS n, sum(l_quantity) AS mw, sum(l_extendedprice) / sum(l_quantity) AS price,
  min(l_extendedprice) AS low, max(l_extendedprice) AS high, CASE WHEN max(l_linenumber) > 5 THEN sum(l_quantity) END AS cost FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS n_tenders, round(CASE WHEN count(*) = 1 THEN first(price) ELSE sum(price * mw) / sum(mw) END, 6) AS price, sum(mw) AS mw, sum(cost) AS cost,
  min(low) AS low, max(high) AS high, min_by(n, tender) AS n, string_agg(tender, '+' ORDER BY tender) AS tender FROM b GROUP BY 1""")
def combine_tenders(t):
    q = F.col("l_quantity")
    b = t("lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("tender")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("mw"), (F.sum("l_extendedprice") / F.sum(q)).alias("price"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.when(F.max("l_linenumber") > 5, F.sum(q)).alias("cost"))
    out = A.combine_groups(b.withColumn("rank", F.col("tender")), ["l_orderkey"], "rank", "mw", ["price"], ["mw", "cost"], ["low"], ["high"],
                           ["n"], "tender", "n_tenders")
    return rounded(out)


@query("curve_crossing", """WITH b AS (SELECT date_trunc('month', l_shipdate) AS month, CASE WHEN l_returnflag = 'A' THEN 'sell' ELSE 'buy' END AS side,
   floor(l_extendedprice / l_quantity / 20) * 20 AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT month, side, p, CASE WHEN side = 'sell' THEN sum(q) OVER (PARTITION BY month, side ORDER BY p) ELSE sum(q) OVER (PARTITION BY month, side ORDER BY p DESC) END AS v FROM b),
g AS (SELECT month, p, max(CASE WHEN side = 'sell' THEN v END) AS s, max(CASE WHEN side = 'buy' THEN v END) AS d FROM c GROUP BY 1, 2),
i AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN p END IGNORE NULLS) OVER lo AS slp, last_value(s IGNORE NULLS) OVER lo AS slv,
   first_value(CASE WHEN s IS NOT NULL THEN p END IGNORE NULLS) OVER hi AS shp, first_value(s IGNORE NULLS) OVER hi AS shv,
   last_value(CASE WHEN d IS NOT NULL THEN p END IGNORE NULLS) OVER lo AS dlp, last_value(d IGNORE NULLS) OVER lo AS dlv,
   first_value(CASE WHEN d IS NOT NULL THEN p END IGNORE NULLS) OVER hi AS dhp, first_value(d IGNORE NULLS) OVER hi AS dhv
   FROM g WINDOW lo AS (PARTITION BY month ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY month ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT month, p, s, d, coalesce(s, slv + (shv - slv) / nullif(shp - slp, 0) * (p - slp), slv, shv) AS sv, coalesce(d, dlv + (dhv - dlv) / nullif(dhp - dlp, 0) * (p - dlp), dlv, dhv) AS dv FROM i),
e AS (SELECT *, max(sv - dv) OVER (PARTITION BY month ORDER BY p) AS e FROM x),
l AS (SELECT *, lag(e) OVER w AS e0, lag(p) OVER w AS p0, lag(sv) OVER w AS s0 FROM e WINDOW w AS (PARTITION BY month ORDER BY p)),
k AS (SELECT unnest([0, 100, 500, -100, -500])::DOUBLE AS k),
f AS (SELECT month, k, coalesce(max(CASE WHEN e >= k AND (e0 IS NULL OR e0 < k) THEN CASE WHEN e0 IS NULL THEN p ELSE p0 + (k - e0) * (p - p0) / (e - e0) END END), max(p)) AS pe FROM l, k GROUP BY 1, 2),
z AS (SELECT month, max(CASE WHEN k = 0 THEN pe END) AS p, max(CASE WHEN k = 100 THEN pe END) AS p1, max(CASE WHEN k = 500 THEN pe END) AS p5, max(CASE WHEN k = -100 THEN pe END) AS m1, max(CASE WHEN k = -500 THEN pe END) AS m5 FROM f GROUP BY 1),
q AS (SELECT z.month, coalesce(max(CASE WHEN l.p >= z.p AND (l.p0 IS NULL OR l.p0 < z.p) THEN CASE WHEN l.p0 IS NULL THEN sv ELSE s0 + (sv - s0) * (z.p - p0) / (l.p - p0) END END)) AS q,
   max(s) AS smax, max(d) AS dmax, min(s) AS smin, min(d) AS dmin, count(s) AS ns, count(d) AS nd FROM z JOIN l ON l.month = z.month GROUP BY 1)
SELECT z.month, round(z.p, 4) AS p, round(q.q, 4) AS q, round(p1 - z.p, 4) AS dp_p100, round(p5 - z.p, 4) AS dp_p500, round(m1 - z.p, 4) AS dp_m100, round(m5 - z.p, 4) AS dp_m500,
  round(smax - q.q, 4) AS sell_room, round(dmax - q.q, 4) AS buy_room, smin AS sell_inelastic, dmin AS buy_inelastic FROM z JOIN q ON q.month = z.month WHERE ns >= 2 AND nd >= 2""")
def curve_crossing(t):
    li = t("lineitem")
    b = li.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"),
                   F.when(F.col("l_returnflag") == "A", "sell").otherwise("buy").alias("side"),
                   (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 20) * 20).alias("p")).agg(F.sum("l_quantity").alias("q"))
    b = b.withColumn("axis", F.when(F.col("side") == "sell", F.col("p")).otherwise(-F.col("p")))
    c = O.running(b, ["month", "side"], "axis", {"v": F.col("q")}, chunk=1000)
    return rounded(A.curve_features(c, ["month"], "side", "p", "v"), 4)


@query("dedup_last", """SELECT l_orderkey, l_linenumber, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_quantity, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2""")
def dedup_last(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    out = A.dedup(li, ["l_orderkey", "l_linenumber"], F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("latest_revision", """WITH d AS (SELECT l_orderkey AS doc, l_linenumber AS revision, l_returnflag AS status, l_quantity, l_partkey FROM lineitem WHERE l_returnflag <> 'N'),
m AS (SELECT doc, max(revision) AS top FROM d GROUP BY 1)
SELECT d.doc, d.revision, d.status, d.l_quantity, d.l_partkey FROM d JOIN m ON m.doc = d.doc AND m.top = d.revision""")
def latest_revision(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("revision"), F.col("l_returnflag").alias("status"), "l_quantity", "l_partkey")
    return A.latest_revision(d, "doc", "revision", "status", ["N"])


@query("revision_stats", """WITH d AS (SELECT l_returnflag AS kind, l_orderkey AS doc, l_linenumber AS revision, o_orderdate AS created, l_shipdate AS starts FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT kind, doc, count(DISTINCT revision) AS r, bool_or(revision = 1) AS o, min(created) AS c, min(starts) AS s FROM d GROUP BY 1, 2)
SELECT kind, count(*) AS documents, round(avg(r), 6) AS mean_revisions, round(avg(CASE WHEN o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_original, round(avg(CASE WHEN c <= s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_ex_ante,
  round(avg((epoch(s) - epoch(c)) / 3600), 4) AS mean_lead_hours FROM p GROUP BY 1""")
def revision_stats(t):
    # Dealt widely by document before the join: the operator asks for the same exchange and finds it.
    lines = spread(t("lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_shipdate"), "l_orderkey", least=WIDE)
    orders = spread(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey", least=WIDE)
    d = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("revision"),
        F.col("o_orderdate").alias("created"), F.col("l_shipdate").alias("starts"))
    return rounded(rounded(A.revision_stats(d, "doc", "revision", "created", "starts", ["kind"]), 4, "mean_lead_hours"), 6)


@query("publication_lag", """WITH d AS (SELECT s_nationkey AS zone, strftime(l_shipdate, '%Y-%m') AS month, (epoch(o_orderdate) - epoch(l_shipdate)) / 86400 AS lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT zone, month, quantile_cont(lag, 0.5) AS median_lag_days, quantile_cont(lag, 0.5) > 30 AS late FROM d GROUP BY 1, 2""")
def publication_lag(t):
    d = (t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
         .join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
         .select(F.col("s_nationkey").alias("zone"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_shipdate", "o_orderdate"))
    return A.lag_profile(d, ["zone", "month"], "l_shipdate", "o_orderdate", 30)


@query("distinct_documents", """WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_suppkey, count(*) AS documents FROM d GROUP BY 1""")
def distinct_documents(t):
    return t("lineitem").dropDuplicates(["l_orderkey", "l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("documents"))
