"""Bid policies and their ex-ante parameter choice, pooled panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import evaluate as E
from ..session import cut_lineage
from .evaluation import PREDS, naive_predictions
from .registry import DAILY_ORDERS, daily_orders, query, rounded

# Offsets and quantile levels of the bids that are tried.
K = [0.6, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5, 1.75, 2.0, 2.5, 3.0]
LEVELS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
GRID = [(f"t{round(100 * level):02d}xk{k:g}", i, k) for i, level in enumerate(LEVELS) for k in K]


def auctions(t):
    """Naive bids per (priority, day) beside the highest accepted price of the day."""
    top = t("orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day")).agg(
        (F.max("o_totalprice") / 1083.7).alias("c"))
    return naive_predictions(t).join(top, ["priority", "day"])


AUCTIONS = f"""{PREDS}, top AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) / 1083.7::DOUBLE AS c FROM orders GROUP BY 1, 2),
auctions AS (SELECT preds.*, c FROM preds JOIN top ON top.priority = preds.priority AND top.day = preds.day)"""


@query("policy_backtest", f"""WITH {AUCTIONS}, u AS (SELECT priority, year(day) AS year, c, 'oracle' AS policy, c AS bid FROM auctions UNION ALL SELECT priority, year(day), c, 'prev_slot', prev_slot FROM auctions UNION ALL SELECT priority, year(day), c, 'roll_med', roll_med FROM auctions),
r AS (SELECT *, CASE WHEN bid IS NOT NULL AND greatest(bid, 0) <= c + 1e-9 THEN greatest(bid, 0) ELSE 0 END AS rev, CASE WHEN bid IS NOT NULL AND greatest(bid, 0) <= c + 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS won FROM u)
SELECT priority, year, policy, count(*) AS n, round(avg(rev), 6) AS revenue, round(avg(won), 6) AS win_rate, round(sum(rev) / sum(c), 6) AS share_of_oracle, round(avg(c) - avg(rev), 6) AS value_loss, round(avg(bid), 6) AS mean_bid FROM r GROUP BY 1, 2, 3""")
def policy_backtest(t):
    a = auctions(t).withColumns({"year": F.year("day"), "oracle": F.col("c")})
    return rounded(E.policy_backtest(a, ["priority", "year"], "c", ["oracle", "prev_slot", "roll_med"]))


_CHOICE = f"""{AUCTIONS}, k AS (SELECT unnest({K})::DOUBLE AS k), mo AS (SELECT DISTINCT priority, date_trunc('month', start) AS month FROM auctions),
p AS (SELECT mo.priority, mo.month, k.k, count(*) AS n, avg(CASE WHEN roll_med * k.k <= c + 1e-9 THEN roll_med * k.k ELSE 0 END) AS r FROM mo CROSS JOIN k JOIN auctions a ON a.priority = mo.priority AND a.start + INTERVAL 24 HOUR <= mo.month AND a.start >= mo.month - INTERVAL 90 DAY AND roll_med IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT priority, month, max(n) AS n, CASE WHEN max(n) >= 40 THEN arg_max(k, (r, -k)) ELSE 1.0 END AS k FROM p GROUP BY 1, 2)"""


@query("choose_monthly", f"""WITH {_CHOICE} SELECT a.priority, a.day, regexp_replace(CAST(coalesce(b.k, 1.0)::DOUBLE AS VARCHAR), '[.]0$', '') AS chosen, round(roll_med * coalesce(b.k, 1.0), 6) AS bid, coalesce(b.n, 0) AS n_past
FROM auctions a LEFT JOIN b ON b.priority = a.priority AND b.month = date_trunc('month', a.start)""")
def choose_monthly(t):
    cands = {f"{k:g}": F.col("roll_med") * k for k in K}
    out = E.choose_monthly(auctions(t), ["priority"], "start", "c", cands, "1", 90, 40)
    return rounded(out.select("priority", "day", "chosen", "bid", "n_past"))


@query("chosen_policy_value", f"""WITH {_CHOICE} SELECT a.priority, count(*) AS n, round(avg(CASE WHEN roll_med * coalesce(b.k, 1.0) <= c + 1e-9 THEN roll_med * coalesce(b.k, 1.0) ELSE 0 END), 6) AS revenue, round(avg(CASE WHEN roll_med <= c + 1e-9 THEN roll_med ELSE 0 END), 6) AS revenue_plain
FROM auctions a LEFT JOIN b ON b.priority = a.priority AND b.month = date_trunc('month', a.start) GROUP BY 1""")
def chosen_policy_value(t):
    cands = {f"{k:g}": F.col("roll_med") * k for k in K}
    out = E.choose_monthly(auctions(t), ["priority"], "start", "c", cands, "1", 90, 40)
    return rounded(out.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.avg(E.revenue("bid", "c")).alias("revenue"), F.avg(E.revenue("roll_med", "c")).alias("revenue_plain")))


@query("quantile_bid_choice", f"""WITH {DAILY_ORDERS}, q AS MATERIALIZED (SELECT d.priority, CAST(d.day AS TIMESTAMP) AS start, d.price AS c, CASE WHEN count(p.price) >= 30 THEN quantile_cont(p.price, {LEVELS}) END AS t
  FROM daily d LEFT JOIN daily p ON p.priority = d.priority AND p.day < d.day AND p.day >= d.day - INTERVAL 60 DAY GROUP BY 1, 2, 3),
g AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {j}, {i + 1}, {k}::DOUBLE)" for j, (name, i, k) in enumerate(GRID))}) AS v(name, j, i, k)),
u AS MATERIALIZED (SELECT priority, start, c, name, j, t[i] * k AS bid FROM q CROSS JOIN g),
mo AS (SELECT DISTINCT priority, date_trunc('month', start) AS month FROM q), p AS (SELECT mo.priority, mo.month, name, j, count(*) AS n, avg(CASE WHEN bid <= c + 1e-9 THEN bid ELSE 0 END) AS r FROM mo JOIN u ON u.priority = mo.priority AND u.start + INTERVAL 24 HOUR <= mo.month AND u.start >= mo.month - INTERVAL 90 DAY AND bid IS NOT NULL GROUP BY 1, 2, 3, 4),
b AS (SELECT priority, month, CASE WHEN max(n) >= 40 THEN arg_max(name, (r, -j)) ELSE 't50xk1' END AS name FROM p GROUP BY 1, 2)
SELECT u.priority, CAST(u.start AS DATE) AS day, u.name AS chosen, round(u.bid, 6) AS bid FROM u LEFT JOIN b ON b.priority = u.priority AND b.month = date_trunc('month', u.start) WHERE u.name = coalesce(b.name, 't50xk1')""")
def quantile_bid_choice(t):
    from ..operators.sequences import rolling_thresholds

    d = daily_orders(t)
    q = rolling_thresholds(d, ["priority"], "day", "price", {f"_t{i}": level for i, level in enumerate(LEVELS)}, 60, 30)
    x = cut_lineage(d.join(q.drop("n_past"), ["priority", "day"]).withColumns({"start": F.col("day").cast("timestamp_ntz"), "c": F.col("price")}))
    out = E.choose_monthly(x, ["priority"], "start", "c", {name: F.col(f"_t{i}") * k for name, i, k in GRID}, "t50xk1", 90, 40)
    return rounded(out.select("priority", "day", "chosen", "bid"))


@query("fixed_window_bids", f"""WITH {DAILY_ORDERS}, b AS (SELECT priority, day, CAST(day AS TIMESTAMP) AS start, price FROM daily), k AS (SELECT priority, start + INTERVAL 24 HOUR AS t, price FROM b)
SELECT b.priority, b.day, CASE WHEN max(k.t) >= b.start - INTERVAL 4 HOUR THEN round(quantile_cont(k.price, 0.5) FILTER (WHERE k.t > x.t - INTERVAL 1 DAY), 6) END AS fixed_1d, CASE WHEN max(k.t) >= b.start - INTERVAL 4 HOUR THEN round(quantile_cont(k.price, 0.5) FILTER (WHERE k.t > x.t - INTERVAL 7 DAY), 6) END AS fixed_7d,
  CASE WHEN max(k.t) >= b.start - INTERVAL 4 HOUR THEN round(quantile_cont(k.price, 0.5) FILTER (WHERE k.t > x.t - INTERVAL 30 DAY), 6) END AS fixed_30d
FROM b ASOF LEFT JOIN k x ON x.priority = b.priority AND b.start >= x.t LEFT JOIN k ON k.priority = b.priority AND k.t <= x.t AND k.t > x.t - INTERVAL 30 DAY GROUP BY b.priority, b.day, b.start""")
def fixed_window_bids(t):
    b = daily_orders(t).select("priority", "day", F.col("day").cast("timestamp_ntz").alias("start"), "price")
    out = E.fixed_window_bids(b, ["priority"], "start", "price", [1, 7, 30], chunk="365 days")
    return rounded(out.select("priority", "day", "fixed_1d", "fixed_7d", "fixed_30d"))


@query("pooled_panel", f"""WITH {DAILY_ORDERS}, p AS (SELECT priority AS series, day, price FROM daily),
s AS (SELECT series, stddev_samp(price) AS scale FROM p WHERE day >= DATE '1999-01-01' GROUP BY 1)
SELECT series, day, round(price / scale, 6) AS scaled FROM p JOIN s USING (series)""")
def pooled_panel(t):
    d = daily_orders(t).withColumn("start", F.col("day").cast("timestamp_ntz"))
    part = lambda k: d.where(F.col("priority") == k).select("day", "start", "price")
    out = E.pool({k: part(k) for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}, "price", "start", "1999-01-01")
    return rounded(out.select("series", "day", (F.col("price") / F.col("scale")).alias("scaled")))


@query("bid_moving_block_ci", f"""WITH {AUCTIONS}, d AS (SELECT priority, day, CASE WHEN roll_med IS NOT NULL AND roll_med <= c + 1e-9 THEN roll_med ELSE 0 END - CASE WHEN prev_slot IS NOT NULL AND prev_slot <= c + 1e-9 THEN prev_slot ELSE 0 END AS x FROM auctions),
i AS (SELECT priority, x, row_number() OVER (PARTITION BY priority ORDER BY day) AS i, count(*) OVER (PARTITION BY priority) AS n FROM d), z AS (SELECT DISTINCT priority, n FROM i),
k AS (SELECT priority, n, b, k, CAST('0x' || substr(md5('9|' || b || '|' || k), 1, 8) AS BIGINT) % greatest(n - 42, 1) AS a FROM z, (SELECT unnest(generate_series(0, 39)) AS b), LATERAL (SELECT unnest(generate_series(0, CAST(ceil(n / 42) AS BIGINT) - 1)) AS k)),
m AS (SELECT k.priority, k.b, sum(i.x) / any_value(k.n) AS m FROM k JOIN i ON i.priority = k.priority AND i.i > k.a AND i.i <= least(k.a + least(42, k.n - k.k * 42), k.n) GROUP BY 1, 2)
SELECT m.priority, any_value(e.n) AS n, round(any_value(e.est), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m JOIN (SELECT priority, count(*) AS n, avg(x) AS est FROM d GROUP BY 1) e USING (priority) GROUP BY 1""")
def bid_moving_block_ci(t, draws=40):
    from ..operators.stats import moving_block_bootstrap

    a = cut_lineage(auctions(t).withColumn("x", E.revenue("roll_med", "c") - E.revenue("prev_slot", "c")).select("priority", "day", "x"))
    return rounded(moving_block_bootstrap(a, ["priority"], "day", "x", 42, draws, 9))
