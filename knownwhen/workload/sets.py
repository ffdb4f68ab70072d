"""Set operations on keys and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Y
from ..operators.grid import span_grid
from .registry import HOURLY, hourly, query


@query("union_distinct", """SELECT l_suppkey AS unit, CAST(l_shipdate AS DATE) AS day FROM lineitem UNION SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders""")
def union_distinct(t):
    a = t("lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_shipdate").cast("date").alias("day"))
    return a.union(t("orders").select("o_custkey", F.col("o_orderdate").cast("date"))).distinct()


@query("missing_buckets", f"""WITH {HOURLY}, b AS (SELECT min(hour) AS a, max(hour) AS z FROM hourly), g AS (SELECT event_type, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b, (SELECT DISTINCT event_type FROM hourly))
SELECT event_type, hour FROM g EXCEPT SELECT event_type, hour FROM hourly""")
def missing_buckets(t):
    h = hourly(t)
    return Y.missing_buckets(span_grid(h, "hour", "1 hour", ["event_type"]), h, ["event_type", "hour"])


@query("common_keys", """SELECT hour FROM (SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'click' INTERSECT SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'view' INTERSECT SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'error' INTERSECT SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'purchase' INTERSECT SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'signup')""")
def common_keys(t):
    h = hourly(t)
    first, *rest = [h.where(F.col("event_type") == k).select("hour") for k in ("click", "view", "error", "purchase", "signup")]
    for hours in rest:
        first = first.intersect(hours)
    return first


@query("except_all_rows", """SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_tax < 0.05 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_discount < 0.05""")
def except_all_rows(t):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    li = t("lineitem")
    return li.where(F.col("l_tax") < 0.05).select(*cols).exceptAll(li.where(F.col("l_discount") < 0.05).select(*cols))
