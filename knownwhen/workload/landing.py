"""Given tables written as landing files and lakes into the shared folder, and read back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import degree_hours as degrees
from ..operators.grid import trim
from ..session import checkpoint_folder
from ..sources import ingest as N
from ..sources import tables as B
from .registry import HOURLY, hourly, query, rounded


def folder(df: DataFrame, name: str) -> str:
    return f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_landing", """SELECT o_orderkey AS order_key, 'ü' || o_orderstatus AS mark, o_totalprice AS price, CAST(o_orderkey AS DOUBLE) AS price_2, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS bad FROM orders""")
def csv_landing(t):
    """Latin-1 files with semicolons, a comment line's mark, repeated header names and cells that are not numbers."""
    o = t("orders")
    path = folder(o, "csv")
    bad = F.col("o_orderkey") % 50 == 0
    text = o.select(F.col("o_orderkey").cast("string").alias("Order Key"), F.concat(F.lit("ü"), "o_orderstatus").alias("Märk"), F.col("o_totalprice").cast("string").alias("Price (+)"),
                    F.when(bad, "n/k").otherwise(F.col("o_orderkey").cast("string")).alias("Price %"))
    text.write.option("header", "true").option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    raw = N.snake_unique(N.read_csv(o.sparkSession, [path], ["Order Key", "Märk", "Price (+)", "Price %"], ";", "ISO-8859-1", comment="#"))
    numbers, counts = N.enforce_contract(raw.select("price_pos", "price_pct"), {"price_pos": ("price", "price"), "price_pct": ("share", "pct")}, headers={"price_pos": "Price (+)", "price_pct": "Price pct"})
    wrong = counts.where("column = 'share'").select(F.col("not_numeric").alias("wrong"))
    cast = N.cast_if_clean(raw, ["order_key", "price_pos", "price_pct"])  # one cell in fifty keeps the last column as text
    rows = cast.select(F.col("order_key").cast("long").alias("order_key"), F.col("maerk").alias("mark"), F.col("price_pos").alias("price"), F.col("price_pct"))
    rows = rows.withColumns({"bad": F.when(F.col("price_pct") == "n/k", 1).otherwise(0), "price_2": F.coalesce(F.col("price_pct").try_cast("double"), F.col("order_key").cast("double"))})
    checked = rows.crossJoin(F.broadcast(wrong)).withColumn("bad", F.when(F.col("wrong") > 0, F.col("bad")).otherwise(-1))
    return checked.select("order_key", "mark", "price", "price_2", "bad")


@query("contract_counts", """SELECT 'price' AS "column", 0::BIGINT AS not_numeric, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT 'share', count(*) FILTER (WHERE o_orderkey % 50 = 0), count(*) FILTER (WHERE o_orderkey % 50 <> 0), CAST(sum(CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END) AS DOUBLE) FROM orders""")
def contract_counts(t):
    """Cells that break the numeric contract, and what the contract lets through."""
    text = t("orders").select(F.col("o_totalprice").cast("string").alias("a"), F.when(F.col("o_orderkey") % 50 == 0, "n/k").otherwise(F.col("o_orderkey").cast("string")).alias("b"))
    values, counts = N.enforce_contract(text, {"a": ("price", "price"), "b": ("share", "share")}, headers={"a": "Price EUR", "b": "Share"})
    sums = values.unpivot([], ["price", "share"], "column", "v").groupBy("column").agg(F.count("v").alias("n"), F.round(F.sum(F.col("v").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    return counts.join(sums, "column")


@query("two_trees", f"""WITH {HOURLY} SELECT event_type, hour, CASE WHEN day(hour) % 3 = 0 THEN total + 1 ELSE total END AS v, CASE WHEN day(hour) % 3 = 0 THEN n END AS n FROM hourly""")
def two_trees(t):
    """A series from two trees of files; the later tree wins, and only it has the column ``n``."""
    h = hourly(t)
    first, second = folder(h, "tree"), folder(h, "tree")
    h.select("event_type", "hour", F.col("total").alias("v")).write.parquet(first)
    h.where(F.dayofmonth("hour") % 3 == 0).select("event_type", "hour", (F.col("total") + 1).alias("v"), "n").write.parquet(second)
    return B.scan_series(h.sparkSession, [[first], [second]], "hour", ["event_type"]).select("event_type", "hour", "v", "n")


@query("lake_views", """SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def lake_views(t):
    """A lake of two tables, queried through the views that its folders give."""
    n, r = t("nation"), t("region")
    root = folder(n, "lake")
    n.write.parquet(f"{root}/geo_{root[-8:]}/nation")
    r.write.parquet(f"{root}/geo_{root[-8:]}/region")
    names = B.register_views(n.sparkSession, root)
    nation, region = (next(x for x in names if x.endswith(e)) for e in ("nation", "region"))
    return n.sparkSession.sql(f"SELECT r_name, count(*) AS nations FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")


@query("partition_rewrite", """SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS rewritten FROM orders WHERE year(o_orderdate) <> 1997 OR o_orderkey % 2 = 0 GROUP BY 1""")
def partition_rewrite(t):
    """A table by year; a second write replaces the one year that it holds. A dry run changes nothing."""
    o = t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.lit(False).alias("again"))
    path = folder(o, "table")
    B.write_table(o, path, ["year"], sort_by=["o_orderkey"], dry_run=False)
    part = o.where((F.col("year") == 1997) & (F.col("o_orderkey") % 2 == 0)).withColumn("again", F.lit(True))
    B.write_table(part.limit(0), path, ["year"], dry_run=True)
    B.write_table(part, path, ["year"], sort_by=["o_orderkey"], dry_run=False)
    return o.sparkSession.read.schema("o_orderkey long, again boolean, year int").parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("rewritten"))


@query("trim_sample", """SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def trim_sample(t):
    return trim(t("events"), "ts", "2024-01-10", "2024-01-20").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("degree_hours", f"""WITH {HOURLY}, x AS (SELECT event_type, CAST(hour AS DATE) AS day, CASE WHEN hour(hour) % 7 = 0 THEN NULL ELSE value - 35 END AS v FROM hourly)
SELECT event_type, day, round(sum(greatest(18 - v, 0)), 5) AS heating, round(sum(greatest(v - 22, 0)), 5) AS cooling, round(sum(greatest(v, 0)), 5) AS melt FROM x WHERE v IS NOT NULL GROUP BY 1, 2""")
def degree_hours(t):
    x = hourly(t).withColumns({"day": F.col("hour").cast("date"), "v": F.when(F.hour("hour") % 7 != 0, F.col("value") - 35)})
    sums = x.withColumns(degrees("v")).where(F.col("v").isNotNull()).groupBy("event_type", "day").agg(*[F.sum(c).alias(c) for c in ("heating", "cooling", "melt")])
    return rounded(sums, 5)
