"""Query registration and the input shapes shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeaxis import floor_time
from ..session import WIDE, cut_lineage, spread, utc_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(t)`` where ``t(table)`` reads one of the given tables."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            utc_session(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- shared shapes
# Exchange rate of the derived price columns; means in the new currency are never exact decimals,
# so rounding them gives the same digits whatever the order of summation.
RATE = 1.0837


def exact_sum(name: str) -> Column:
    """Sum of two-decimal amounts that does not depend on the order of the rows."""
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double")


def hourly(t) -> DataFrame:
    """events -> one row per (event_type, hour) that has events; value is the converted mean."""
    per = (t("events").groupBy("event_type", floor_time("ts", "1 hour").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total"))
            .select("event_type", "hour", "n", (F.col("total") / F.col("n") / RATE).alias("value"), "total"))
    return cut_lineage(per)


HOURLY = """hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) / 1.0837::DOUBLE AS value, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
  FROM events GROUP BY 1, 2)"""


def daily_orders(t) -> DataFrame:
    """orders -> one row per (priority, day): number, mean price (thousands, converted), total."""
    per = (t("orders").groupBy(F.col("o_orderpriority").alias("priority"),
                                F.col("o_orderdate").cast("date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total"))
            .select("priority", "day", "n", (F.col("total") / F.col("n") / (1000 * RATE)).alias("price"), "total"))
    return cut_lineage(per)


DAILY_ORDERS = """daily AS (
  SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) / (1000 * 1.0837::DOUBLE) AS price,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
  FROM orders GROUP BY 1, 2)"""


def units(t) -> DataFrame:
    """lineitem joined to orders -> bitemporal intervals of a unit with a knowledge time."""
    ship = F.col("l_shipdate")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice")
    # Both sides are dealt widely, so that the sorts of the join fit in memory whatever the tables hold.
    return (spread(lines, "l_orderkey", least=WIDE).join(spread(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey", least=WIDE), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("kind"),
                    ship.cast("timestamp_ntz").alias("start"),
                    (ship + F.make_dt_interval(F.col("l_linenumber"))).cast("timestamp_ntz").alias("stop"),
                    F.col("l_quantity").alias("mw"), F.col("o_orderdate").alias("created"),
                    "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


UNITS = """units AS (
  SELECT l_suppkey AS unit, l_returnflag AS kind, CAST(l_shipdate AS TIMESTAMP) AS start,
         CAST(l_shipdate AS TIMESTAMP) + l_linenumber * INTERVAL 1 DAY AS stop, l_quantity AS mw,
         o_orderdate AS created, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def swept(name: str, source: str, by: str, y: str, regressors: list[str], keep: str = "", weight: str = "1") -> str:
    """SQL: CTEs ``{name}0 ...`` that sweep one regressor after another out of y and the regressors after it.

    After step k, ``y`` is the residual on the first k regressors; ``{name}c{k}`` holds the coefficient of regressor k in a
    regression on the first k. Regressors that are swept to nothing count as absent. Rows of weight 0 are swept along without a say.
    """
    keep = f", {keep}" if keep else ""
    rest = lambda k: [y, *regressors[k:]]
    out = [f"{name}0 AS (SELECT {by}{keep}, {', '.join(rest(0))} FROM {source})"]
    for k, r in enumerate(regressors):
        later = rest(k + 1)
        out.append(f"{name}c{k + 1} AS (SELECT {by}, {', '.join(f'coalesce(sum({weight} * {r} * {c}) / nullif(sum({weight} * {r} * {r}), 0), 0) AS b_{c}' for c in later)} FROM {name}{k} GROUP BY {by})")
        out.append(f"{name}{k + 1} AS (SELECT t.{by}{keep}, {', '.join(f't.{c} - b_{c} * t.{r} AS {c}' for c in later)} FROM {name}{k} t JOIN {name}c{k + 1} c ON c.{by} = t.{by})")
    return ",\n".join(out)


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Rounds the named (default: all DOUBLE) output columns after aggregation."""
    doubles = set(names) or {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.round(F.col(f).cast("double"), digits).alias(f) if f in doubles else F.col(f)
                       for f in df.columns])
