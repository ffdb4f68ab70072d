"""Streaming queries over tables that land slice by slice, partly late.

A given table is written to a folder in slices, and each slice is taken by its own run of the query from the checkpoint of the run
before, as a job that wakes up for new files. Windows are appended once the watermark has passed them; rows that come later than that are
lost to them, and the SQL beside each query leaves out exactly those rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..session import checkpoint_folder, utc_session
from ..streaming import intervals as L
from .registry import ORACLES, QUERIES, RATE, rounded

SLICES = 6


def late_events(events: DataFrame) -> Column:
    """The slice an event lands in: sixths of the time span, but one in eleven of a slice's last 12 hours comes one slice later, and one
    in 97 of those before a slice's last two days two slices later."""
    us, lo, hi = T.micros("ts"), F.col("lo"), F.col("hi")
    width = hi - lo + 1
    own = T.floor_div(SLICES * (us - lo), width)
    left = lo + T.floor_div((own + 1) * width, SLICES) - us
    day = T.MICROS["day"]
    late = F.when((F.col("event_id") % 97 == 0) & (left > 2 * day), 2).when((F.col("event_id") % 11 == 0) & (left < day / 2), 1).otherwise(0)
    return F.least(F.lit(SLICES - 1), own + late)


LANDED = f"""lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
own AS (SELECT events.*, epoch_us(ts) AS us, lo, hi, ({SLICES} * (epoch_us(ts) - lo)) // (hi - lo + 1) AS own FROM events, lim),
rest AS (SELECT *, lo + ((own + 1) * (hi - lo + 1)) // {SLICES} - us AS remains FROM own),
landed AS (SELECT *, least({SLICES - 1}, own + CASE WHEN event_id % 97 = 0 AND remains > 172800000000 THEN 2 WHEN event_id % 11 = 0 AND remains < 43200000000 THEN 1 ELSE 0 END) AS slice FROM rest)"""


def marks(source: str, delay: int) -> str:
    """SQL: per slice the watermark that its rows meet (``late``), and the last one (``final``), in microseconds; ``delay`` in seconds."""
    return f"""top AS (SELECT slice, max(us // 1000 * 1000) - {delay}000000 AS top FROM {source} GROUP BY 1),
mark AS (SELECT slice, coalesce(max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late, max(top) OVER () AS final FROM top)"""


def landings(events: DataFrame, ts: str = "ts") -> DataFrame:
    span = events.agg(F.min(T.micros(ts)).alias("lo"), F.max(T.micros(ts)).alias("hi"))
    return events.crossJoin(F.broadcast(span)).withColumn("_kw_slice", late_events(events)).drop("lo", "hi")


def replay(table: DataFrame, slices: int, name: str, run: Callable[[DataFrame, str], object]) -> None:
    """Lands the slices of ``table`` (column ``_kw_slice``) one by one and calls ``run(stream, state folder)`` after each."""
    spark = table.sparkSession
    base = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.partitionBy("_kw_slice").parquet(f"{base}/all")
    parts = spark.read.schema(table.schema).parquet(f"{base}/all")
    stream_schema = table.drop("_kw_slice").schema
    for k in range(slices):
        parts.where(F.col("_kw_slice") == k).drop("_kw_slice").write.mode("append").parquet(f"{base}/landed")
        run(spark.readStream.schema(stream_schema).parquet(f"{base}/landed"), base)


def appended(table: DataFrame, slices: int, build: Callable[[DataFrame], DataFrame], progress: list | None = None) -> DataFrame:
    """Rows that ``build(stream)`` has appended after all slices. ``progress`` receives the reports of the micro-batches."""
    out: dict = {}

    def run(stream: DataFrame, base: str) -> None:
        rows = build(stream)
        out["schema"], out["path"] = rows.schema, f"{base}/out"

        def keep(batch: DataFrame, number: int) -> None:  # a batch that is run again replaces its own rows
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        q = rows.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if progress is not None:
            progress.extend(q.recentProgress)

    replay(table, slices, "stream", run)
    return table.sparkSession.read.schema(out["schema"]).parquet(f"{out['path']}/*")


def stream_query(name: str, sql: str):
    """Registers ``fn(stream)`` over the landed events."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            utc_session(spark)
            return rounded(appended(landings(spark.read.parquet(f"{sf_dir}/events.parquet")), SLICES, fn))

        QUERIES[name] = run
        ORACLES[name] = sql
        return fn

    return register


@stream_query("stream_interval_features", f"""WITH {LANDED}, {marks('landed', 86400)},
x AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, value - 50 AS v FROM landed JOIN mark USING (slice)
      WHERE epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) + 900000000 > late AND epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) + 900000000 <= final)
SELECT event_type, bucket, count(*) AS n, round(avg(v), 6) AS mean, round(avg(abs(v)), 6) AS mean_abs, round(CASE WHEN count(*) > 1 THEN stddev_samp(v) END, 6) AS std, round(max(abs(v)), 6) AS max_abs, round(min(v), 6) AS low, round(max(v), 6) AS high,
  round(sum(greatest(least(v, 200.0), 0.0) / 200), 6) AS up_equivalent, round(sum(greatest(least(-v, 200.0), 0.0) / 200), 6) AS down_equivalent, round(avg(CASE WHEN abs(v) > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_outside_50, round(count(*) / 4, 6) AS coverage FROM x GROUP BY 1, 2""")
def stream_interval_features(stream):
    return L.interval_features(stream, ["event_type"], "ts", F.col("value") - 50, "15 minutes", "1 day", [50], 200.0, 4)


@stream_query("stream_sliding_vwap", f"""WITH {LANDED}, {marks('landed', 86400)},
e AS (SELECT event_type, value, event_id % 5 + 1 AS w, ts, late, final, unnest(generate_series(time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, -INTERVAL 2 HOUR)) AS s FROM landed JOIN mark USING (slice))
SELECT event_type, s + INTERVAL 4 HOUR AS t0, round(sum(value * w) / sum(w) / 1.0837::DOUBLE, 6) AS vwap, CAST(sum(w) AS DOUBLE) AS volume, count(*) AS n_events FROM e
WHERE epoch_us(s) + 14400000000 > late AND epoch_us(s) + 14400000000 <= final GROUP BY 1, 2""")
def stream_sliding_vwap(stream):
    rows = stream.withColumns({"w": (F.col("event_id") % 5 + 1).cast("double"), "value": F.col("value") / RATE})
    return L.sliding_vwap(rows, ["event_type"], "ts", "value", "w", "4 hours", "2 hours", "1 day")


@stream_query("stream_exceedance_sessions", f"""WITH {LANDED}, high AS (SELECT * FROM landed WHERE value > 60), {marks('high', 86400)},
x AS (SELECT event_type, ts, us, value, final, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM high JOIN mark USING (slice) WHERE us + 3600000000 > late WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS id FROM x)
SELECT event_type, min(ts) AS start, max(ts) AS "end", count(*) AS length, max(value) AS peak FROM i GROUP BY event_type, id, final HAVING max(us) + 3600000000 <= final""")
def stream_exceedance_sessions(stream):
    return L.exceedance_sessions(stream, ["event_type"], "ts", "value", 60.0, "1 hour", "1 day")


LATEST_SQL = """SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_returnflag, (l_linenumber, l_returnflag, l_quantity)) AS l_returnflag, arg_max(l_quantity, (l_linenumber, l_returnflag, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1"""


def upserted(table: DataFrame, slices: int, doc: list[str], revision: str, buckets: int, twice: bool = False) -> str:
    """Feeds the slices of ``table`` into a bucketed table and returns its folder. ``twice`` repeats every batch, as after a lost acknowledgement."""
    out: dict = {}

    def run(stream: DataFrame, base: str) -> None:
        out["path"] = f"{base}/table"
        feed = base.rsplit("-", 1)[1]

        def merge(batch: DataFrame, number: int) -> None:
            for _ in range(2 if twice else 1):
                L.upsert_latest(table.sparkSession, batch, out["path"], doc, revision, batch_id=number, feed=feed, buckets=buckets)

        q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    replay(table, slices, "upsert", run)
    return out["path"]


def stream_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions arrive out of order (line k of order o lands in slice (3 k + o) mod 4) and every batch is delivered twice."""
    utc_session(spark)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    path = upserted(rows.withColumn("_kw_slice", (3 * F.col("l_linenumber") + F.col("l_orderkey")) % 4), 4, ["l_orderkey"], "l_linenumber", 8, twice=True)
    return rounded(L.read_latest(spark, path))


QUERIES["stream_latest_revision"] = stream_latest_revision
ORACLES["stream_latest_revision"] = LATEST_SQL
