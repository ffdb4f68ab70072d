"""Live interval features, sliding windows, exceedance sessions and latest revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def instant(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less columns are read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def interval_features(stream: DataFrame, by: Sequence[str], ts: str, x: Column, bucket: str, late: str,
                      thresholds: Sequence[float], clip: float, expected: int | None = None) -> DataFrame:
    """Tumbling-window features of a point stream; final once the watermark passes the window.

    ``expected`` points per window give the coverage. The state of a window is a handful of
    sums, so it does not grow with the number of points.
    """
    rows = instant(stream, ts).withWatermark(ts, late).withColumn("_kw_x", x)
    v = F.col("_kw_x")
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("mean_abs"), F.stddev_samp(v).alias("std"),
            F.max(F.abs(v)).alias("max_abs"), F.min(v).alias("low"), F.max(v).alias("high"),
            F.sum(F.greatest(F.least(v, F.lit(clip)), F.lit(0.0)) / clip).alias("up_equivalent"),
            F.sum(F.greatest(F.least(-v, F.lit(clip)), F.lit(0.0)) / clip).alias("down_equivalent")]
    aggs += [F.avg((F.abs(v) > t).cast("double")).alias(f"share_outside_{t:g}") for t in thresholds]
    out = rows.groupBy(*by, F.window(ts, bucket).alias("_kw_w")).agg(*aggs)
    out = out.select(*by, F.col("_kw_w.start").cast("timestamp_ntz").alias("bucket"), *[c for c in out.columns if c not in (*by, "_kw_w")])
    return out if expected is None else out.withColumn("coverage", F.col("n") / expected)


def sliding_vwap(stream: DataFrame, by: Sequence[str], ts: str, price: str, volume: str, width: str, slide: str, late: str) -> DataFrame:
    """Volume-weighted mean over sliding windows, the live form of an event-window feature."""
    from ..functions.numeric import vwmean

    rows = instant(stream, ts).withWatermark(ts, late)
    out = rows.groupBy(*by, F.window(ts, width, slide).alias("_kw_w")).agg(
        vwmean(price, volume).alias("vwap"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("n_events"))
    return out.select(*by, F.col("_kw_w.end").cast("timestamp_ntz").alias("t0"), "vwap", "volume", "n_events")


def exceedance_sessions(stream: DataFrame, by: Sequence[str], ts: str, value: str, threshold: float, gap: str, late: str) -> DataFrame:
    """Episodes of exceedance that end after ``gap`` without another one."""
    rows = instant(stream, ts).where(F.col(value) > threshold).withWatermark(ts, late)
    out = rows.groupBy(*by, F.session_window(ts, gap).alias("_kw_s")).agg(
        F.count(F.lit(1)).alias("length"), F.max(value).alias("peak"), F.max(ts).alias("_kw_last"))
    return out.select(*by, F.col("_kw_s.start").cast("timestamp_ntz").alias("start"), F.col("_kw_last").cast("timestamp_ntz").alias("end"), "length", "peak")


def latest_revisions(stream: DataFrame, doc: Sequence[str], revision: str, payload: Sequence[str]) -> DataFrame:
    """Running table of the highest revision per document; stale revisions change nothing.

    Use with output mode ``update`` (an upsert feed) or ``complete``; the state is one row per
    document. Ties between equal revisions go to the larger payload, so the result does not
    depend on the order of arrival.
    """
    return stream.groupBy(*doc).agg(
        F.max_by(F.struct(*payload), F.struct(revision, *payload)).alias("_kw_p"), F.max(revision).alias(revision)).select(*doc, revision, "_kw_p.*")


COMMIT = "version long, feed string, batch long, bucket int"


def commits(spark: SparkSession, table: str) -> DataFrame | None:
    """(version, feed, batch, bucket) of every bucket that a committed batch rewrote; None before the first commit. A batch without rows
    commits with a NULL bucket."""
    try:
        lines = spark.read.text(f"{table}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    parsed = F.from_json("value", COMMIT)
    return lines.select(F.when(parsed["version"].isNotNull() & parsed["feed"].isNotNull(), parsed)
                        .otherwise(F.raise_error(F.concat(F.lit("unreadable commit: "), F.col("value")))).alias("c")).select("c.*")


def _bucket(doc: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*doc), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, table: str, done: DataFrame, touched: Sequence[int] | None = None) -> DataFrame | None:
    """Rows of the newest version of each bucket (of ``touched`` only). One folder per bucket is listed, nothing older."""
    newest = done.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.max("version").alias("version"))
    if touched is not None:
        newest = newest.where(F.col("bucket").isin(*touched))
    paths = [f"{table}/rows/version={r.version}/bucket={r.bucket}" for r in newest.collect()]  # at most one per bucket
    return spark.read.option("basePath", f"{table}/rows").parquet(*paths).drop("version", "bucket") if paths else None


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest committed rows of every bucket."""
    done = commits(spark, table)
    rows = None if done is None else _current(spark, table, done)
    if rows is None:
        raise FileNotFoundError(f"no rows committed in {table}")
    return rows


def upsert_latest(spark: SparkSession, batch: DataFrame, table: str, doc: Sequence[str], revision: str, *, batch_id: int,
                  feed: str = "", buckets: int = 64) -> bool:
    """``foreachBatch`` merge of a micro-batch into a parquet table, keeping the highest revision per document; False if this batch of
    this ``feed`` (one checkpoint) was committed before, which changes nothing.

    Documents are hashed into ``buckets`` (always the same number for one table), and a batch reads and rewrites only the buckets it meets. New
    files of a bucket stand beside the old ones under the batch's version; one line per rewritten bucket, written last and at once,
    commits them. A batch that failed before that leaves files that nothing refers to, and its repetition replaces them. One
    writer at a time.
    """
    done = commits(spark, table)
    if done is not None and not done.where((F.col("feed") == feed) & (F.col("batch") == batch_id)).isEmpty():
        return False
    version = 0 if done is None else done.agg(F.max("version")).first()[0] + 1
    rows = _newest(batch, doc, revision).withColumn("bucket", _bucket(doc, buckets))
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = _current(spark, table, done, touched) if done is not None and touched else None
    if old is not None:
        rows = _newest(rows.drop("bucket").unionByName(old.select(*batch.columns)), doc, revision).withColumn("bucket", _bucket(doc, buckets))
    if touched:
        rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/rows/version={version}")
    lines = [(version, feed, int(batch_id), b) for b in touched or [None]]
    spark.createDataFrame(lines, COMMIT).select(F.to_json(F.struct("*"))).coalesce(1).write.mode("append").text(f"{table}/_commits")
    return True


def _newest(rows: DataFrame, doc: Sequence[str], revision: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in doc]
    best = rows.groupBy(*doc).agg(F.max_by(F.struct(*rest), F.struct(revision, *[c for c in rest if c != revision])).alias("_kw_r"))
    return best.select(*doc, "_kw_r.*").select(*rows.columns)
