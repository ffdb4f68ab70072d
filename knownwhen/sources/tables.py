"""Parquet lakes: views, multi-tree series, schema drift, partitioned writes, manifests."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..functions.text import check_names
from ..operators.aggregates import dedup
from ..operators.quality import column_dictionary


def _files(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[str]:
    """Paths below a folder on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    it, out = fs.listFiles(path, True), []
    while it.hasNext():
        p = it.next().getPath().toString()
        if p.endswith(suffix):
            out.append(p)
    return sorted(out)


def register_views(spark: SparkSession, root: str) -> list[str]:
    """One temp view ``<folder>__<file>`` (or ``<file>`` at the top) per parquet table of a lake."""
    names = []
    base = PurePosixPath(re.sub(r"^[a-z0-9]+:/*", "/", root))
    tables: dict[str, list[str]] = {}
    for f in _files(spark, root):
        rel = PurePosixPath(re.sub(r"^[a-z0-9]+:/*", "/", f)).relative_to(base)
        parts = [p for p in rel.parts[:-1] if "=" not in p]
        stem = rel.stem if not rel.stem.startswith("part-") else ""
        name = re.sub(r"[^A-Za-z0-9_]+", "_", "__".join([*parts, *([stem] if stem else [])]))
        tables.setdefault(name, []).append(f)
    for name, files in tables.items():
        spark.read.parquet(*files).createOrReplaceTempView(name)
        names.append(name)
    return sorted(names)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files with drifting schemas: absent columns are NULL, extra ones are kept."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def with_source(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path"))


def scan_series(spark: SparkSession, trees: Sequence[Sequence[str]], ts: str, keys: Sequence[str] = (),
                columns: Sequence[str] | None = None, unique: bool = True) -> DataFrame:
    """One series from the files of several trees; later trees, then later files, win per time and key.

    ``unique=False`` keeps repeated stamps for long layouts that are deduplicated later.
    """
    parts = []
    for rank, paths in enumerate(trees):
        if paths:
            df = read_union(spark, paths)
            df = df if columns is None else df.select(*columns)
            parts.append(df.select("*", F.col("_metadata.file_path").alias("_kw_file"), F.lit(rank).alias("_kw_tree")))
    if not parts:
        raise FileNotFoundError("no files for the series")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if unique:
        out = dedup(out, [ts, *keys], F.col("_kw_tree"), F.col("_kw_file"))
    return out.drop("_kw_tree", "_kw_file")


def pick_best_copy(df: DataFrame, key: Sequence[str], file: str, measures: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """Rows of the best file per key: measures are aggregated per (key, file) and ordered best first.

    The measures, not the rows, are ranked; the rows are then kept by an equi-join.
    """
    per = df.groupBy(*key, file).agg(*[c.alias(n) for n, c in measures.items()])
    best = per.groupBy(*key).agg(F.min_by(file, F.struct(*[o.alias(f"o{i}") for i, o in enumerate([*order, F.col(file)])])).alias("_kw_best"))
    out = df.transform(match, best, list(key))
    return out.where(F.col(file) == F.col("_kw_best")).drop("_kw_best")


def copy_conflicts(df: DataFrame, key: Sequence[str], file: str, measure: Column) -> DataFrame:
    """Keys that several files cover with different values of the measure."""
    per = df.groupBy(*key, file).agg(measure.alias("_kw_m"))
    out = per.groupBy(*key).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("_kw_m").alias("variants"))
    return out.where((F.col("files") > 1) & (F.col("variants") > 1))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                sort_by: Sequence[str] = (), dry_run: bool = True) -> bool:
    """Writes parquet; partitions in the data replace those on disk, all others stay.

    Nothing is written in a dry run. The commit protocol makes the result visible at once.
    Rows are spread by partition and sort key, so one large partition becomes several files.
    """
    if dry_run:
        return False
    out = df
    if partition_by or sort_by:
        out = df.repartitionByRange(*[F.col(c) for c in (*partition_by, *sort_by)]).sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def missing_partitions(df: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of partitions that the manifest does not list yet."""
    return df.transform(match, manifest.select(*keys).distinct(), list(keys), "left_anti")


def write_clean(df: DataFrame, path: str, ts: str, pattern: re.Pattern, dictionary: Sequence[Mapping[str, str]], start: str, end: str,
                partition_by: Sequence[str] = (), dry_run: bool = True) -> DataFrame:
    """Clean-table sink: name grammar, unique stamps, dictionary rows, trimmed to the sample.

    Returns the dictionary with the first and last value and the NULL share of every column.
    """
    bad = check_names([c for c in df.columns if c not in partition_by], pattern, (ts, "ts_local"))
    if bad:
        raise ValueError(f"column names break the grammar: {bad}")
    columns = [c for c in df.columns if c not in (ts, "ts_local", *partition_by)]
    undocumented = sorted(set(columns) - {d["column"] for d in dictionary})
    if undocumented:
        raise ValueError(f"no dictionary entry for: {undocumented}")
    if not df.groupBy(ts).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).isEmpty():
        raise ValueError("duplicate timestamps")
    out = df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    out = out.select(*[F.col(f.name).cast("float").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])
    write_table(out, path, partition_by, sort_by=[ts], dry_run=dry_run)
    names = sorted({k for d in dictionary for k in d})
    meta = df.sparkSession.createDataFrame([tuple(str(d.get(k, "")) for k in names) for d in dictionary],
                                           ", ".join(f"`{k}` string" for k in names))
    return meta.join(column_dictionary(out, ts, columns), "column", "left")


def file_manifest(df: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """Rows, first / last stamp and NULL share of every file behind a scan."""
    cells = len(columns)
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    return with_source(df).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        (F.sum(nulls) / (F.count(F.lit(1)) * cells)).alias("null_share"))


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace the old rows of their keys; all other old rows stay."""
    return old.transform(match, new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def year_of(ts: str, tz: str) -> Column:
    """Local year, the usual partition column of a grid table."""
    return F.year(T.utc_to_local(ts, tz))
