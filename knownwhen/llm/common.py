"""Helpers of the operators: reading a column safely, written stages, hashed uniforms, table names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(t)`` where ``t(table)`` reads one whole given table."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, safe from lost executors."""
    return cut_lineage(df)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) fixed by the parts: 52 bits of an MD5 digest, so that any SQL engine can repeat it."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of about 8 MB, so that a worker's memory follows neither the row count of a
    batch nor the length of texts. A session that sets the limit itself keeps it."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, "67108864b") in ("67108864b", "64m"):  # Spark's default
        conf.set(BATCH_BYTES, "8m")
    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts Arrow batches so that each piece holds about ``size`` bytes of a text column (at least one row); yields
    the piece and that column as Python objects."""
    for batch in batches:
        start = 0
        if not batch.num_rows:
            continue
        lengths = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
        total = 0
        for row, n in enumerate(lengths):
            if total and total + n > size:
                piece = batch.slice(start, row - start)
                yield piece, piece.column(column).to_pylist()
                start, total = row, 0
            total += n + 64
        piece = batch.slice(start)
        yield piece, piece.column(column).to_pylist()
