"""Cross products of very many columns: tasks multiply matrices of whole Arrow batches, and the k x k sums are added in a tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 32


def _summed(df: DataFrame, columns: Sequence[str], products) -> np.ndarray:
    """Sum over all rows of ``products(x)`` (a stack of matrices) of Arrow batches ``x`` (rows x columns, NaN where missing). The result has a size set
    by the columns alone; only that reaches the driver."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)
            part = products(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, float) for b in table.column("s").to_pylist())
        return pa.Table.from_arrays([pa.array([total.tobytes()])], ["s"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "s binary")
    parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(BUCKETS)).alias("b")).applyInArrow(add, "s binary")
    row = parts.groupBy(F.lit(0).alias("b")).applyInArrow(add, "s binary").first()
    empty = products(np.empty((0, len(names))))
    return empty if row is None else np.frombuffer(row["s"], float).reshape(empty.shape)


def wide_gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """(number of rows with all columns known, their matrix of cross products of [1, *columns])."""
    def products(x: np.ndarray) -> np.ndarray:
        x = x[~np.isnan(x).any(axis=1)]
        x = np.column_stack([np.ones(len(x)), x])
        return x.T @ x

    g = _summed(df, columns, products)
    return int(g[0, 0]), g


def pairwise_corr(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(share of missing values per column, correlation of every pair over the rows where both are known); NaN for fewer than two rows or
    a constant side. Values are centred on the columns' means first, so that long sums keep their digits."""
    means = df.select(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m or 0.0 for m in means])

    def products(x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        y, m = np.where(there, x - centre, 0.0), there.astype(float)
        return np.stack([m.T @ m, y.T @ m, (y * y).T @ m, y.T @ y, np.full((x.shape[1], x.shape[1]), float(len(x)))])

    n, s, q, p, rows = _summed(df, columns, products)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p - s * s.T / n
        var = q - s * s / n
        floor = 1e-12 * q
        r = np.where((var > floor) & (var.T > floor.T), cov / np.sqrt(var * var.T), np.nan)
        return 1 - np.diag(n) / max(rows[0, 0], 1), r


def column_report(df: DataFrame, columns: Sequence[str], max_missing: float = 0.2, min_distinct: int = 3, max_corr: float = 0.8) -> DataFrame:
    """One row per column in the given order: missing share, standard deviation, whether it has enough values and variation (``usable``), the first
    kept column that it nearly copies (``copy_of``) and whether it is ``kept``.

    Columns are judged in order, so of two near copies the first stays. Distinct values are counted approximately above ``min_distinct``.
    """
    names = list(columns)
    aggs = [a for i, c in enumerate(names) for a in (F.approx_count_distinct(c).alias(f"d{i}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}"))]
    row = df.agg(*aggs).first()
    missing, r = pairwise_corr(df, names)
    kept: list[int] = []
    table = []
    for i, c in enumerate(names):
        sd = row[f"s{i}"]
        usable = bool(missing[i] <= max_missing and row[f"d{i}"] >= min_distinct and (sd or 0) > 1e-9)
        copy = next((j for j in kept if abs(r[i, j]) > max_corr), None) if usable else None
        if usable and copy is None:
            kept.append(i)
        table.append((i, c, float(missing[i]), sd, usable, None if copy is None else names[copy], bool(usable and copy is None)))
    return df.sparkSession.createDataFrame(table, "position int, column string, missing double, sd double, usable boolean, copy_of string, kept boolean")
