"""Families of lags without copying rows once per lag.

Rows carry a whole-number position (a row number or a step of a grid). A chunk of positions and the reach before and after it become
dense arrays in one task, and a lag is a shift of such an array. A row is shipped to its own chunk and, near a border, to the
neighbour, so what is shuffled doesn't depend on how many lags are asked for. Tasks return sums, which are added per series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered as O

WIDTH = 16384


class Dense:
    """One chunk: ``x[c][k]`` is column c at place k, NaN where missing; ``there`` marks places with a row, ``own`` those of the chunk itself."""

    def __init__(self, table: pa.Table, columns: Sequence[str], width: int, before: int, after: int):
        self.before, self.width = before, width
        size = before + width + after
        place = table.column(O.KEY).to_numpy() - (table.column(O.CHUNK)[0].as_py() * width - before)
        inside = (place >= 0) & (place < size)
        place = place[inside]
        self.x = {}
        for c in columns:
            self.x[c] = np.full(size, np.nan)
            self.x[c][place] = table.column(c).to_numpy()[inside].astype(float)
        self.there = np.zeros(size, bool)
        self.there[place] = True
        self.row = np.full(size, -1)
        self.row[place] = np.flatnonzero(inside)
        self.own = np.arange(before, before + width)[self.there[before:before + width]]


def by_chunk(rows: DataFrame, by: Sequence[str], position: str, columns: Sequence[str], before: int, after: int,
             fields: str, kernel: Callable[[Dense, pa.Table], list[tuple]], carry: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Runs ``kernel(dense, table)`` on every chunk. Returns the series key ``O.GROUP`` and the ``fields`` of the tuples it gives; a field in
    ``carry`` is given as the index of a table row whose value it takes. Positions are unique per series."""
    width = width or max(WIDTH, 4 * (before + after))
    halo = O.halo(rows.where(F.col(position).isNotNull()), by, position, before, after, width).select(
        O.GROUP, O.CHUNK, O.KEY, *[F.col(c).cast("double").alias(c) for c in columns], *carry)
    types = T._parse_datatype_string(fields)
    schema = T.StructType([halo.schema[O.GROUP], *types])

    def run(table: pa.Table) -> pa.Table:
        found = kernel(Dense(table, columns, width, before, after), table)
        arrays = [table.column(O.GROUP).combine_chunks().take(pa.array([0] * len(found), pa.int64()))]
        for k, f in enumerate(types):
            values = [r[k] for r in found]
            if f.name in carry:
                arrays.append(table.column(f.name).combine_chunks().take(pa.array(values, pa.int64())))
            else:
                kind = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]
                arrays.append(pa.array(values, kind))
        return pa.Table.from_arrays(arrays, [O.GROUP, *types.names])

    return halo.groupBy(O.GROUP, O.CHUNK).applyInArrow(run, schema)


def keys(by: Sequence[str]) -> list[Column]:
    return [F.col(f"{O.GROUP}.{c}").alias(c) for c in by]


def added(parts: DataFrame, by: Sequence[str], labels: Sequence[str], n: str, vector: str) -> DataFrame:
    """Sums of ``n`` and, entry by entry, of the arrays ``vector`` per series and labels."""
    cells = parts.select(O.GROUP, *labels, n, F.posexplode(vector).alias("_kw_at", "_kw_v"))
    sums = cells.groupBy(O.GROUP, *labels, "_kw_at").agg(F.sum(n).alias(n), F.sum("_kw_v").alias("_kw_v"))
    whole = sums.groupBy(O.GROUP, *labels).agg(F.max(n).alias(n), F.sort_array(F.collect_list(F.struct("_kw_at", "_kw_v"))).alias(vector))
    return whole.select(*keys(by), *labels, n, F.transform(vector, lambda e: e["_kw_v"]).alias(vector))


def lagged_sums(rows: DataFrame, by: Sequence[str], position: str, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """-> (*by, lag, n, s): ``s`` is the flattened matrix of ``sum x_i(t) x_j(t - lag)`` over the ``n`` pairs of rows that exist. Missing
    values add nothing."""
    before, after = max(0, *lags), max(0, *(-lag for lag in lags))

    def kernel(d: Dense, _) -> list[tuple]:
        x = np.nan_to_num(np.stack([d.x[c] for c in columns]))
        out = []
        for lag in lags:
            here = d.own[d.there[d.own - lag]]
            out.append((lag, len(here), (x[:, here] @ x[:, here - lag].T).ravel().tolist()))
        return out

    return added(by_chunk(rows, by, position, columns, before, after, "lag int, n bigint, s array<double>", kernel), by, ["lag"], "n", "s")


def lagged_grams(rows: DataFrame, by: Sequence[str], position: str, targets: Sequence[tuple[str, str]], orders: Sequence[int]) -> DataFrame:
    """-> (*by, target, driver, lags, n, g): for each (target y, driver x) and order L the flattened Gram matrix of
    ``[1, y, y(t-1) .. y(t-L), x(t-1) .. x(t-L)]`` over rows where all of them are known."""
    top = max(orders)
    columns = sorted({c for pair in targets for c in pair})

    def kernel(d: Dense, _) -> list[tuple]:
        out = []
        for y, x in targets:
            full = np.stack([np.ones(len(d.own)), d.x[y][d.own], *[d.x[y][d.own - lag] for lag in range(1, top + 1)], *[d.x[x][d.own - lag] for lag in range(1, top + 1)]])
            for order in orders:
                m = full[[0, 1, *range(2, 2 + order), *range(2 + top, 2 + top + order)]]
                m = m[:, ~np.isnan(m).any(axis=0)]
                out.append((y, x, order, m.shape[1], (m @ m.T).ravel().tolist()))
        return out

    parts = by_chunk(rows, by, position, columns, top, 0, "target string, driver string, lags int, n bigint, g array<double>", kernel)
    return added(parts, by, ["target", "driver", "lags"], "n", "g")
