"""Near duplicates among embeddings, by binary codes of randomly rotated vectors.

A unit vector is rotated at random and coded by the signs of its coordinates; the inner product of the vector with its
own code is stored as a correction factor. Dividing the inner product of a code with another (rotated, uncoded) vector
by that factor estimates the cosine without bias, and the factor also bounds the error. Only pairs whose upper bound
reaches the threshold are computed exactly, and only exact cosines decide.

Which rows meet is settled by hashing: in each of several tables, further random rotations send a vector to the axis
nearest to it (or to a tuple of such axes, the longer the more rows there are). The number of tables follows from the
collision rate of pairs exactly at the threshold and the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, query, written
from .graph import components


@lru_cache(maxsize=64)
def rotation(rows: int, dim: int, seed: int) -> np.ndarray:
    """A random matrix whose columns are orthonormal (``rows >= dim``)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, rows, dim]).standard_normal((rows, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=16)
def axis_collision(dim: int, cosine: float) -> float:
    """Share of pairs with this cosine that a random rotation sends to the same nearest axis."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((8000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((8000, dim))
    z -= (z * x).sum(1)[:, None] * x
    y = cosine * x + math.sqrt(1 - cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    return max(0.05, float((_axis(x) == _axis(y)).mean()))


def _axis(u: np.ndarray) -> np.ndarray:
    at = np.abs(u).argmax(1)
    return 2 * at + (u[np.arange(len(u)), at] < 0)


def _code_rows(dim: int) -> int:
    return max(128, dim)


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    return x @ rotation(_code_rows(x.shape[1]), x.shape[1], seed).T


def encode(vectors: DataFrame, tables: int, axes: int, seed: int = 1) -> DataFrame:
    """(id, n, v array<double>) -> (id, n, dim, raw, code, factor, cells): raw components, sign bits, correction factor,
    and one cell per hash table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            ends, flat = np.r_[0, np.cumsum(sizes)], v.flatten().to_numpy()
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = np.stack([flat[ends[r]:ends[r + 1]] for r in rows])
                unit = x / np.abs(x).max(1)[:, None]
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                u = _rotated(unit, seed)
                factor = np.abs(u).sum(1) / math.sqrt(u.shape[1])
                cells = np.zeros((len(rows), tables), np.int64)
                for t in range(tables):
                    for a in range(axes):
                        cells[:, t] = cells[:, t] * (2 * dim) + _axis(unit @ rotation(int(dim), int(dim), seed + 1 + t * axes + a).T)
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0), picked.column(1), pa.array(np.full(len(rows), dim), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([r.tobytes() for r in np.packbits(u >= 0, axis=1)], pa.binary()), pa.array(factor), pa.array(list(cells), pa.list_(pa.int64()))],
                    ["id", "n", "dim", "raw", "code", "factor", "cells"])

    return vectors.select("id", "n", "v").transform(arrow_map, run, "id long, n long, dim int, raw binary, code binary, factor double, cells array<long>")


def _linked(rows: pd.DataFrame, table: int, cross: bool, cosine: float, spread: float, seed: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Pairs (places of the rows) with at least the cosine; only between the two sides where ``cross``."""
    raw = np.stack([np.frombuffer(b, float) for b in rows["raw"]])
    unit = raw / np.abs(raw).max(1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    u = _rotated(unit, seed).astype(np.float32)
    width = u.shape[1]
    code = np.stack([np.frombuffer(b, np.uint8) for b in rows["code"]])
    signs = (np.unpackbits(code, axis=1)[:, :width].astype(np.float32) * 2 - 1) / math.sqrt(width)
    factor = rows["factor"].to_numpy()
    bound = spread * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, width - 1))
    side = rows["side"].to_numpy()
    cells = np.stack(rows["cells"].to_numpy()) if table else None
    left, right, exact = [], [], 0
    for start in range(0, len(rows), 512):
        part = slice(start, start + 512)
        estimate = (signs[part] @ u.T) / factor[part, None]
        i, j = np.nonzero(estimate + bound[part, None] >= cosine)
        i += start
        keep = (side[i] < side[j]) if cross else (i < j)
        i, j = i[keep], j[keep]
        exact += len(i)
        for s in range(0, len(i), 65_536):
            a, b = i[s:s + 65_536], j[s:s + 65_536]
            good = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            left.append(a[good])
            right.append(b[good])
    i, j = (np.concatenate(x) if x else np.empty(0, int) for x in (left, right))
    first = np.ones(len(i), bool) if cells is None else ~(cells[i, :table] == cells[j, :table]).any(1)
    return i, j, {"first": first, "exact": exact}


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches over these pairs."""
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    return root


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, *, recall: float = 0.9995,
                    cell_rows: int = 4096, block: int = 2048, spread: float = 4.0, seed: int = 1) -> DataFrame:
    """-> (id, n_links, component_id, kept), one row per input row: how many others have at least the cosine, the smallest
    id reachable over such links, and whether that is its own.

    Null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors of different
    lengths never link. Equal vectors are compared once and counted with their number. A cell with more than ``block``
    distinct vectors is cut into blocks that meet pair by pair; tasks return counts and local roots, never pairs. The
    repeated tables find a pair again; it is counted in the first cell it shares. Rows with a null id are dropped; equal ids are rows of their own.
    """
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda c: c.cast("double"))).alias("v"))
    groups = written(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = int(size["dim"] or 1)
    axes = max(1, math.ceil(math.log(max(1, size["n"] / cell_rows)) / math.log(2 * dim))) if dim > 1 else 1
    hit = axis_collision(dim, cosine) ** axes
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1
    coded = written(encode(groups, tables, axes, seed))
    in_cells = coded.select("*", F.posexplode("cells").alias("t", "cell"))
    counts = in_cells.groupBy("dim", "t", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("in_cell")).where("in_cell > 1").drop("in_cell")
    own = F.pmod(F.xxhash64("id", "raw"), F.col("blocks")).cast("int")
    met = (in_cells.join(counts, ["dim", "t", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
           .withColumn("side", (F.col("own") == F.col("q")).cast("int") * (F.col("p") != F.col("q")).cast("int")))

    def run(key, rows):
        table, cross = int(key[1]), key[3] != key[4]
        i, j, note = _linked(rows, table, cross, cosine, spread, seed)
        ids, n, first = rows["id"].to_numpy(), rows["n"].to_numpy(), note["first"]
        links = np.bincount(i[first], n[j[first]], len(ids)) + np.bincount(j[first], n[i[first]], len(ids))
        root = _roots(len(ids), i, j, ids)
        some = np.zeros(len(ids), bool)
        some[i] = some[j] = True
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    found = written(met.groupBy("dim", "t", "cell", "p", "q").applyInPandas(run, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (groups.join(links, "id", "left").join(roots, "id", "left")
             .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    joined = rows.join(known, "v", "left")
    return joined.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
                         (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


@query("op9_embedding_near_dedup", """WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, min(r.c) AS component_id, min(r.c) = v.vec_id AS kept
FROM v JOIN r ON r.id = v.vec_id GROUP BY v.vec_id""")
def op9(t):
    return near_duplicates(t("embeddings"))
