"""Exact top-k by inner product with block-at-a-time pruning.

Rows are cut into blocks of consecutive ids. A block keeps a forward index (its ids and integer components) and, for each
term (component), the largest and smallest value. The sum over terms of the larger product bounds every score in the
block. For each query, blocks are taken by falling bound and scored through their forward index until no bound reaches
the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, query, written

BLOCK = "__dim int, __low long, __n int, __ids binary, __rows binary, __values binary"


def integer_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """-> (row, vec_id, v): v is ``floor(scale * component)`` as longs, ``row`` numbers the rows, so that rows that repeat an id stay rows of
    their own. The result is written, which settles the numbers. Null ids, null vectors and vectors holding null or non-finite
    components take no part; nor do empty ones."""
    x = F.col(vector)
    fine = F.col(id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return written(df.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"),
                                         F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v")))


def forward_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(row, vec_id, v) -> one row per block of up to ``size`` rows with neighbouring ids and equally many components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def block():
            ids, rows, values = (np.array([h[k] for h in held], "<i8") for k in (1, 0, 2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([values.shape[1]], pa.int32()), pa.array([int(ids.min())]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([rows.tobytes()]), pa.array([values.tobytes()])], ["__dim", "__low", "__n", "__ids", "__rows", "__values"])

        for batch in batches:
            v = batch.column(2)
            flat, ends = v.flatten().to_numpy(), np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]
            for k, (number, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = flat[ends[k]:ends[k + 1]]
                if held and (len(held) >= size or len(held[-1][2]) != len(own)):
                    yield block()
                held.append((number, i, own))
        if held:
            yield block()

    return vectors.withColumn("__d", F.size("v")).repartitionByRange("__d", "vec_id", "row").sortWithinPartitions("__d", "vec_id", "row").select("row", "vec_id", "v").transform(arrow_map, pack, BLOCK)


def _rows(blocks: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(np.frombuffer(i, "<i8"), np.frombuffer(r, "<i8"), np.frombuffer(v, "<i8").reshape(len(i) // 8, -1)) for i, r, v in zip(blocks["__ids"], blocks["__rows"], blocks["__values"])]


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id, then to the smaller row number."""
    return np.lexsort((rows, ids, -scores))[:k]


def _search(queries: list, docs: list, k: int) -> tuple[pd.DataFrame, int]:
    """The k best rows of ``docs`` (blocks) for each row of ``queries`` (blocks), the row itself left out; and how many blocks were scored."""
    if not queries or not docs:
        return pd.DataFrame({c: [] for c in ("query_row", "query_id", "row", "vec_id", "score")}, dtype="int64"), 0
    index = [(ids, rows, values, values.max(0), values.min(0)) for ids, rows, values in docs]
    high, low = np.array([b[3] for b in index], float), np.array([b[4] for b in index], float)
    out, scored = [], 0
    for qids, qrows, q in queries:
        exact = float(np.abs(q).max(initial=0)) * max(np.abs(high).max(), np.abs(low).max()) * q.shape[1] < 2.0**53
        q = q.astype(float) if exact else q
        tables = [(ids, rows, (values.astype(float) if exact else values)) for ids, rows, values, *_ in index]
        q_up, q_down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        bounds = q_up @ high.T + q_down @ low.T  # the sum of the terms' maxima
        if not exact:
            bounds *= np.where(bounds > 0, 1 + 1e-9, 1 - 1e-9)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * len(qids)
        for step in range(len(index)):  # each query's next block; queries that want the same block share its scoring
            at = order[:, step]
            open_ = [j for j in range(len(qids)) if len(best[j][0]) < k or bounds[j, at[j]] >= best[j][2][-1]]
            if not open_:
                break
            for b in np.unique(at[open_]):
                js = [j for j in open_ if at[j] == b]
                ids, rows, values = tables[b]
                scores = q[js] @ values.T
                scored += len(js)
                for j, s in zip(js, scores):
                    other = rows != qrows[j]
                    near = np.flatnonzero((s >= best[j][2][-1]) & other if len(best[j][0]) >= k else other)
                    if not len(near):
                        continue
                    every = np.r_[best[j][0], ids[near]], np.r_[best[j][1], rows[near]], np.r_[best[j][2], s[near]]
                    top = _best(*every, k)
                    best[j] = tuple(c[top] for c in every)
        for j, (ids, rows, scores) in enumerate(best):
            out.append(pd.DataFrame({"query_row": qrows[j], "query_id": qids[j], "row": rows, "vec_id": ids, "score": scores.astype(np.int64)}))
    return pd.concat(out), scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, block: int = 512, group: int = 64, query_block: int = 256) -> DataFrame:
    """-> (query_id, rank, vec_id, score): each query's ``k`` highest integer inner products with other rows, ties to the
    smaller id; all, if fewer. Both inputs come from one ``integer_vectors``. Rows that repeat an id are candidates and queries of their own.

    Blocks meet in a grid: ``group`` document blocks and one query block to a task (about ``block * group`` rows), each
    query block once with every group; a task returns at most ``k`` rows per query, and those are merged by rank. No
    input is broadcast or collected. Only vectors with equally many components are compared. An empty side gives no rows.
    """
    docs, asked = written(forward_blocks(vectors, block)), written(forward_blocks(queries, query_block))
    n_docs, n_asked = (F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int") for size in (group, 1))
    sizes = docs.agg(n_docs.alias("a")).first()["a"], asked.agg(n_asked.alias("b")).first()["b"]
    place = lambda n: F.pmod(F.xxhash64("__dim", "__low", "__n"), F.lit(n)).cast("int")
    left = docs.withColumn("__s", place(sizes[0])).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(sizes[1] - 1))))
    right = asked.withColumn("__q", place(sizes[1])).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(sizes[0] - 1))))

    def run(_, d, q):
        return _search(_rows(q), _rows(d), k)[0]

    keys = ["__dim", "__s", "__q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_row long, query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


@query("op2_exact_top_k", """WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.rid <> d.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op2(t):
    vectors = integer_vectors(t("embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
