"""Hard-negative mining by slots.

An anchor's positives, best first, have falling upper limits for the scores of their negatives. The limits cut the axis of scores into
disjoint slots: slot i holds scores above the next limit and not above limit i. A positive's window begins at the top of its slot and may reach
through any number of lower ones, so windows overlap but slots don't. Each place that scores a block of rows keeps the best k of every
slot; merging slots from the lowest one up then answers every window, without scoring a pair once per window.

Anchors (a stated query set) meet all rows in blocks: vectors are packed as the narrowest integers that hold them, a cell joins one group of
anchors with one group of rows, and a task holds one group of anchors while blocks of rows stream past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, query, written

ROWS = "dim int, place long, n int, rows binary, ids binary, labels binary, width int, vectors binary, limits binary"
FOUND = "row long, slot int, score long, other_row long, other_id long"
NOWHERE = np.iinfo(np.int64).min


def labelled_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """-> (row, vec_id, label, v): v is ``floor(scale * component)``, ``row`` a number of the row of its own, so that repeated ids stay apart.
    Rows with a NULL id, label or vector, or with a NULL or non-finite component take no part."""
    x = F.col(vector)
    fine = F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def blocks(vectors: DataFrame, size: int, n_limits: int = 0) -> DataFrame:
    """(row, vec_id, label, v[, limits]) -> blocks of up to ``size`` rows, neighbours by (components, label, id)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def block():
            nonlocal count
            values = np.array([h[3] for h in held], np.int64).reshape(len(held), -1)
            top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
            width = 2 if top < 2**15 else 4 if top < 2**31 else 8
            rows, ids, labels = (np.array([h[c] for h in held], "<i8").tobytes() for c in range(3))
            limits = np.array([h[4] for h in held], "<i8").tobytes() if n_limits else b""
            out = [[values.shape[1]], [count], [len(held)], [rows], [ids], [labels], [width], [values.astype(f"<i{width}").tobytes()], [limits]]
            held.clear()
            count += 1
            types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["dim", "place", "n", "rows", "ids", "labels", "width", "vectors", "limits"])

        for batch in batches:
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy(), np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]
            limits = batch.column("limits").to_pylist() if n_limits else [None] * batch.num_rows
            for k, head in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "label")))):
                own = flat[ends[k]:ends[k + 1]]
                if held and (len(held) >= size or len(held[-1][3]) != len(own)):
                    yield block()
                held.append((*head, own, limits[k]))
        if held:
            yield block()

    extra = ["limits"] if n_limits else []
    near = vectors.withColumn("d", F.size("v")).repartitionByRange("d", "label", "vec_id", "row").sortWithinPartitions("d", "label", "vec_id", "row")
    return near.select("row", "vec_id", "label", "v", *extra).transform(arrow_map, pack, ROWS)


class _Block:
    def __init__(self, dim: int, rows: bytes, ids: bytes, labels: bytes, width: int, vectors: bytes, limits: bytes):
        self.rows, self.ids, self.labels = (np.frombuffer(b, "<i8") for b in (rows, ids, labels))
        self.vectors = np.frombuffer(vectors, f"<i{width}").reshape(len(self.rows), dim)
        self.limits = np.frombuffer(limits, "<i8").reshape(len(self.rows), -1) if limits else None
        top = max((abs(int(x)) for x in (self.vectors.max(initial=0), self.vectors.min(initial=0))), default=0)
        self.norm = top
        self.lowest, self.highest = int(self.labels.min()), int(self.labels.max())
        self._double = None

    def double(self) -> np.ndarray:
        if self._double is None:
            self._double = self.vectors.astype(float)
        return self._double


def scores(a: _Block, b: _Block) -> np.ndarray:
    """Exact inner products of all rows as longs; beyond 64 bits they saturate."""
    bound = a.norm * b.norm * max(1, a.vectors.shape[1])
    if bound < 2**53:
        return (a.double() @ b.double().T).astype(np.int64)
    if bound < 2**63:
        return a.vectors.astype(np.int64) @ b.vectors.astype(np.int64).T
    info = np.iinfo(np.int64)
    return np.clip(a.vectors.astype(object) @ b.vectors.astype(object).T, info.min, info.max).astype(np.int64)


class _Kept:
    """The best ``k`` found so far for each (anchor of a block, slot): higher scores first, then smaller ids, then rows."""

    def __init__(self, n: int, slots: int, k: int):
        self.slots, self.k = slots, k
        self.floor = np.full(n * slots, NOWHERE)
        self.full = np.zeros(n * slots, bool)
        self.found = np.empty((0, 4), np.int64)  # cell (anchor * slots + slot), score, id, row

    def offer(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fine = ~self.full[cell] | (score >= self.floor[cell])
        if not fine.any():
            return
        every = np.concatenate([self.found, np.stack([cell[fine], score[fine], ids[fine], rows[fine]], 1)])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        starts = np.flatnonzero(np.r_[True, every[1:, 0] != every[:-1, 0]])
        rank = np.arange(len(every)) - np.repeat(starts, np.diff(np.r_[starts, len(every)]))
        self.found = every[rank < self.k]
        last = every[rank == self.k - 1]
        self.floor[last[:, 0]], self.full[last[:, 0]] = last[:, 1], True


def _same_label(a: _Block, b: _Block, s: np.ndarray, kept: _Kept) -> None:
    at, of = np.nonzero((a.labels[:, None] == b.labels[None, :]) & (a.rows[:, None] != b.rows[None, :]) & (~kept.full[:, None] | (s >= kept.floor[:, None])))
    kept.offer(at, s[at, of], b.ids[of], b.rows[of])


def _other_label(a: _Block, b: _Block, s: np.ndarray, kept: _Kept) -> None:
    """``limits`` holds the falling upper limits, then the lower ones; unused places hold the smallest long."""
    upper, lower = a.limits[:, :kept.slots], a.limits[:, kept.slots:]
    bottom = np.maximum(lower, np.c_[upper[:, 1:] + 1, np.full(len(upper), NOWHERE)])  # of each slot; windows of upper slots end higher
    wanted = np.where(upper > NOWHERE, np.where(kept.full.reshape(-1, kept.slots), kept.floor.reshape(-1, kept.slots), bottom), np.iinfo(np.int64).max)
    at, of = np.nonzero((s <= upper[:, :1]) & (s >= wanted.min(1)[:, None]) & (a.labels[:, None] != b.labels[None, :]))
    score = s[at, of]
    slot = (score[:, None] <= upper[at]).sum(1) - 1
    fine = score >= wanted[at, slot]
    at, of, score, slot = at[fine], of[fine], score[fine], slot[fine]
    kept.offer(at * kept.slots + slot, score, b.ids[of], b.rows[of])


def best_by_slot(anchors: DataFrame, rows: DataFrame, kernel: Callable, slots: int, k: int, *, anchors_per_cell: int, rows_per_cell: int) -> DataFrame:
    """-> ``FOUND`` rows: per anchor and slot the ``k`` best that ``kernel`` lets through. Both sides are ``blocks``.

    Every anchor group is copied to all row groups and every row group to all anchor groups, so the copies of a row grow with
    the anchors divided by ``anchors_per_cell``. Row groups widen beyond ``rows_per_cell`` where copying anchors would cost more.
    """
    n_a, n_r = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (anchors, rows))
    groups_a = max(1, -(-n_a // anchors_per_cell))
    groups_r = max(1, min(-(-n_r // rows_per_cell), max(64, groups_a * n_r // max(1, n_a))))
    spark = anchors.sparkSession
    parts = max(1, min(groups_a * groups_r, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4))
    group = lambda n: F.pmod(F.xxhash64("dim", "rows"), F.lit(n)).cast("int")
    left = anchors.withColumn("a", group(groups_a)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups_r - 1)))).withColumn("side", F.lit(0))
    right = rows.withColumn("r", group(groups_r)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(groups_a - 1)))).withColumn("side", F.lit(1))
    fields = ["dim", "rows", "ids", "labels", "width", "vectors", "limits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out():
            for a, kept in held:
                f = kept.found
                if len(f):
                    yield pa.RecordBatch.from_arrays([pa.array(a.rows[f[:, 0] // slots]), pa.array((f[:, 0] % slots).astype(np.int32)), pa.array(f[:, 1]), pa.array(f[:, 3]), pa.array(f[:, 2])],
                                                     ["row", "slot", "score", "other_row", "other_id"])

        for batch in batches:
            for row in batch.to_pylist():
                here = row["dim"], row["a"], row["r"]
                if here != cell:
                    yield from out()
                    cell, held = here, []
                block = _Block(*(row[f] for f in fields))
                if row["side"] == 0:
                    held.append((block, _Kept(len(block.rows), slots, k)))
                    continue
                for a, kept in held:
                    if kernel is _same_label and (a.highest < block.lowest or a.lowest > block.highest):
                        continue
                    if kernel is _other_label and a.lowest == a.highest == block.lowest == block.highest:
                        continue
                    kernel(a, block, scores(a, block), kept)
        yield from out()

    met = left.unionByName(right).repartition(parts, "dim", "a", "r").sortWithinPartitions("dim", "a", "r", "side").select("a", "r", "side", *fields)
    found = met.transform(arrow_map, run, FOUND)
    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other_id", "other_row")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block: int = 1024, anchors_per_cell: int = 65536, rows_per_cell: int = 8192) -> DataFrame:
    """-> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` are rows of ``vectors`` (from ``labelled_vectors``, written before so that ``row`` is settled). An anchor's positives are its ``positives``
    best other rows of its label by inner product; a positive's negatives are the ``negatives`` best rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's. Higher scores first, ties to smaller ids. Rows that repeat an id are rows
    of their own; only vectors with equally many components meet; an anchor without positives or negatives gives no rows.

    A limit is whole: 100 * score <= high * positive means score <= floor(high * positive / 100). Negative positives have empty windows.
    """
    rows = written(blocks(vectors, block))
    sizes = {"anchors_per_cell": anchors_per_cell, "rows_per_cell": rows_per_cell}
    near = best_by_slot(written(blocks(anchors, block)), rows, _same_label, 1, positives, **sizes)
    share = lambda percent, whole: whole(F.col("score").cast("decimal(20,0)") * percent / 100).cast("long")
    own = near.select("row", F.struct("place", "score", F.col("other_id").alias("id"), share(high, F.floor).alias("upper"), share(low, F.ceil).alias("lower")).alias("p"))
    mine = own.groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("p"))  # at most ``positives``
    filled = lambda field: F.concat(F.transform("p", lambda p: p[field]), F.array_repeat(F.lit(NOWHERE), F.lit(positives) - F.size("p")))
    asked = written(anchors.join(mine, "row").withColumn("limits", F.concat(filled("upper"), filled("lower"))))
    found = best_by_slot(written(blocks(asked.select("row", "vec_id", "label", "v", "limits"), block, 2 * positives)), rows, _other_label, positives, negatives, **sizes)
    slots = found.groupBy("row").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), F.col("other_id").alias("id"))).alias("s"))  # at most positives * negatives

    def merged(s, n):
        """Entry i: the best of slots i and below, from the lowest slot up."""
        empty = F.array().cast("array<array<struct<slot:int,minus:bigint,id:bigint>>>")
        order = lambda x, y: F.when(x["minus"] < y["minus"], -1).when(x["minus"] > y["minus"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)

        def step(done, i):
            lower = F.when(F.size(done) > 0, done[0]).otherwise(F.array().cast("array<struct<slot:int,minus:bigint,id:bigint>>"))
            here = F.filter(s, lambda x: x["slot"] == i)
            return F.concat(F.array(F.slice(F.array_sort(F.concat(here, lower), order), 1, negatives)), done)

        return F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), empty, step)

    answers = asked.select("row", "vec_id", "p").join(slots, "row").withColumn("windows", merged(F.col("s"), F.size("p")))
    pairs = answers.select(F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("i", "p"), "windows").select("anchor_id", "p", F.posexplode(F.col("windows")[F.col("i")]).alias("j", "x"))
    return (pairs.where(-F.col("x.minus") >= F.col("p.lower")).select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("j") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), (-F.col("x.minus")).alias("negative_score")))


@query("op11_hard_negatives", """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
      FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op11(t):
    vectors = labelled_vectors(t("embeddings"))
    vectors = written(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))
