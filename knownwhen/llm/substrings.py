"""Removal of long byte strings that occur more than once, by sparse suffix sorting with bucket refinement.

The suffixes that matter are those at least ``length`` bytes long, compared to that depth. They are first put into q-gram
buckets: a window of ``length`` bytes belongs to the bucket of its smallest-hashed q-gram (the last of ties), so equal
windows meet in one bucket, at the same distance from that q-gram, and the windows of a text form a few runs, each of one
bucket. Only buckets in which two places meet go on, with the bytes around them. Inside a bucket, windows are refined by
doubling: the identifier of 2L bytes at i is made of the identifier of L bytes at i and that at the later offset i + L,
which has been refined before; sorting on the last identifiers leaves the classes of equal windows.

Identifiers are 64-bit digests instead of ranks: equal strings have equal ones in every task, so a round needs no
renumbering across the cluster. Nothing holds more than one bucket at a time; buckets beyond a limit are refined to
single windows and counted by a pre-aggregated grouping instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import arrow_map, query, slices, written

_U = np.uint64
RUN = StructType().add("q", LongType()).add("pos", IntegerType()).add("start", IntegerType()).add("n", IntegerType())


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Identifier of a bucket made of two bucket identifiers."""
    x = a * _U(0xD6E8FEB86659FD93 + 2 * level) + (b ^ (b >> _U(29)))
    x ^= x >> _U(32)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(29)
    return x


def identifiers(data: np.ndarray, length: int) -> np.ndarray:
    """Identifier of the ``length`` bytes at each place of ``data`` that has as many."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    x, size, level = _bytes()[data], 1, 0
    while 2 * size <= length:
        x, size, level = _pair(x[:-size], x[size:], level), 2 * size, level + 1
    return _pair(x[: len(data) - length + 1], x[length - size:], level) if size < length else x


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size:]) if size < width else x


def runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one bucket: (text number, bucket, place of its q-gram, first window, number of windows)."""
    none = np.empty(0, np.int64)
    sizes = np.array([len(t) for t in texts])
    if not (sizes >= length).any():
        return none, none, none, none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    grams = identifiers(data, gram)
    tagged = (grams & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    least = _sliding_min(tagged, length - gram + 1)
    offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    windows = np.maximum(0, sizes - length + 1)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[text]
    place = (_U(0xFFFFFFFF) - (least[at] & _U(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.concatenate((first, [len(at)])))
    text, start, place = text[first], at[first], place[first]
    return text, grams[place].view(np.int64), place - offsets[text], start - offsets[text], n


def bucketed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, key, data binary) -> (id, key, n_bytes, runs). Within a task, equal texts (equal keys) give their runs once."""
    schema = docs.select("id", "key").schema.add("n_bytes", "long").add("runs", ArrayType(RUN))
    fields = [pa.field("q", pa.int64()), pa.field("pos", pa.int32()), pa.field("start", pa.int32()), pa.field("n", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for piece, texts in slices(batches, 2, 1 << 19):
                fresh = []
                for key, t in zip(piece.column(1).to_pylist(), texts):
                    fresh.append(b"" if key in seen else t or b"")
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(key)
                text, q, pos, start, n = runs(fresh, length, gram)
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(q, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (pos, start, n))], fields=fields)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([len(t or b"") for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows)], schema.names)

    return docs.select("id", "key", "data").transform(arrow_map, run, schema)


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """(key, data, runs) -> (q, key, start, n, bytes): the bytes that the windows of each run span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, 1):
            key, q, start, n, span = [], [], [], [], []
            for k, t, found in zip(piece.column(0).to_pylist(), texts, piece.column(2).to_pylist()):
                for r in found:
                    key.append(k)
                    q.append(r["q"])
                    start.append(r["start"])
                    n.append(r["n"])
                    span.append(t[r["start"]: r["start"] + r["n"] + length - 1])
                    if len(key) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(span, pa.binary())], ["q", "key", "start", "n", "span"])
                        key, q, start, n, span = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(span, pa.binary())], ["q", "key", "start", "n", "span"])

    return rows.select("key", "data", "runs").transform(arrow_map, run, "q long, key long, start int, n int, span binary")


def _windows(spans: list[bytes], n: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the first ``n`` windows of each span, one after the other."""
    sizes = np.array([len(s) for s in spans])
    offsets = np.cumsum(sizes) - sizes
    at = np.arange(int(n.sum())) + np.repeat(offsets - (np.cumsum(n) - n), n)
    return identifiers(np.frombuffer(b"".join(spans), np.uint8), length)[at]


def _repeated(q: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray, spans: list[bytes], length: int) -> pa.RecordBatch:
    """Byte ranges under windows that have an equal one among these whole buckets."""
    ids = _windows(spans, n, length)
    order = np.sort(ids)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    hit = twice[np.minimum(np.searchsorted(twice, ids), len(twice) - 1)] == ids if len(twice) else np.zeros(len(ids), bool)
    run = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    begins = hit & ~np.concatenate(([False], hit[:-1] & (run[1:] == run[:-1]))) if len(hit) else hit
    ends = hit & ~np.concatenate((hit[1:] & (run[1:] == run[:-1]), [False])) if len(hit) else hit
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    return pa.RecordBatch.from_arrays([pa.array(key[run[a]]), pa.array((start[run[a]] + local[a]).astype(np.int32)), pa.array((start[run[b]] + local[b] + length).astype(np.int32))], ["key", "a", "b"])


def _refined(contexts: DataFrame, length: int, windows: int = 1 << 18) -> DataFrame:
    """(q, key, start, n, span) -> (key, a, b): repeated byte ranges; whole buckets are handled together, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if total >= windows and row[0] != held[-1][0]:
                        q, key, start, n, span = zip(*held)
                        yield _repeated(np.array(q), np.array(key), np.array(start), np.array(n), list(span), length)
                        held, total = [], 0
                    held.append(row)
                    total += row[3]
            if held:
                q, key, start, n, span = zip(*held)
                yield _repeated(np.array(q), np.array(key), np.array(start), np.array(n), list(span), length)

    return contexts.repartition(F.col("q")).sortWithinPartitions("q").transform(arrow_map, run, "key long, a int, b int")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for a task: one row per window, counted with map-side combining."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    _, key, start, n, span = (c.to_pylist() for c in batch.slice(at, 256).columns)
                    n = np.array(n)
                    local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(_windows(span, n, length).view(np.int64)), pa.array(np.repeat(np.array(key), n)), pa.array((np.repeat(np.array(start), n) + local).astype(np.int32))], ["w", "key", "a"])

    rows = written(contexts.transform(arrow_map, run, "w long, key long, a int"))
    twice = rows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w")
    return rows.join(twice, "w").select("key", "a", (F.col("a") + length).alias("b"))


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """(id, data, copies, spans) -> (id, n_bytes, n_removed, n_spans, kept binary)."""
    schema = rows.select("id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, 1):
            out = ([], [], [], [])
            for t, copies, spans in zip(texts, piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                t, kept, at, n = t or b"", [], 0, 0
                end = 0
                found = [(0, len(t))] if copies > 1 and len(t) >= length else sorted((s["a"], s["b"]) for s in spans or ())
                for a, b in found:
                    if a > end or not n:
                        kept.append(t[at:a])
                        n += 1
                    end = at = max(end, b)
                kept = b"".join([*kept, t[at:]])
                for column, value in zip(out, (len(t), len(t) - len(kept), n, kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], schema.names)

    return rows.select("id", "data", "copies", "spans").transform(arrow_map, run, schema)


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", *, length: int = 400, gram: int = 32, bucket: int = 30_000) -> DataFrame:
    """-> (``id``, n_bytes, n_removed, n_spans, kept binary), one row per input row.

    Removes each UTF-8 byte covered by a ``length``-byte string that also starts anywhere else, in any row, the same one included;
    strings never cross rows and are judged on the input. ``n_spans`` counts maximal removed runs. Null and
    empty texts have no bytes; texts below ``length`` bytes stay whole. Equal texts are copies of one another (all of their bytes
    go, if long enough) and are refined once. Rows with equal or null ids are rows of their own. Buckets with more than ``bucket`` places
    take the counted way.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id).alias("id"), data.alias("data")).withColumn("key", F.xxhash64("data"))
    table = written(bucketed(rows, length, gram))
    texts = table.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    places = table.where("n_bytes >= %d" % length).select("key", F.inline("runs")).repartition(F.col("q")).distinct()
    met = places.groupBy("q").agg(F.count(F.lit(1)).alias("places")).where("places > 1")
    hits = written(places.join(met, "q"))
    large = hits.where(F.col("places") > bucket).limit(1).count() > 0
    asked = hits.groupBy("key").agg(F.collect_list(F.struct("q", "pos", "start", "n")).alias("runs")).join(texts, "key")
    asked = asked.select(F.col("key").alias("k"), "runs", "rep")
    found = rows.join(asked, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("rep")))
    contexts = _contexts(found, length)
    if large:
        contexts = written(contexts)
        hot = hits.where(F.col("places") > bucket).select("q").distinct()
        spans = _refined(contexts.join(hot, "q", "left_anti"), length).union(_counted(contexts.join(hot, "q", "left_semi"), length))
    else:
        spans = _refined(contexts, length)
    gone = written(spans).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    state = texts.where("copies > 1").select("key", "copies").join(gone, "key", "full").select(F.col("key").alias("k"), F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    judged = rows.join(state, F.col("key") == F.col("k"), "left").select("id", "data", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    return _cut(judged, length).withColumnRenamed("id", id)


@query("op7_suffix_dedup")
def op7(t):
    """The contract's digest columns and the kept text itself; bytes of characters that were cut in two read as U+FFFD there."""
    out = remove_repeats(t("documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
