"""Substring dedup by sliding runs of sentences.

A sentence ends with a word that closes with ``.``, ``!`` or ``?`` (also before closing quotes and brackets), or at a line break. Around
every sentence the shortest runs of consecutive sentences with at least ``least`` words are taken, the one that starts with it and
the one that ends with it: mostly several sentences, a single one where it is long. Each run is hashed over its words
(A-Z in lower case, white space ignored); equal hashes meet globally, and the sentences of every run but the first go. A repeated passage
goes where whole sentences within it have ``least`` words together; the sentences that its ends cut stay, and so does a passage
that holds no such run, as one within two long sentences. The 8 words of the default keep those few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, query, slices, written
from .ngrams import mix, word_hashes

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
SALTS = 64
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?"]] = True
CLOSES = np.zeros(256, bool)
CLOSES[[ord(c) for c in "\"')]}"]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, one after the other: (text number, first word, word after the last, first byte within its text) of each sentence, and the hash of each word."""
    sizes = np.array([len(t) + 1 for t in texts])
    offsets = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, words = word_hashes(data)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, none, words
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    end = np.flatnonzero(np.diff(np.concatenate((blank, [True])).view(np.int8)) == 1) + 1 if not blank[-1] else np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    last = data[end - 1]
    before = data[np.maximum(end - 2, start)]
    lines = np.cumsum(data == 10)
    text = np.searchsorted(offsets, start, "right") - 1
    stop = ENDS[last] | (CLOSES[last] & ENDS[before])
    stop[:-1] |= (lines[start[1:]] != lines[start[:-1]])
    stop[-1] = True
    to = np.flatnonzero(stop) + 1
    since = np.concatenate(([0], to[:-1]))
    return text[since], since, to, start[since] - offsets[text[since]], words


def runs(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, first sentence, last sentence) of each run, sentences counted within their text; and the number of sentences of each text."""
    text, since, to, _, words = sentences(texts)
    counts = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    if not len(text):
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, counts
    each = np.arange(len(text))
    ahead = np.searchsorted(to, since + least)  # the first sentence that ends late enough
    back = np.searchsorted(since, to - least, "right") - 1  # the last one that starts early enough
    a, b = np.concatenate((each, np.maximum(back, 0))), np.concatenate((np.minimum(ahead, len(text) - 1), each))
    fine = np.concatenate((ahead < len(text), back >= 0)) & (text[a] == text[b])
    pairs = np.unique((a[fine] << 32) | b[fine])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    up, down = _powers(1 << max(19, int(len(words) + 1).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    hashes = mix((total[to[b]] - total[since[a]]) * down[since[a]] + (to[b] - since[a]).astype(np.uint64))
    first = np.cumsum(counts) - counts
    return text[a], hashes, a - first[text[a]], b - first[text[a]], counts


def _runs(docs: DataFrame, least: int, hot: np.ndarray) -> DataFrame:
    """(id, key, data) -> (h, salt, id, key, a, b): the runs of each text; frequent runs are salted by their text, others have salt -1."""
    schema = "h long, salt int, id %s, key long, a int, b int" % docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for piece, texts in slices(batches, 2, 1 << 20):
                text, hashes, a, b, _ = runs([t or b"" for t in texts], least)
                keys = piece.column(1).to_numpy(zero_copy_only=False)[text]
                often = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes if len(hot) else np.zeros(len(hashes), bool)
                salt = np.where(often, keys % SALTS, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(salt), piece.column(0).take(pa.array(text)), pa.array(keys), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["h", "salt", "id", "key", "a", "b"])

    return docs.select("id", "key", "data").transform(arrow_map, run, schema)


def _frequent(docs: DataFrame, least: int, sample: int, limit: int) -> np.ndarray:
    """Runs found in many of about ``sample`` texts (a bounded sample). They are only spread differently."""
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for _, texts in slices(batches, 0, 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(runs([t or b"" for t in texts], least)[1].view(np.int64))], ["h"])

    counts = some.select("data").transform(arrow_map, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= max(8, int(0.005 * sample)))
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("c"), "h").limit(limit).collect()], np.int64).view(np.uint64))


def _cut(rows: DataFrame) -> DataFrame:
    """(id, data, spans) -> (id, n_sentences, n_repeated, n_removed, kept): the texts without the sentences of runs that are not first."""
    schema = rows.select("id").schema.add("n_sentences", "long").add("n_repeated", "long").add("n_removed", "long").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for piece, texts in slices(batches, 1, 1 << 20):
                out = ([], [], [], [])
                texts = [t or b"" for t in texts]
                number, _, _, at, _ = sentences(texts)
                counts = np.bincount(number, minlength=len(texts)) if len(number) else np.zeros(len(texts), np.int64)
                since = np.cumsum(counts) - counts
                for k, (t, spans) in enumerate(zip(texts, piece.column(2).to_pylist())):
                    n = int(counts[k])
                    gone, seen = np.zeros(n, bool), np.zeros(n, bool)
                    for s in spans or ():
                        seen[s["a"]: s["b"] + 1] = True
                        if not s["first"]:
                            gone[s["a"]: s["b"] + 1] = True
                    if gone.any():
                        edges = [*at[since[k]: since[k] + n].tolist(), len(t)]
                        t = t[: edges[0]] + b"".join(t[edges[j]: edges[j + 1]] for j in np.flatnonzero(~gone))
                    for column, value in zip(out, (n, int(seen.sum()), int(gone.sum()), t.decode())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], schema.names)

    return rows.select("id", "data", "spans").transform(arrow_map, run, schema)


def dedup_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", *, least: int = 8, sample: int = 4000, limit: int = 100_000) -> DataFrame:
    """-> (``id``, n_sentences, n_repeated, n_removed, kept), one row per input row.

    A run of sentences is first at the smallest place (id, sentence number; null ids first) that has its hash; sentences covered by a run that
    is not first are removed, those covered by any repeated run are counted in ``n_repeated``. Rows with equal ids are versions of one
    document: equal runs at equal places of them count as one place. Null and empty texts have no sentences; their kept text is empty.
    Texts below ``least`` words have no runs and stay.

    Runs are dealt by their hash, frequent ones (from a bounded sample) by hash and text: each part finds its own first place, and the
    first places of a frequent run's parts are compared after that. The result does not depend on the sample.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data")).withColumn("key", F.xxhash64("data"))
    found = _runs(rows, least, _frequent(rows, least, sample, limit)).repartition("h", "salt")
    place = F.struct("id", "a")
    first = found.groupBy("h", "salt").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1 or salt >= 0")
    repeated = written(found.join(first, ["h", "salt"]).select("h", "salt", "id", "key", "a", "b", (place == F.col("at")).alias("first")))
    parts = repeated.where("salt >= 0 and first")
    best = parts.groupBy("h").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("parts"))
    leading = parts.join(best, "h").select("id", "key", "a", "b", (place == F.col("best")).alias("first"))
    flat = repeated.where("salt < 0 or not first").select("id", "key", "a", "b", "first").union(leading)
    spans = flat.groupBy("id", "key").agg(F.collect_set(F.struct("a", "b", "first")).alias("spans"))
    spans = spans.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans")
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select("id", "data", "spans")
    return _cut(joined).withColumnRenamed("id", id)


@query("op8_sentence_spans")
def op8(t):
    out = dedup_spans(t("documents"))
    return out.select("doc_id", "n_sentences", "n_repeated", "n_removed", F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))
