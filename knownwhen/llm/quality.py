"""Compression classifier: text that compresses better beside good examples than beside bad ones is good.

Two zstandard dictionaries are trained, on pieces of good and of bad labelled texts. A text's features are its
compressed sizes with either dictionary: their difference per byte, their difference relative to their sum, and the
size per byte. A logistic curve fitted on other labelled texts turns them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, query, slices, uniform

LEVEL = 3


def held_out(id: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 1 when divided by 3. Null ids are not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Dictionary bytes (bad, good) and the logistic curve over standardised features."""

    dictionaries: tuple[bytes, bytes]
    trained: tuple[bool, bool]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data, trained in zip(self.dictionaries, self.trained):
            kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            extra = {"dict_data": zstandard.ZstdCompressionDict(data, dict_type=kind)} if data else {}
            if data:
                extra["dict_data"].precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra))
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(_design((features - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights), -35, 35)
        return 1.0 / (1.0 + np.exp(-z))


def _features(compressors, texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), 3))
    for row, text in enumerate(texts):
        data = (text or "").encode()
        if data:
            bad, good = (len(c.compress(data)) for c in compressors)
            out[row] = (bad - good) / len(data), (bad - good) / (bad + good), good / len(data)
    return out


def _design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z[:, 2] ** 2, z[:, 1] * z[:, 2]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Damped Newton steps of a ridge-penalised logistic fit; with one class only, the curve is flat at its (smoothed) share."""
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1])
    w[0] = np.log(share / (1 - share))
    if y.min(initial=1) == y.max(initial=0):
        return w
    penalty = ridge * np.r_[0, np.ones(x.shape[1] - 1)]
    loss = lambda v: (np.logaddexp(0, x @ v) - y * (x @ v)).sum() + 0.5 * (penalty * v**2).sum()
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        if not new < now - 1e-9:
            break
        w, now = w + step, new
    return w


def _dictionary(pieces: list[bytes], size: int) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes(), True
    except zstandard.ZstdError:  # too few pieces to train on: they are the dictionary themselves
        return b"".join(pieces)[-size:], False


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id: str = "doc_id", label: str = "quality",
        pieces: int = 6000, piece_chars: int = 512, dictionary_bytes: int = 110_000, calibration_rows: int = 20_000) -> Model:
    """Learns from labelled rows that are not ``held_out``.

    Documented bounds of the sample, drawn by a hash of the id: about ``pieces`` labelled texts of each class are cut into pieces
    of ``piece_chars``, of which ``pieces`` go into its dictionary; about ``calibration_rows`` other texts, whole, fit the curve.
    Only pieces and feature numbers reach the driver. Null labels, ids and texts teach nothing; an id labelled both
    ways counts on both sides. Without any label the score is 0.5 everywhere.
    """
    marks = (labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").distinct()
             .where(~held_out(F.col("__id"))).withColumn("__u", uniform("quality", F.col("__id"))))
    sizes = {r["__y"]: r["n"] for r in marks.where("__u < 0.5").groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest = marks.where("__u >= 0.5").count()
    source = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text")).where("__text is not null")
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("__y") == y, F.lit(0.5 * min(1.0, pieces / n))).otherwise(share)
    chosen = marks.where((F.col("__u") < share) & (F.col("__u") < 0.5))
    cut = F.posexplode(F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{piece_chars}}}"), F.lit(0))).alias("pos", "piece")
    pool = source.join(F.broadcast(chosen), "__id").select("__y", "__id", cut).withColumn("__u", uniform("piece", F.col("__id"), F.col("pos")))
    found = {y: pool.where(F.col("__y") == y).orderBy("__u", "piece").limit(pieces).collect() for y in (0, 1)}
    made = [_dictionary([r["piece"].encode() for r in found[y]], dictionary_bytes) for y in (0, 1)]
    model = Model(tuple(m[0] for m in made), tuple(m[1] for m in made), (0.0,) * 6, (0.0,) * 3, (1.0,) * 3)
    some = marks.where((F.col("__u") >= 0.5) & (F.col("__u") < 0.5 + 0.5 * min(1.0, calibration_rows / max(rest, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for piece, texts in slices(batches, 1):
            f = _features(compressors, texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(f[:, k]) for k in range(3))], ["y", "a", "b", "c"])

    seen = source.join(F.broadcast(some), "__id").select("__y", "__text").transform(arrow_map, run, "y int, a double, b double, c double").collect()
    x, y = np.array([[r["a"], r["b"], r["c"]] for r in seen]).reshape(-1, 3), np.array([r["y"] for r in seen], float)
    if not len(y):
        return model
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    weights = _logistic(_design((x - mean) / scale), y)
    return Model(model.dictionaries, model.trained, tuple(weights), tuple(mean), tuple(scale))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the probability that a text is good. All whole texts are scored, in place and
    without a shuffle; a null text scores as an empty one. Repeated rows score alike; an existing ``out`` is replaced."""
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for piece, texts in slices(batches, len(kept)):
            p = model.probability(_features(compressors, texts))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(p)], [*kept, out])

    return docs.select(*kept, F.col(text).cast("string").alias("__text")).transform(arrow_map, run, schema)


@query("op6_compression_quality")
def op6(t):
    docs = t("documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, t("labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
