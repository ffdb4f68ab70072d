"""Jaccard self-join of word n-gram sets by PartEnum signatures.

Sizes are split into bands of ratio 4/3, so that linked sets stand in one band or in neighbouring ones. For each such pair of
bands the Hamming distance of linked sets has a largest value k. The feature domain is cut into more than k partitions; a
set's signatures are the enumerated partitions with the features that it has there. Two linked sets differ in at most k
partitions, so they share the signature of another. Up to ``SIGNATURES`` partitions all of them are enumerated and the guarantee is
strict (sets whose features crowd into too few partitions are dealt again under other hashes). Where k is larger, the first
``SIGNATURES`` partitions of the k + 1 are enumerated: differing features fall on partitions by hash, a partition is free of them
with a chance of at least 1/e, and a linked pair at the threshold has no usable common signature with a chance of some 1e-9.

Signatures that many sets share, as those of passages and lines found everywhere, would compare all these sets. They are left
out for every set that keeps enough others for the guarantee (k + 1 where all partitions are enumerated, else ``NEEDED``); only the few
that don't, such as members of a large group of near copies, still meet under them.

Equal sets are one node. Candidate pairs first compare parity words, whose difference bounds that of the sets from below; feature arrays move
for pairs that pass. Sets under a signature are compared with its smallest member first. Where different components are
left under it after that, small buckets give their pairs. The sets of large ones, which common passages brought together, meet once more
under their rarest features only (``_crowded``): exact, and without the pairs of the bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import arrow_map, query, slices, written
from .graph import components

SIGNATURES = 64
NEEDED = 48
SEEDS = 4  # hashes tried for sets whose features crowd into few partitions
PARITY = 1024  # bits of a set's parity word
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random word for each (lower-cased) byte; which bytes are white space."""
    words = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    words[65:91] = words[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    words[space] = 0
    return words, space


@lru_cache(maxsize=1)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of a byte array (white space: blank, tab to carriage return; A-Z lower-cased)."""
    words, space = _tables()
    blank = space[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = 1 << max(21, int(len(data) + 1).bit_length())  # one table for all pieces of usual size
    up, down = _powers(n, int(_BASE) | 5)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words[data] * up[: len(data)], dtype=np.uint64)))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def feature_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct ``size``-word shingles of each text; of the whole word sequence where it is shorter."""
    if not texts:
        return []
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    start, words = word_hashes(data)
    bounds = np.concatenate(([0], np.searchsorted(start, ends)))
    c = [mix(np.array([size * 31 + k + 1], np.uint64) * _BASE)[0] | _U(1) for k in range(size)]
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        runs += words[k: len(runs) + k] * c[k]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            h = np.sort(runs[a: b - size + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            whole = sum(int(w) * int(m) for w, m in zip(words[a:b], c)) + int(b - a)
            out.append(mix(np.array([whole & (2**64 - 1)], np.uint64) ^ _BASE))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@lru_cache(maxsize=None)
def band(n: int, percent: int) -> int:
    """Number of the size band that holds n."""
    low, k = 1, 0
    while (high := low * 100 // percent + 1) <= n:
        low, k = high, k + 1
    return k


@lru_cache(maxsize=None)
def partitions(instance: int, percent: int) -> tuple[int, int]:
    """(k, number of partitions) for linked sets the smaller of which is in this band."""
    low = 1
    for _ in range(instance):
        low = low * 100 // percent + 1
    top = low * 100 // percent
    k = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    return k, max(k + 1, min(SIGNATURES, 3 * (k + 1) + 5))


def _enumerate(h: np.ndarray, instance: int, seed: int, count: int) -> np.ndarray:
    """Signatures of the first partitions in which the set has features."""
    spread = np.sort(mix(h + _U(seed) * _BASE)) if seed else h
    m = min(count, SIGNATURES)
    part = ((spread >> _U(32)) * _U(count)) >> _U(32)  # rising, as the hashes are
    at = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(spread[: at[-1]] ^ _BASE), dtype=np.uint64)))
    some = np.flatnonzero(at[1:] > at[:-1])
    tag = mix(np.array([instance * 64 + seed + 1], np.uint64) * _BASE)[0]
    return mix((total[at[some + 1]] - total[at[some]]) ^ mix((some + 1).astype(np.uint64) * _BASE + tag))


def signatures(h: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Of a feature set, for its own band and for the next lower one: its signatures, and how many of them it can spare."""
    out, own = [], band(len(h), percent) if len(h) else 0
    for instance in (own, own - 1):
        if instance < 0 or not len(h):
            out.append((np.empty(0, np.uint64), 0))
            continue
        k, count = partitions(instance, percent)
        if count > SIGNATURES:
            got = _enumerate(h, instance, 0, count)
            out.append((np.unique(got), len(got) - NEEDED))
            continue
        parts = []
        for seed in range(SEEDS):  # again under another hash, until enough partitions have features
            parts.append(_enumerate(h, instance, seed, count))
            if len(parts[-1]) > k:
                break
        else:
            parts.append(mix(np.array([instance + 1], np.uint64) * _BASE))
        out.append((np.unique(np.concatenate(parts)), len(parts[-1]) - k - 1 if len(parts) == 1 else -1))
    return out


def _set_id(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, text) -> (id, n, set, sigs, spare): set size, set identity, signatures and the number that can be spared, the last two for either band.

    Within a task a set gives its signatures once.
    """
    pairs = {"sigs": ArrayType(ArrayType(LongType())), "spare": ArrayType(LongType())}
    schema = docs.select("id").schema.add("n", "long").add("set", "long").add("sigs", pairs["sigs"]).add("spare", pairs["spare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for piece, texts in slices(batches, 1, 1 << 20):
                sets = feature_sets(texts, size)
                ids = [_set_id(h) if len(h) else None for h in sets]
                flat, spare = [], []
                for h, i in zip(sets, ids):
                    new = i is not None and i not in seen
                    for got, left in signatures(h if new else h[:0], percent):
                        flat.append(got.view(np.int64))
                        spare.append(left)
                    if new:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(i)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in flat]))).astype(np.int32)
                inner = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat)))
                two = np.arange(0, 2 * len(sets) + 1, 2, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(two, inner),
                                                  pa.ListArray.from_arrays(two, pa.array(spare, pa.int64()))], schema.names)

    return docs.select("id", "text").transform(arrow_map, run, schema)


def _parity(h: np.ndarray) -> bytes:
    """Of each class of a set's features, whether their number is odd. Two sets differ in at least as many features as these words do in bits."""
    return np.packbits(np.bincount((mix(h ^ _BASE) >> _U(32)) % _U(PARITY), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def _payload(docs: DataFrame, size: int) -> DataFrame:
    """(text) -> (set, parity binary, features binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for _, texts in slices(batches, 0, 1 << 20):
                sets = [h for h in feature_sets(texts, size) if len(h)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in sets], pa.int64()), pa.array([_parity(h) for h in sets], pa.binary()),
                                                  pa.array([h.tobytes() for h in sets], pa.binary())], ["set", "parity", "features"])

    return docs.select("text").transform(arrow_map, run, "set long, parity binary, features binary")


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) -> (a, b): without pairs whose parity words alone show that they differ in too many features. Never drops a linked pair;
    it keeps the feature arrays of most candidates, which meet by chance, out of the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, PARITY // 64) for k in (3, 4))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * apart <= (100 - percent) * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, name: sets.select(F.col("set").alias(k), F.col("parity").alias(name))
    met = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("n")).join(side("b", "y"), "b").join(side("a", "x"), "a")
    return met.select("a", "b", "n", "x", "y").transform(arrow_map, run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> those whose sets are similar enough, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("set").alias("a"), F.col("features").alias("x")), sets.select(F.col("set").alias("b"), F.col("features").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").transform(arrow_map, run, "a long, b long")


def _rare_first(sets: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """(set) -> (f, set, n, rest, own): the features under which linked sets of the crowd must meet.

    Each set's features are ordered from the rarest in the crowd to the most frequent. If two sets link, the larger one's first n - ceil(p n) + 1
    features and the smaller one's first n - ceil(2 p n / (1 + p)) + 1 (``own``) have one in common. ``rest`` counts the features from that place on.
    Features of one set are no keys, they only take up places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            count = np.array([len(r) // 8 for r in raw], np.int64)
            columns = np.repeat(batch.column(0).to_numpy(), count), np.repeat(count, count), np.frombuffer(b"".join(raw), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["set", "n", "f"])

    each = sets.join(crowd, "set", "left_semi").select("set", "features").transform(arrow_map, run, "set long, n long, f long")
    often = each.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("f"))).where("often > 1")
    ordered = often.groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("often", "f"))).alias("l")).withColumn("alone", F.col("n") - F.size("l"))
    probe = f"n - (n * {percent} + 99) div 100 + 1"
    own = f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1"
    return (ordered.select("set", "n", "alone", F.posexplode(F.expr(f"slice(l, 1, cast(greatest({probe} - alone, 0) as int))")).alias("place", "x"))
            .select(F.col("x.f").alias("f"), "set", "n", F.expr("n - alone - place").alias("rest"), F.expr(f"alone + place < {own}").alias("own")))


def _crowded(crowd: DataFrame, linked: DataFrame, sets: DataFrame, percent: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``linked`` and the further links (a, b) that join components of the crowd (set, component): sets that common signatures can't tell apart.

    Under each of its rare features a set first meets the smallest owner only; what still stands in different components then meets where sizes
    and the features left at both places allow a link. No pair is made that these bounds exclude.
    """
    keyed = written(_rare_first(sets, crowd, percent).join(crowd, "set"))
    hubs = keyed.where("own").groupBy("f").agg(F.min(F.struct("set", "component")).alias("hub"))
    stars = keyed.join(hubs, "f").where("component <> hub.component").select(F.col("hub.set").alias("a"), F.col("set").alias("b")).distinct()
    linked = written(linked.union(_verified(near(stars), sets, percent)))
    now = keyed.drop("component").join(components(linked).select(F.col("id").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    now = written(now)
    mixed = now.groupBy("f").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("f")
    side = lambda k: now.select("f", *[F.col(c).alias(f"{c}{k}") for c in ("set", "n", "rest", "own", "component")])
    # The features left at its place bound the larger set that a set may meet; both meet under the narrow bands of sizes in question only.
    size = lambda n: f"cast(floor(ln({n}) / ln(1.02D)) as int)"
    most = f"least(resta * {100 + percent} div {percent} - na, na * 100 div {percent})"
    owners = side("a").where("owna").join(mixed, "f").where(f"{most} >= na").withColumn("band", F.expr(f"explode(sequence({size('na')}, {size(most)}))"))
    others = side("b").where(f"restb * {100 + percent} div {percent} - nb >= nb * {percent} div 100").withColumn("band", F.expr(size("nb")))
    met = owners.join(others, ["f", "band"]).where("componenta <> componentb and (na < nb or na = nb and seta < setb)")
    met = met.where(f"100 * na >= {percent} * nb and least(resta, restb) * {100 + percent} >= {percent} * (na + nb)")
    pairs = met.select(F.col("seta").alias("a"), F.col("setb").alias("b"), "na", "nb").distinct()
    return linked.union(_verified(_plausible(pairs, sets, percent), sets, percent))


def similar_components(docs: DataFrame, text: str = "text", id: str = "doc_id", *, words: int = 5, percent: int = 75, bucket: int = 64, small: int = 2_000_000) -> DataFrame:
    """-> (``id``, n_shingles, component_id), one row per input row.

    Texts link when their sets of ``words``-word shingles have a Jaccard similarity of at least ``percent`` / 100, in whole numbers;
    ``component_id`` is the smallest id reachable over links, its own included. Texts of fewer words are one shingle; null, empty and
    blank texts are empty sets and link with nothing. Rows with equal ids are judged row by row; a null id takes no part and has a null
    component. Signatures shared by more than ``bucket`` different sets count as common. Texts of candidate sets are read again through
    a broadcast of their ids while there are at most ``small`` of them, else through a shuffled join.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    table = written(sketches(rows, words, percent))
    reps = table.where("set is not null and id is not null").groupBy("set").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    emitted = table.where("id is not null").select("set", F.posexplode("sigs").alias("side", "list"))
    members = emitted.select(F.explode("list").alias("sig"), "set", "side").repartition(F.col("sig")).distinct()
    shared = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo < hi").select("sig", "size")
    met = written(members.join(shared, "sig"))
    spare = table.where("id is not null").select("set", F.posexplode("spare").alias("side", "spare"))
    crowded = met.where(F.col("size") > bucket).groupBy("set", "side").agg(F.count(F.lit(1)).alias("over"))
    needy = crowded.join(spare.groupBy("set", "side").agg(F.max("spare").alias("spare")), ["set", "side"]).where("over > spare").select("set", "side")
    plain = met.where(F.col("size") <= bucket).select("sig", "set")
    still = written(plain.union(met.where(F.col("size") > bucket).join(needy, ["set", "side"], "left_semi").select("sig", "set")))
    hubs = still.groupBy("sig").agg(F.min("set").alias("hub"), F.max("set").alias("last")).where("hub < last").select("sig", "hub")
    buckets = written(still.join(hubs, "sig"))
    wanted = written(buckets.select("set").distinct().join(reps, "set"))
    hint = F.broadcast if wanted.count() <= small else (lambda x: x)
    sets = written(_payload(rows.join(hint(wanted.select(F.col("rep").alias("id")).distinct()), "id", "left_semi"), words).dropDuplicates(["set"]))
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    sizes = lambda side: wanted.select(F.col("set").alias(side), F.col("n").alias(f"n{side}"), F.col("rep").alias(f"rep_{side}"))
    sized = lambda pairs: pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(fits)
    near = lambda pairs: _plausible(sized(pairs), sets, percent)
    stars = written(near(buckets.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()))
    linked = written(_verified(stars, sets, percent))
    labels = components(linked)
    marked = buckets.select("sig", "set").join(labels.select(F.col("id").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    counted = marked.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig", "size")
    mixed = written(marked.join(counted, "sig"))
    open_ = mixed.where(F.col("size") <= bucket)
    other = open_.select("sig", F.col("set").alias("b"), F.col("component").alias("cb"))
    rest = (open_.select("sig", F.col("set").alias("a"), F.col("component").alias("ca")).join(other, "sig").where("a < b and ca <> cb")
            .select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))
    linked = written(linked.union(_verified(near(rest), sets, percent)))
    crowd = written(mixed.where(F.col("size") > bucket).select("set", "component").distinct())
    if not crowd.isEmpty():
        linked = _crowded(crowd, linked, sets, percent, near)
    links = linked.join(sizes("a"), "a").join(sizes("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    joined = components(links).select(F.col("id").alias("rep"), "component")
    known = reps.select("set", "rep").join(joined, "rep", "left").select("set", F.coalesce("component", "rep").alias("component"))
    return (table.select("id", "n", "set").join(known, "set", "left")
            .select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))


@query("op3_ngram_jaccard", """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 4 >= b.n * 3 AND b.n * 4 >= a.n * 3 GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)""")
def op3(t):
    return similar_components(t("documents"))
