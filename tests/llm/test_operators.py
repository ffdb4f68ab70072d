"""Operators for corpora: brute force on small tables, and nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from knownwhen.llm import bpe, embeddings, graph, html, lines, mixing, ngrams, quality, spans, substrings, topk

# Names that the operators use inside, given to extra columns of the inputs.
CLASHING = ["id", "key", "n", "set", "line", "pos", "version", "gone", "digest", "first", "near", "size", "weight", "rate", "cdf", "copies", "spans", "data", "sigs", "rep",
            "component", "v", "cells", "score2", "features", "label2", "a", "b", "q"]


def documents(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(k))
    return df.repartition(parts)


def letters(rng, n, alphabet="abcdeé "):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Near copies, exact copies, shared lines and passages, nulls, empties, a long text, repeated rows."""
    rng = random.Random(11)
    word = [letters(rng, rng.randrange(2, 8), "abcdefghié") for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(word) for _ in range(rng.randrange(5, 25))) for _ in range(n))
    passage = text(3)
    rows = [(i, text(rng.randrange(1, 7)) + (("\n" + passage) if i % 3 == 0 else ""), f"s{i % 3}") for i in range(60)]
    for i in range(60, 90):
        words = rows[i % 20][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "s0"))
    rows += [(90 + i, rows[7][1], "s0") for i in range(8)]
    rows += [(200, None, "s1"), (201, "", None), (202, " \n\t ", "s1"), (203, "a b", "s2"), (204, "A  b", "s2"), (205, text(400), "s2"), (3, rows[3][1], "s0"), (None, rows[4][1], "s0"), (206, "x" * 3000, None)]
    return rows


# ---------------------------------------------------------------- 1 lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "a"), ("🙂b", "b"), ("abc" * 60, "abc" * 59 + "ab")]
    for _ in range(400):
        a = letters(rng, rng.randrange(20), "ab🙂")
        b = list(a)
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé")) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect()
    assert all(r.near == (edit(r.a, r.b) <= edits) for r in got)


def brute_lines(rows, edits, least):
    places = {}
    for d, t, *_ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if t is not None and line.strip(" \t\r"):
                at = (-math.inf if d is None else d, p)
                places[line] = min(places.get(line, at), at)
    gone = {y for y in places if len(y) >= least and any(abs(len(x) - len(y)) <= edits and len(x) >= least and x != y and places[x] < places[y] and edit(x, y) <= edits for x in places)}
    out = Counter()
    for d, t, *_ in rows:
        if t is None:
            out[d, None, 0, 0] += 1
            continue
        found = t.split("\n")
        kept = [x for p, x in enumerate(found) if x not in places or places[x] == (-math.inf if d is None else d, p) and x not in gone]
        out[d, "\n".join(kept), len(found), len(found) - len(kept)] += 1
    return out


@pytest.mark.parametrize("edits,least,small", [(1, 20, 10**6), (2, 8, 10**6), (1, 5, 0)])
def test_line_dedup_equals_brute_force(spark, corpus, edits, least, small):
    rng = random.Random(4)
    rows = [r for r in corpus if r[0] is None or r[0] != 205]
    for i in range(300, 330):  # lines a few characters off
        t = list(rows[i - 300][1].split("\n")[0])
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "z"
        rows.append((i, "".join(t) + "\n\n" + "".join(t), "s1"))
    kept = lines.dedup_lines(documents(spark, rows), edits=edits, least=least, small=small)
    assert set(CLASHING) <= set(kept.columns)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in kept.collect()) == brute_lines(rows, edits, least)


def test_allowed_edits_follow_the_length_of_a_line(spark):
    rng = random.Random(12)
    rows = []
    for i, n in enumerate([20, 38, 39, 41, 59, 60, 75, 79, 81, 99, 120, 178, 182, 240, 400, 700]):
        base = letters(rng, n, "abcdefghijklmnopqrstuvwxyz é")
        for k, edits in enumerate([0, n // 20, n // 20, n // 20 + 1, 2, 1]):
            t = list(base)
            for place in range(edits):  # spread evenly, which leaves the shortest common pieces
                at = min(len(t) - 1, (2 * place + 1) * len(t) // (2 * edits))
                t[at: at + (k != 2)] = ["#"] if k != 4 else []
            rows.append((10 * i + k, "".join(t), "s"))
    rng.shuffle(rows)
    texts = {d: t for d, t, _ in rows}
    near = lambda a, b: abs(len(a) - len(b)) <= max(len(a), len(b)) // 20 and edit(a, b) <= max(len(a), len(b)) // 20
    gone = {d for d, t in texts.items() if len(t.strip()) >= 20 and any(e < d and (texts[e] == t or near(texts[e], t)) for e in texts)}
    kept = lines.dedup_lines(documents(spark, rows)).collect()
    assert len(gone) > 40 and {r.doc_id for r in kept if r.n_removed} == gone


def test_keys_of_a_line_do_not_grow_with_its_length(spark):
    rng = random.Random(13)
    rows = [(n, letters(rng, n, "abcdefghijklmnopqrstuvwxyz é")) for n in (300, 1000, 5000, 20000)]
    told = spark.createDataFrame(rows, "n int, line string").select("n", F.expr(f"inline({lines._share_keys(20)})")).select("n", F.explode("keys"))
    assert all(20 < r["count"] < 250 for r in told.groupBy("n").count().collect())


def test_keys_of_a_line_follow_its_own_length(spark):
    rng = random.Random(17)
    rows = [(n, i, letters(rng, n, "abcdefghijklmnopqrstuvwxyz ")) for n in (550, 660) for i in range(60)]  # the ends of one class of lengths
    told = spark.createDataFrame(rows, "n int, i int, line string").select("n", F.expr(f"inline({lines._share_keys(20)})")).select("n", F.explode("keys"))
    count = {r.n: r["count"] / 60 for r in told.groupBy("n").count().collect()}
    assert 40 < count[550] < 120 and abs(count[660] / count[550] - 1) < 0.1
    limits, average = lines._limits()
    assert all(x >= y for x, y in zip(limits, limits[1:]))
    assert all(lines._fewer(m, limits[m - 1] / 2**24) <= lines.MISS for m in range(30, lines.EXACT + 1))
    assert all(lines._fewer(m, average / m) <= lines.MISS for m in (lines.EXACT + 1, 1000, 20_000, 10**6))


@pytest.mark.parametrize("group", [2, 32])
def test_crowded_keys_and_repeated_grams(spark, group):
    rng = random.Random(14)
    passage = letters(rng, 90, "abcdefghijklmnopqrstuvwxyz ")
    texts = [letters(rng, 60, "abcdefghijkl ") + passage + letters(rng, 60, "abcdefghijkl ") for _ in range(40)]
    texts += ["ab " * 70, "ab " * 69 + "ab", "x" * 300, "x" * 290, "x" * 280, "ab " * 60 + "cd " * 10]
    for t in texts[:30]:
        for edits in (4, 10, 11):
            found = list(t)
            for place in range(edits):
                found[(2 * place + 1) * len(t) // (2 * edits)] = "#"
            texts.append("".join(found))
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    near = lambda a, b: abs(len(a) - len(b)) <= max(len(a), len(b)) // 20 and edit(a, b) <= max(len(a), len(b)) // 20
    gone = {y for i, y in enumerate(texts) if any(x != y and near(x, y) for x in texts[:i])}
    found = lines.near_by_share(spark.createDataFrame(rows, "id long, pos int, line string").repartition(3), 20, group=group)
    assert len(gone) > 50 and {r.line for r in found.collect()} == gone


def test_keys_tell_where_a_passage_stands(spark):
    rng = random.Random(15)
    passage, other = letters(rng, 200, "abcdefghijklmnopqrstuvwxyz "), [letters(rng, 600, "abcdefghijklmnopqrstuvwxyz ") for _ in range(2)]
    rows = [(0, 800, passage + other[0]), (1, 800, other[1] + passage)]
    told = spark.createDataFrame(rows, "id int, n int, line string").select("id", F.expr(f"inline({lines._share_keys(20)})")).select("id", "slot", F.explode("keys").alias("key")).collect()
    first, second = [{(r.slot, r.key) for r in told if r.id == i} for i in range(2)]
    assert len(first) > 20 and len(second) > 20 and not first & second


@pytest.mark.parametrize("group", [2, 32])
def test_near_lines_of_one_document_go_by_their_place(spark, group):
    rng = random.Random(16)
    base = letters(rng, 400, "abcdefghijklmnopqrstuvwxyz ")
    texts = []
    for i in range(40):
        found = list(base)
        for place in rng.sample(range(400), rng.choice([3, 9, 14])):
            found[place] = "#"
        texts.append("".join(found))
    gone = {y for i, y in enumerate(texts) if any(x != y and edit(x, y) <= 20 for x in texts[:i])}
    found = lines.near_by_share(spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "id long, pos int, line string").repartition(3), 20, group=group)
    assert 0 < len(gone) < 40 and {r.line for r in found.collect()} == gone


@pytest.mark.parametrize("turns", [1, 8])
def test_turns_share_one_exchange_and_lose_no_key(spark, turns, monkeypatch):
    made = []
    monkeypatch.setattr(lines, "TURNS", turns)
    monkeypatch.setattr(lines, "written", lambda df, real=lines.written: made.append(df) or real(df))
    rng = random.Random(18)
    texts = [letters(rng, 200, "abcdefghijklmnopqrstuvwxyz ") for _ in range(30)]
    texts += [t[:50] + "##" + t[52:120] + t[123:] for t in texts]
    found = lines.near_by_share(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, pos int, line string"), 20)
    assert {r.line for r in found.collect()} == set(texts[30:])
    made[0].collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == turns - 1


def test_lines_of_common_syllables_seldom_meet_and_leave_no_stages(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lines, "written", lambda df, real=lines.written: made.append(real(df)) or made[-1])
    monkeypatch.setattr(lines, "discard", lambda *frames, real=lines.discard: (met.append(made[0].count()), real(*frames)))
    rng, met = random.Random(20), []
    texts = ["".join(rng.choice(["the ", "er", "on", "tion ", "a", "ing ", "re", "st ", "ha", "ble"]) for _ in range(170)) for _ in range(400)]
    found = lines.near_by_share(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, pos int, line string"), 20)
    assert found.isEmpty() and met[0] < 7_500
    for df in made[:-1]:
        with pytest.raises(Exception, match="(?i)path|file"):
            df.collect()


def test_a_written_stage_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    out = lines.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
    for _ in range(50):  # they go in the background
        if files() - before:
            time.sleep(0.2)
    assert not files() - before and out.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_lines_with_some_repeated_grams(spark):
    rng = random.Random(21)
    texts = []
    for share in (0, 2, 3, 4, 5, 6, 8, 10):  # of ten pieces, as many repeat; about a quarter is where repeats begin to count
        for n in (90, 400):
            piece = letters(rng, n // 10, "abcdefghijklmnopqrstuvwxyz é")
            line = "".join(piece if i < share else letters(rng, n // 10, "abcdefghijklmnopqrstuvwxyz é") for i in range(10))
            texts.append(line)
            for edits in (len(line) // 20, len(line) // 20 + 2):
                near = list(line)
                for place in range(edits):
                    near[(2 * place + 1) * len(line) // (2 * edits)] = rng.choice("#é")
                texts.append("".join(near))
    near = lambda a, b: abs(len(a) - len(b)) <= max(len(a), len(b)) // 20 and edit(a, b) <= max(len(a), len(b)) // 20
    gone = {y for i, y in enumerate(texts) if any(x != y and near(x, y) for x in texts[:i])}
    found = lines.near_by_share(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, pos int, line string").repartition(3), 20)
    assert len(gone) >= 16 and {r.line for r in found.collect()} == gone


def test_lines_that_are_not_valid_text_are_told_by_their_characters(spark):
    rng = random.Random(22)
    base = [letters(rng, 200, "abcdefghijklmnopqrstuvwxyz").encode() for _ in range(6)]
    rows = [(i, 0, t) for i, t in enumerate(base + [t[:50] + b"\xff" + t[50:120] + b"\xf0\x9f\x98\x80" + t[120:] for t in base])]
    given = spark.createDataFrame(rows, "id long, pos int, line binary").withColumn("line", F.col("line").cast("string"))
    assert given.where(F.expr(f"length({lines._wide()}) <> 4 * length(line)")).isEmpty()
    found = lines.near_by_share(given, 20)
    assert {bytes(r.line) for r in found.select(F.col("line").cast("binary").alias("line")).collect()} == {t for _, _, t in rows[6:]}


def test_rare_features_are_ranked_without_joining_every_feature(spark):
    rng = random.Random(19)
    raw = {i: sorted(rng.sample(range(1, 60), 20)) for i in range(12)} | {12: sorted(range(100, 120))}
    often = Counter(f for fs in raw.values() for f in fs)
    rows = [(i, b"", b"".join(f.to_bytes(8, "little") for f in fs)) for i, fs in raw.items()]
    sets = spark.createDataFrame(rows, "set long, parity binary, features binary")
    told = ngrams._rare_first(sets, sets.select("set"), 75)
    wanted = set()
    for i, fs in raw.items():
        order = sorted(fs, key=lambda f: (often[f], f))
        wanted |= {(f, i, 20, 20 - place, place < 20 - 18 + 1) for place, f in enumerate(order[:20 - 15 + 1]) if often[f] > 1}
    assert {(r.f, r.set, r.n, r.rest, r.own) for r in told.collect()} == wanted
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the sets of the crowd


def test_one_line_in_every_row(spark):
    rows = [(i, f"the same long line in every row\nown line number {i} of this table {i * i}", "s") for i in range(300)]
    kept = lines.dedup_lines(documents(spark, rows), edits=0).select("doc_id", "n_removed").collect()
    assert sorted(r.n_removed for r in kept) == [0] + [1] * 299


# ---------------------------------------------------------------- 2 top k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, id int").repartition(3)


@pytest.mark.parametrize("block,group,asked", [(512, 64, 256), (7, 2, 3)])
def test_top_k_equals_brute_force(spark, block, group, asked):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((180, 6)).astype(np.float32)
    x[50:110] = x[50]  # one vector in a third of the rows: ties
    rows = [(i, [float(c) for c in v], "c", 0) for i, v in enumerate(x)]
    rows += [(500, None, "c", 0), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c", 0), (502, [math.nan] * 6, "c", 0), (503, [math.inf] * 6, "c", 0), (504, [1.0, 2.0], "c", 0), (550, [0.5, 1.0], "c", 0), (None, [1.0] * 6, "c", 0), (600, [], "c", 0)]
    clean = topk.integer_vectors(vectors(spark, rows))
    got = {}
    for r in topk.top_k(clean, clean.where("vec_id % 10 = 0"), 5, block=block, group=group, query_block=asked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in [(r[0], r[1]) for r in rows if r[0] is not None and r[1]] if all(c is not None and math.isfinite(c) for c in v)}
    want = {}
    for i, v in whole.items():
        if i % 10 == 0:
            near = sorted((-int(v @ w), j) for j, w in whole.items() if j != i and len(w) == len(v))[:5]
            if near:
                want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_blocks_below_the_bound_are_skipped():
    near, far = np.full((4, 3), 90), np.full((4, 3), 1)
    ids = np.arange(4)
    found, scored = topk._search([(np.array([99]), np.array([99]), np.array([[1, 1, 1]]))], [(ids, ids, near), (ids + 10, ids + 10, far), (ids + 20, ids + 20, far)], 3)
    assert scored == 1 and list(found.vec_id) == [0, 1, 2]


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    clean = topk.integer_vectors(vectors(spark, [(0, [1.0, 0.0], "c", 0), (1, [1.0, 0.0], "c", 0), (1, [2.0, 0.0], "c", 0), (2, [0.5, 0.0], "c", 0), (0, [3.0, 0.0], "c", 0)]))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(clean, clean.where("vec_id = 0"), 3).collect())
    one, three = 65536, 3 * 65536
    assert got == sorted([(0, 1, 0, three), (0, 2, 1, 2 * one), (0, 3, 1, one), (0, 1, 1, 2 * three), (0, 2, 0, three), (0, 3, 1, three)])


def test_top_k_of_nothing(spark):
    none = topk.integer_vectors(vectors(spark, []))
    assert topk.top_k(none, none, 5).collect() == []


# ---------------------------------------------------------------- 3 n-grams


def brute_components(rows, size=5, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((d, frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and d is not None and sets[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return Counter((d, len(s), None if d is None else min(groups[find(i)])) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("bucket,small", [(64, 10**6), (2, 0)])
def test_components_equal_brute_force(spark, corpus, bucket, small):
    rng = random.Random(8)
    rows = list(corpus)
    for i in range(400, 470):  # chains of near copies and short texts
        w = rows[i % 30][1].split(" ")
        del w[rng.randrange(len(w))]
        rows.append((i, " ".join(w), "s1"))
        rows.append((i + 1000, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))), "s1"))
    got = ngrams.similar_components(documents(spark, rows), bucket=bucket, small=small).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    flat = lambda h: np.concatenate([x for x, _ in ngrams.signatures(h, 75)])
    for size in [*range(2, 60), 90, 200, 500, 1500]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            lost = rng.integers(0, size // 4 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**64, max(0, size // 7 - lost), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                with np.errstate(over="ignore"):
                    common = np.intersect1d(flat(a), flat(b))
                    # Either set, without as many signatures as it can spare, still has one in common with the other.
                    sides = [x for x, left in ngrams.signatures(a, 75) if len(np.intersect1d(x, common))]
                    assert sides
                    x, left = max(ngrams.signatures(a, 75), key=lambda e: len(np.intersect1d(e[0], common)))
                    if left > 0:
                        assert len(np.intersect1d(rng.permutation(x)[left:], common))


def test_large_bucket_of_texts_that_almost_link(spark):
    rng = random.Random(6)
    word = [letters(rng, 5, "abcdefgh") for _ in range(300)]
    base = [rng.choice(word) for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 6, 7, 9])):
            w[rng.randrange(len(w))] = rng.choice(word)
        rows.append((i, " ".join(w), "s"))
    passage = [letters(rng, 7, "abcdefgh") for _ in range(60)]
    for i in range(120, 220):  # a passage that they share is most of these texts; some link beyond it
        own = [letters(rng, 6, "ijklmnop") for _ in range(rng.randrange(4, 30))]
        if i % 4 == 0:
            own = rows[-1][1].split(" ")[60:]
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(passage + own), "s"))
    got = ngrams.similar_components(documents(spark, rows), bucket=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_parity_words_bound_the_difference():
    rng = np.random.default_rng(9)
    with np.errstate(over="ignore"):
        for size in [0, 1, 5, 80, 900, 5000]:
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for other in (a, a[: size // 2], np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)), np.concatenate([a[size // 9:], rng.integers(0, 2**64, 7, dtype=np.uint64)])):
                x, y = (np.frombuffer(ngrams._parity(h), np.uint64) for h in (a, other))
                assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, other))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(5, 5), (None, 3), (200, 201), (200, 201)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- 4 mixing


def test_mixture_reaches_its_target(spark):
    rows = [(i, "x" * (10 + i % 7), "big" if i % 10 else "small") for i in range(20_000)] + [(20_000, None, None), (20_001, "", "empty")]
    docs = documents(spark, rows)
    for small in (50_000, 0):  # broadcast rates, salted join
        got = mixing.replicate(docs, {"big": 1.0, "small": 1.0}, small=small, epochs=0.5).cache()
        size = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
        total = sum(len(t or "") for _, t, _ in rows)
        assert abs(size["big"] / (0.25 * total) - 1) < 0.05 and abs(size["small"] / (0.25 * total) - 1) < 0.05
        assert set(got.columns) == set(docs.columns) | {"copy", "shuffle_key"}
        copies = got.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count(F.lit(1)).alias("n")).where("m + 1 <> n").count()
        assert copies == 0


def test_large_rates_and_repeated_ids(spark):
    rows = [(i, "abcd", "rare") for i in range(50)] + [(7, "abcd", "rare")] + [(1000 + i, "abcd", "rest") for i in range(5000)]
    got = mixing.replicate(documents(spark, rows), {"rare": 1.0, "rest": 0.0}).groupBy("doc_id", "source").count().collect()
    n = {r.doc_id: r["count"] for r in got}
    assert {r.source for r in got} == {"rare"} and abs(sum(n.values()) / 5051 - 1) < 0.06
    assert n[7] % 2 == 0 and 40 < np.std([v for k, v in n.items() if k != 7]) ** 2 < 260  # about 99 for a Poisson draw


def test_mixture_is_repeatable_and_shuffled(spark, corpus):
    a, b = (mixing.replicate(documents(spark, corpus, parts), seed=3).select("doc_id", "copy", "shuffle_key") for parts in (2, 5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert mixing.replicate(documents(spark, [])).collect() == []


# ---------------------------------------------------------------- 5 pages

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>x='<p>no</p>'</script></head><body><nav><a>Home</a></nav><article><h1>Head &amp; tail</h1><p>One,\n two <b>bold</b>.<br>three</p><p>Short</p>"
     "<div class='share-buttons'>Share!</div></article><section id=comments><p>Nice text, I think. Really.</p></section><footer>&copy; me</footer></body></html>", "Head & tail\nOne, two bold. three\nShort"),
    ("<body><div class=menu><ul><li>a<li>b</ul></div><div class=content><p>Some longer text here, with commas, and more.<p>Another longer paragraph, that also counts; yes.</div><aside>Other, things.</aside>"
     "<form><p>Your name, please?</p><input></form><div class='cookie-notice'>We use cookies, sorry.</div>", "Some longer text here, with commas, and more.\nAnother longer paragraph, that also counts; yes."),
    ("<article><p>x &lt;y&gt; &#233;&#x41; <i>un</i>split</p><!-- <p>no</p> --><p>open <b>never closed<p>next", "x <y> éA unsplit\nopen never closed\nnext"),
    ("", ""), (None, ""), ("<html><body></body></html>", ""), ("just words", "just words"), ("<p>unended <script>alert(1)", "unended"), ("a < b and b > a", "a < b and b > a"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_extract_keeps_rows_and_columns(spark):
    rows = [(i, p, "u", i) for i, (p, _) in enumerate(PAGES)] + [(0, PAGES[0][0], "u", 0), (99, "<article>" + "<p>para, graph.</p>" * 20_000, None, 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, url string, text int").repartition(2)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter([(i, t) for i, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1]), (99, "\n".join(["para, graph."] * 20_000))])
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


# ---------------------------------------------------------------- 6 quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    p, y = map(np.array, zip(*[(r.score, r.quality) for r in scored.select("score", "quality").collect()]))
    assert ((p >= 0.5) == y).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.03  # calibrated in the large


def test_scores_of_odd_tables(spark, corpus):
    docs = documents(spark, corpus).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (2, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    flat = quality.score(docs, quality.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]
    one = quality.fit(docs, labels.where("quality = 1"))
    assert quality.score(docs.limit(0), one).collect() == [] and quality.score(docs, one).where("score < 0.5").count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark, corpus):
    docs = documents(spark, corpus)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, other)


# ---------------------------------------------------------------- 7 substrings


def brute_repeats(rows, length):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        starts = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out[d, len(b), int(gone.sum()), starts, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("length,gram,bucket", [(40, 16, 30_000), (40, 40, 30_000), (25, 7, 3)])
def test_repeats_equal_brute_force(spark, corpus, length, gram, bucket):
    rows = [r for r in corpus if r[0] != 205] + [(300, "ab" * 90, "s"), (301, "ba" * 90, "s"), (302, "é" * 20, "s"), (303, "q" * length, "s"), (304, "r" * (length - 1), "s")]
    got = substrings.remove_repeats(documents(spark, rows), length=length, gram=gram, bucket=bucket).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows, length)


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(documents(spark, [])).collect() == []


# ---------------------------------------------------------------- 9 embeddings


def brute_links(rows, cosine):
    unit = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, (i, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= cosine] if k in unit else [] for k in range(len(rows))}
    out = Counter()
    for k, (i, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in reach)
        out[i, len(links[k]), low, low == i] += 1
    return out


@pytest.mark.parametrize("cell_rows,block", [(4096, 2048), (40, 16)])
def test_embedding_links_equal_brute_force(spark, cell_rows, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base, base.repeat(4, 0) + 0.25 * rng.standard_normal((160, 24)), np.tile(base[0], (60, 1)) + 0.05 * rng.standard_normal((60, 24)), base[1:2].repeat(50, 0), 3 * base[2:3]])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 24), (902, [math.nan] * 24), (903, [None] + [1.0] * 23), (904, [1.0, 0.0]), (905, [1.0, 0.01]), (906, []), (907, [2.0])]
    got = embeddings.near_duplicates(vectors(spark, [(i, v, "x", 0) for i, v in rows]), cell_rows=cell_rows, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows, 0.95)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = embeddings._rotated(x, 1)
    signs = np.where(u >= 0, 1, -1) / math.sqrt(u.shape[1])
    factor = (signs * u).sum(1)
    error = (signs @ u.T) / factor[:, None] - x @ x.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.002
    spread = np.sqrt(1 - factor**2) / factor / math.sqrt(u.shape[1] - 1)
    assert (np.abs(error) <= 4 * spread[:, None]).mean() > 0.9998


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).collect() == []


# ---------------------------------------------------------------- 10 tokens

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(PATH, tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_tokens_equal_tiktoken(vocabulary, reference):
    rng = random.Random(9)
    parts = [b.decode("utf8", "ignore") for b in vocabulary.bytes]
    texts = ["", " ", "<|endoftext|>", "a" * 4000, "ab" * 3000, " " * 999, "é" * 999, "'s'll I'm", "\r\n\n \t x", "中文🙂👨‍👩‍👧", "\x00\x7f\x1c"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += [letters(rng, rng.randrange(40), "abcde ' \n\tAé中🙂0129.,!") for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(vocabulary.encode(t), "<u4").tolist() == reference.encode_ordinary(t)
        assert vocabulary.decode(vocabulary.encode(t)) == t.encode()


def test_long_text_is_encoded_in_parts(vocabulary, monkeypatch):
    text = " ".join(letters(random.Random(1), 5) for _ in range(3000))
    whole = vocabulary.encode(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    assert vocabulary.encode(text) == whole


def test_memo_is_bounded(vocabulary):
    memo = bpe.Memo(vocabulary, limit=3)
    assert [memo[x] for x in ("a", "b", "c", "d", "a")] == [vocabulary.encode(x) for x in ("a", "b", "c", "d", "a")] and len(memo) <= 3


def test_encode_and_decode_tables(spark, corpus, vocabulary):
    docs = documents(spark, corpus).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    back = bpe.decode(bpe.encode(docs, PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((d, (t or "").encode()) for d, t, _ in corpus)
    got = bpe.digests(docs, PATH, tokenizers.PATTERN).collect()
    want = Counter((d, len(vocabulary.encode(t)) // 4, hashlib.sha256(vocabulary.encode(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in corpus)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.digests(docs.limit(0), PATH, tokenizers.PATTERN).collect() == []


# ---------------------------------------------------------------- 8 sentence spans


def brute_spans(rows, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parsed = []
    for d, t, *_ in rows:
        found = []  # (words, first character)
        for line in re.finditer(r"[^\n]*", t or ""):
            open_ = False
            for w in re.finditer(r"[^\x20\x09-\x0D]+", line[0]):
                if not open_:
                    found.append(([], line.start() + w.start()))
                found[-1][0].append(w[0].translate(lower))
                open_ = not re.search(r"[.!?]$|(?<=.)[.!?][\"')\]}]$", w[0])
        parsed.append((d, t or "", found))
    places = {}
    spans = []
    for k, (d, _, s) in enumerate(parsed):
        own = set()
        for i in range(len(s)):
            for a, b in [(i, j) for j in range(i, len(s))] + [(j, i) for j in range(i, -1, -1)]:
                ahead = a == i
                if sum(len(w) for w, _ in s[a:b + 1]) >= least:
                    inner = s[a:b] if ahead else s[a + 1:b + 1]
                    if sum(len(w) for w, _ in inner) < least:
                        own.add((a, b))
        for a, b in own:
            key = tuple(x for w, _ in s[a:b + 1] for x in w)
            places.setdefault(key, []).append((-math.inf if d is None else d, a))
            spans.append((k, a, b, key))
    out = Counter()
    seen, gone = [[set() for _ in parsed] for _ in range(2)]
    for k, a, b, key in spans:
        if len(places[key]) > 1:
            seen[k] |= set(range(a, b + 1))
            if (-math.inf if parsed[k][0] is None else parsed[k][0], a) != min(places[key]):
                gone[k] |= set(range(a, b + 1))
    for k, (d, t, s) in enumerate(parsed):
        edges = [x for _, x in s] + [len(t)]
        kept = (t[:edges[0]] + "".join(t[edges[j]:edges[j + 1]] for j in range(len(s)) if j not in gone[k])) if gone[k] else t
        out[d, len(s), len(seen[k]), len(gone[k]), kept] += 1
    return out


@pytest.mark.parametrize("least,sample,limit", [(12, 4000, 100_000), (25, 4000, 100_000), (6, 10, 0)])
def test_spans_equal_brute_force(spark, corpus, least, sample, limit):
    rng = random.Random(3)
    mark = lambda t: " ".join(w + (rng.choice(".!?,") if rng.random() < 0.2 else "") for w in t.split(" ")) if t else t
    passage = mark(corpus[0][1])
    rows = [(d, mark(t) if k % 2 else t, s) for k, (d, t, s) in enumerate(corpus) if d != 205]
    rows += [(400 + i, f"Own beginning {i} of this. " + passage + (" And an end." if i % 2 else ""), "s") for i in range(40)] + [(500, 'He said "no." (Really?) Yes! ' * 8, "s")]
    got = spans.dedup_spans(documents(spark, rows), least=least, sample=sample, limit=limit).collect()
    assert Counter((r.doc_id, r.n_sentences, r.n_repeated, r.n_removed, r.kept) for r in got) == brute_spans(rows, least)


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + ("." if i % 9 == 8 else "") for i in range(n)) + "."
    passage = text(55)
    rows = [(i, text(120) + " " + passage + " " + text(60), "s") for i in range(20)] + [(100 + i, text(150), "s") for i in range(20)]
    got = {r.doc_id: r for r in spans.dedup_spans(documents(spark, rows)).collect()}
    assert all(got[i].n_removed == 0 and got[i].kept == dict((d, t) for d, t, _ in rows)[i] for i in [0, *range(100, 120)])
    assert all(passage not in got[i].kept and got[i].n_removed >= 6 for i in range(1, 20))
    assert spans.dedup_spans(documents(spark, [])).collect() == []


@pytest.mark.parametrize("words", [51, 60, 70, 80])
def test_passages_cut_inside_sentences_lose_their_whole_sentences(spark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    size = 20 if words < 70 else 24  # words in a sentence; the passage starts and ends inside one
    cut = (words - size * (words // size - 1)) // 2
    passage = [word() + ("." if (i - cut) % size == size - 1 else "") for i in range(words)]
    whole = " ".join(passage[cut: cut + size])
    assert whole.endswith(".") and not passage[-1].endswith(".") and size < 25
    rows = [(i, " ".join([word() for _ in range(9)] + passage + [word() for _ in range(7)]) + ".", "s") for i in range(8)]
    got = {r.doc_id: r for r in spans.dedup_spans(documents(spark, rows)).collect()}
    assert got[0].n_removed == 0 and whole in got[0].kept
    assert all(got[i].n_removed >= 1 and whole not in got[i].kept for i in range(1, 8))
