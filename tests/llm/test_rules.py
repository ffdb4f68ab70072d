"""The ledger of quality rules against plain Python, its policies and ablations."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from knownwhen.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    blank = "\x20\t\n\x0b\x0c\r"
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in rules.SYMBOLS for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_letter_words": sum(any(c.isalpha() for c in x) for x in w), "n_capitals": sum("A" <= c <= "Z" for c in t),
            "n_open_lines": sum(x.rstrip(blank).endswith(("...", "…")) for x in lines)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["a", "b", "é", "##", "THE", "12", "🙂x", "wörter", "c...", "longerwordthanten"]
    made = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", " \x0b", "\r\n", ""]) for _ in range(rng.choice([3, 10, 60, 300])))) for i in range(80)]
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(200_000))
    return made + [(100, None), (101, ""), (102, " \n\x0c\r"), (103, "x x x x"), (104, "x x x"), (105, "a b c a b c a"), (106, long), (107, "\x00 . \x85  y"), (3, made[3][1]), (None, made[4][1])]


def test_measures(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_words", "failed", "w", "t", "source"):  # columns called like measurements are simply not carried
        docs = docs.withColumn(name, F.lit("mine"))
    got = Counter((r.doc_id, *[r[m] for m in rules.MEASURES]) for r in rules.ledger(docs.repartition(5)).collect())
    assert got == Counter((i, *[plain(t)[m] for m in rules.MEASURES]) for i, t in rows)
    assert rules.ledger(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        rules.ledger(docs, keep=("doc_id", "failed"))


def verdict(m):
    return [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 10 * m["n_symbols"] > m["n_words"], not 3 * m["n_words"] <= m["word_chars"] <= 10 * m["n_words"],
            100 * m["n_letter_words"] < 80 * m["n_words"], 100 * m["n_dup_lines"] > 50 * m["n_lines"], 100 * m["n_capitals"] > 30 * m["word_chars"], 100 * m["n_open_lines"] > 30 * m["n_lines"]]


def test_bits_policies_and_ablation(spark, rows):
    docs = spark.createDataFrame([(i, t, f"s{(i or 0) % 2}") for i, t in rows], "doc_id long, text string, source string")
    book = rules.ledger(docs, keep=("doc_id", "source")).cache()
    fails = {(i, t): verdict(plain(t)) for i, t in rows}
    want = Counter((i, sum(f << k for k, f in enumerate(fails[i, t]))) for i, t in rows)
    assert Counter((r.doc_id, r.failed) for r in book.collect()) == want
    mixed = rules.Policy("mixed", 9, ("symbols",), ("few_words", "word_length", "capitals"), 1)
    fine = lambda f, skip=None: (skip == 2 or not f[2]) and sum(f[k] for k in (0, 3, 6) if k != skip) <= 1
    assert sorted(r.doc_id or -1 for r in book.where(rules.kept(mixed)).collect()) == sorted(-1 if i is None else i for i, t in rows if fine(fails[i, t]))
    for source in ("s0", "s1"):
        own = [fails[i, t] for i, t in rows if f"s{(i or 0) % 2}" == source]
        got = {r.rule: r for r in rules.ablation(book, mixed, by=["source"]).where(F.col("source") == source).collect()}
        assert len(got) == 4
        for rule in rules.RULES:
            if rule.name in got:
                k, r = rule.bit, got[rule.name]
                assert (r.n_docs, r.n_kept, r.n_failed) == (len(own), sum(map(fine, own)), sum(f[k] for f in own))
                assert (r.n_alone, r.n_kept_without) == (sum(fine(f, k) and not fine(f) for f in own), sum(fine(f, k) for f in own))


def test_no_python_and_no_exchange(spark, rows):
    plan = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InArrow" not in plan and "EvalPython" not in plan
