"""Repair of conversations against exhaustive search over edits, on chunks of every width."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from knownwhen.llm import repair

GOOD = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def ordered(rows):
    tie = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{len(r[2].encode())}:{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64].encode(), tie(r)))


def faults(rows):
    out, seen = [], set()
    for turn, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """All edit sequences up to the best cost, by breadth: (cost, audit, repaired text)."""
    rows = ordered(rows)
    kinds = faults(rows)
    layer = {("", ""): (0, [])}  # (audit, initials) -> cost, lines
    top = 3 * len(rows) + 1

    def with_inserts(found):
        out = dict(found)
        for _ in range(2):
            for (audit, initials), (cost, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    key = audit + "I", initials + role[0]
                    if cost + 2 <= top and key not in out:
                        out[key] = cost + 2, lines + [role + ":"]
        return {k: v for k, v in out.items() if re.fullmatch("s?(ua)*u?", k[1])}

    layer = with_inserts(layer)
    for (turn, role, text), kind in zip(rows, kinds):
        new = {}
        for (audit, initials), (cost, lines) in layer.items():
            options = [("D", initials, 3, lines)]
            if kind in ("", "truncated"):
                extra = kind == "truncated"
                if role[:1] in ("s", "u", "a"):
                    options.append(("K", initials + role[:1], extra, lines + [f"{role}:{text}"]))
                options += [("R", initials + r[0], 2 + extra, lines + [f"{r}:{text}"]) for r in ("user", "assistant")]
            for edit, i, more, lines_ in options:
                key = audit + edit, i
                if cost + more <= top and (key not in new or new[key][0] > cost + more):
                    new[key] = cost + more, lines_
        layer = with_inserts(new)
    cost, audit, lines = min((cost, audit, lines) for (audit, initials), (cost, lines) in layer.items() if GOOD.fullmatch(initials))
    return cost, audit, "\n".join(lines)


def report(rows):
    rows = ordered(rows)
    cost, audit, text = brute(rows)
    kinds, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations(seed, n, longest):
    rng = random.Random(seed)
    return [(c, rng.choice([None, *range(4)]) if rng.random() < 0.1 else k * rng.choice([1, 1, 1, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]),
             rng.choice(["Yes.", "No", "Well!", "a b?", "", " \n", None, f"Text {k}.", "é…"])) for c in range(n) for k in range(rng.randrange(1, longest + 1))]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conversation(rows, harm):
    out = {}
    for c, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20 if harm else 99
        role, text = "user" if d == 4 else space(role), "" if d == 1 else re.sub("[.!?]", "", space(text)) if d == 2 else space(text)
        out.setdefault(c, []).extend([(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1))
    return out


@pytest.mark.parametrize("harm", [False, True])
def test_against_search(spark, harm):
    rows = conversations(5, 60, 6) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (999, None, None, None)]
    rows += [r for r in rows if r[0] == 7]  # repeated rows
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "n", "h", "kind", "audit", "cost", "seq"):
        table = table.withColumn(name, F.lit("mine"))
    form = repair.damaged if harm else repair.intact
    want = {c: report(r) for c, r in by_conversation(rows, harm).items()}
    for span in (1, 2, 1024):
        got = {r.conv: tuple(r[c] for c in COLUMNS) for r in repair.repair(form(table.repartition(4)), span=span).collect()}
        assert got == want


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (r,) = repair.repair(repair.damaged(table)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(repair.damaged(table.limit(0))).collect() == []


def test_long_conversation_and_text(spark):
    """A conversation of 4,000 turns in chunks of 64 as in one, with one very long text and a thousand copies of one row."""
    rng = random.Random(1)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"Turn {k}" + rng.choice([".", ""])) for k in range(4000)]
    rows += [(1, 2000, "user", "word " * 300_000)] + [(1, 77, "user", "Again.")] * 1000 + [(2, 0, "user", "Q?"), (2, 1, "assistant", "A.")]
    table = repair.intact(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    results = [sorted(repair.repair(table, span=s).collect()) for s in (64, 10**6)]
    assert results[0] == results[1] and results[0][0].duplicate == 999 and len(results[0][0].audit) >= 5001
    assert results[0][1].audit == "KK" and results[0][1].cost == 0


def test_agenda_is_lightest():
    rng = random.Random(2)
    for _ in range(300):
        seq = "".join(rng.choice(repair.LETTERS) for _ in range(rng.randrange(7)))
        whole = repair.lightest(seq, repair.START)
        cut = rng.randrange(len(seq) + 1)
        joined = {}
        for p, (c, a) in repair.lightest(seq[:cut], repair.START).items():
            for q, (d, b) in repair.lightest(seq[cut:], p).items():
                joined[q] = min(joined.get(q, (10**9, "")), (c + d, a + b))
        assert joined == whole
