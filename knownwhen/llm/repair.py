"""Conversation structure repair as lightest derivation.

Items are ``(rows consumed, state)``, the state being what the role initials so far allow next. Edits are deductions with a cost, and
an item's weight is (cost, audit), the audit being the edits' initials. Weights compare by cost, then by audit. Every deduction adds a
cost of at least 0 and a letter, so it never makes a weight smaller and keeps the order of two weights of one item (those of equal cost
are never prefixes of one another: the longer one would hold further inserts, which cost): the functions are monotone and superior. An
agenda therefore pops items in the order of their final weights, and an item is final when popped.

A conversation is cut into chunks by turn. A chunk is solved from each of the four states it may start in; deductions with two
premises join the item "first chunks, state p" and the item "next chunk, p to q". Chunks are solved wherever they lie, so one
long conversation doesn't wait on one task. Only joining the chunks' items and hashing the repaired text go through a conversation
from its first row to its last; both stream over sorted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, query, written

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
# One letter per row: 4 * (s, u, a, other) + (fine, truncated, blank, duplicate).
INITIALS, LETTERS = "sua", "ABCDEFGHIJKLMNOP"
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
LEGAL = {(0, 1), (1, 2), (2, 1)}
DIGEST = "h"


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """-> (conv, turn, role, text, n): the rows after the contract's damage, ``n`` copies of each; 0 for a dropped row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"),
                                (F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20).alias("d"))
    d = F.col("d")
    return rows.select("conv", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(d == 0, 0).when(d == 3, 2).otherwise(1).cast("long").alias("n"))


def intact(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same form for conversations as they are: one copy of each row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).cast("long").alias("n"))


def _same(*parts: Column) -> Column:
    """128 bits that stand for the parts; each part's length goes first, so that parts can't run into each other."""
    tagged = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat(*tagged).cast("binary")))


def _facts(rows: DataFrame, span: int) -> DataFrame:
    """Distinct (conv, turn, role, text) of ``rows`` with their copies, without the texts: (conv, chunk, turn, role, h, k, initial, fault, n)."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANK)), F.lit(1))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    narrow = rows.select("conv", F.floor(F.col("turn") / span).alias("chunk"), "turn", F.substring("role", 1, 64).alias("role"), _same(F.col("role"), F.col("text")).alias(DIGEST),
                         _same(F.col("conv"), F.col("role"), F.col("text")).alias("k"), initial.alias("initial"), fault.alias("fault"), "n")
    keys = [c for c in narrow.columns if c != "n"]
    return narrow.groupBy(*keys).agg(F.sum("n").alias("n"))


def _strings(facts: DataFrame) -> DataFrame:
    """-> (conv, chunk, low, high, turns, seq): per chunk its turns and one letter per row in order. A chunk holds at most ``span``
    different turns, copies of a row having been counted before."""
    alive = facts.where("n > 0")
    first = alive.groupBy("k").agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))).alias("f"))
    marked = facts.join(first, "k", "left")
    late = (F.col("f.a") != F.col("turn").isNotNull()) | (F.col("f.b") < F.col("turn"))
    code = lambda fault: F.substring(F.lit(LETTERS), 4 * F.col("initial") + fault + 1, F.lit(1))
    again = F.when(F.col("fault") == 2, code(F.lit(2))).otherwise(code(F.lit(3)))
    one = F.when(F.coalesce(late, F.lit(False)), again).otherwise(code(F.col("fault")))
    letters = F.when(F.col("n") > 0, F.concat(one, F.repeat(again, (F.col("n") - 1).cast("int")))).otherwise("")
    seen = F.when(F.col("n") > 0, F.col("turn"))
    return marked.groupBy("conv", "chunk").agg(
        F.min(seen).alias("low"), F.max(seen).alias("high"), F.size(F.collect_set(seen)).cast("long").alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", DIGEST, letters.alias("letters")))), lambda x: x["letters"]), "").alias("seq"))


def _deductions(state: int, letter: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state afterwards) of the edits that consume a row."""
    initial, fault = divmod(letter, 4)
    out = [("D", 3, state)]
    if fault < 2:
        want = NEXT[state][0]
        if initial == 0 and state == START:
            out.append(("K", fault, SYSTEM))
        if initial == want - 1:
            out.append(("K", fault, want))
        else:
            out.append(("R", 2 + fault, want))
    return out


DEDUCTIONS = [[_deductions(state, letter) for letter in range(16)] for state in range(4)]


def lightest(seq: str, state: int) -> dict[int, tuple[int, str]]:
    """Weights of the items (all of ``seq``, q) for every state q reachable from ``state``, by Knuth's agenda."""
    goal, final, found = len(seq), set(), {}
    agenda = [(0, "", 0, state)]
    while agenda:
        cost, audit, at, q = heappop(agenda)
        if (at, q) in final:
            continue
        final.add((at, q))
        if at == goal:
            found[q] = cost, audit
            if len(found) == 4:
                break
        else:
            for edit, more, to in DEDUCTIONS[q][ord(seq[at]) - 65]:
                if (at + 1, to) not in final:
                    heappush(agenda, (cost + more, audit + edit, at + 1, to))
        to = NEXT[q][0]
        if (at, to) not in final:
            heappush(agenda, (cost + 2, audit + "I", at, to))
    return found


@lru_cache(maxsize=1 << 14)
def _short(seq: str) -> list:
    return _solved(seq)


def _solved(seq: str) -> list:
    return [{"p": p, "q": q, "cost": w[0], "audit": w[1]} for p in range(4) for q, w in lightest(seq, p).items()]


ITEMS = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
SOLVED = f"conv {{}}, chunk long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head int, tail int, items {ITEMS}"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for seq in batch.column("seq").to_pylist():
            initials, faults = [(ord(x) - 65) // 4 for x in seq], [(ord(x) - 65) % 4 for x in seq]
            rows.append({"blank": faults.count(2), "duplicate": faults.count(3), "truncated": faults.count(1),
                         "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])), "head": initials[0] if seq else None,
                         "tail": initials[-1] if seq else None, "items": _short(seq) if len(seq) <= 64 else _solved(seq)})
        kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        own = [pa.array([r[c] for r in rows], kind if c == "items" else pa.int32() if c in ("head", "tail") else pa.int64())
               for c in ("blank", "duplicate", "truncated", "illegal", "head", "tail", "items")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv", "chunk", "low", "high", "turns")] + own,
                                         ["conv", "chunk", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "items"])


class _Joined:
    """The items of a conversation's chunks so far. The audits of all live states share their beginning sooner or later; it is
    moved to ``settled`` so that joining stays linear."""

    def __init__(self):
        self.settled, self.live = [], {START: (0, "")}
        self.low = self.high = self.tail = None
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, r: dict) -> None:
        if r["head"] is not None:
            self.illegal += self.tail is not None and (self.tail, r["head"]) not in LEGAL
            self.tail = r["tail"]
        if r["low"] is not None:
            self.low = r["low"] if self.low is None else min(self.low, r["low"])
            self.high = r["high"] if self.high is None else max(self.high, r["high"])
        for c in ("turns", "illegal", "blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + r[c])
        best: dict[int, tuple[int, str]] = {}
        for item in r["items"]:
            if item["p"] in self.live:
                cost, audit = self.live[item["p"]]
                weight = cost + item["cost"], audit + item["audit"]
                if item["q"] not in best or weight < best[item["q"]]:
                    best[item["q"]] = weight
        shared = commonprefix([a for _, a in best.values()])
        self.settled.append(shared)
        self.live = {q: (c, a[len(shared):]) for q, (c, a) in best.items()}

    def result(self, conv) -> tuple:
        cost, audit = min(w for q, w in self.live.items() if q in GOALS)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (conv, chunk) -> one row per conversation."""
    state = conv = kind = None
    done: list[tuple] = []
    size = 0

    def out():
        columns = list(zip(*done))
        done.clear()
        types = [kind] + [pa.int64()] * len(REPORT) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", *REPORT, "audit"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for r in batch.to_pylist():
            if state is None or r["conv"] != conv:
                if state is not None:
                    done.append(state.result(conv))
                    size += 100 + len(done[-1][-1])
                    if size > 4 << 20:
                        yield out()
                        size = 0
                state, conv = _Joined(), r["conv"]
            state.add(r)
    if state is not None:
        done.append(state.result(conv))
        yield out()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's report, then its rows in order -> the report with the SHA-256 of the repaired text."""
    report, kind, done, size = None, None, [], 0
    digest = audit = None
    at = state = 0

    def line(role: str, text: str) -> None:
        nonlocal state, started
        digest.update(("\n" if started else "").encode() + role.encode() + b":" + text.encode())
        started = True
        state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            line(NEXT[state][1], "")
            at += 1

    def close() -> None:
        nonlocal size
        inserts()
        done.append((*report, digest.hexdigest()))
        size += 200 + len(audit)

    def out():
        nonlocal size
        columns = list(zip(*done))
        done.clear()
        size = 0
        types = [kind] + [pa.int64()] * len(REPORT) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", *REPORT, "audit", "repaired_sha256"])

    started = False
    for batch in batches:
        kind = batch.schema.field("conv").type
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if report is not None:
                    close()
                    if size > 4 << 20:
                        yield out()
                report, audit = (r["conv"], *[r[c] for c in REPORT], r["audit"]), r["audit"]
                digest, at, state, started = hashlib.sha256(), 0, START, False
                continue
            for _ in range(r["n"]):
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    line(r["role"], r["text"])
                elif edit == "R":
                    line(NEXT[state][1], r["text"])
    if report is not None:
        close()
    if done:
        yield out()


def repair(rows: DataFrame, *, span: int = 1024) -> DataFrame:
    """-> (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every ``conv`` of ``rows``, which come
    from ``intact`` or ``damaged``.

    Rows are ordered by turn (NULL first), then role (its first 64 characters), then a digest of role and text; equal rows are copies of one another and all but the
    first are duplicates. A NULL conversation is one of its own; NULL roles and texts are single spaces; a role that begins with none of s, u,
    a (an empty one too) can only be rewritten or deleted. Extra columns play no part; an empty table gives no rows. ``span`` turns
    make a chunk; results don't depend on it.

    Texts are shuffled once, for the digest of the repaired text; everything else works on facts of some 80 bytes a row. Exact repeats are
    counted before they meet. What remains in one task is one pass over a conversation's sorted rows with a running SHA-256,
    which can't be split, and with memory for its audit.
    """
    facts = written(_facts(rows, span))
    kind = rows.schema["conv"].dataType.simpleString()
    chunks = arrow_map(_strings(facts).select("conv", "chunk", "low", "high", "turns", "seq"), _solve, SOLVED.format(kind))
    reports = chunks.repartition("conv").sortWithinPartitions("conv", "chunk").transform(arrow_map, _join, f"conv {kind}, {', '.join(f'{c} long' for c in REPORT)}, audit string")
    empty = lambda names: [F.lit(None).cast(t).alias(n) for n, t in names]
    heads = reports.select("conv", F.lit(0).alias("kind"), *empty([("turn", rows.schema["turn"].dataType), ("role", "string"), ("text", "string"), ("n", "long"), (DIGEST, "binary")]), *REPORT, "audit")
    lines = rows.where("n > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "n", _same(F.col("role"), F.col("text")).alias(DIGEST),
                                       *empty([(c, "long") for c in REPORT] + [("audit", "string")]))
    ordered = heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "kind", "turn", F.substring("role", 1, 64), DIGEST)
    return ordered.drop(DIGEST, "turn").transform(arrow_map, _hash, f"conv {kind}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")


def _sql() -> str:
    """Brute force by rows: four weights {c, a, t} (cost, audit, text) per conversation, taken one row further in each step."""
    add = lambda w, cost, letter, line: f"{{'c': {w}.c + {cost}, 'a': {w}.a || '{letter}', 't': {w}.t || {line}}}"
    insert = lambda w, role: add(w, 2, "I", f"chr(10) || '{role}:'")

    def edit(w: str, role: str) -> str:
        keep = add(w, "r.fault", "K", "chr(10) || r.role || ':' || r.text")
        change = add(w, "2 + r.fault", "R", f"chr(10) || '{role}:' || r.text")
        return f"CASE WHEN r.fault > 1 THEN {none} WHEN r.i = '{role[0]}' THEN {keep} ELSE {change} END"

    delete = lambda w: add(w, 3, "D", "''")
    none = "{'c': 1000000000000, 'a': '', 't': ''}"
    users = "least(u, " + ", ".join(insert(w, "user") for w in ("z", "s", "a")) + ")"
    closed = lambda source: f"SELECT conv, n, z, s, u, least(a, {insert('u', 'assistant')}) AS a FROM (SELECT conv, n, z, s, {users} AS u, a FROM {source})"
    kept = f"CASE WHEN r.fault < 2 AND r.i = 's' THEN {add('d.z', 'r.fault', 'K', "chr(10) || r.role || ':' || r.text")} ELSE {none} END"
    return f"""WITH RECURSIVE x AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS x FROM range(256) t(i)),
p AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
e AS (SELECT p.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d FROM p, x),
m AS (SELECT conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, left(role, 64), md5(strlen(role) || ':' || role || strlen(text) || ':' || text), copy) AS n, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM m),
f AS (SELECT *, CASE WHEN last = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 3 WHEN last IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
  coalesce(lag(i) OVER (PARTITION BY conv ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
d AS ({closed(f"(SELECT DISTINCT conv_id AS conv, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS z, {none} AS s, {none} AS u, {none} AS a FROM conversations)")}
  UNION ALL {closed(f"(SELECT d.conv, r.n, {delete('d.z')} AS z, least({delete('d.s')}, {kept}) AS s, least({delete('d.u')}, {', '.join(edit(w, 'user') for w in ('d.z', 'd.s', 'd.a'))}) AS u, least({delete('d.a')}, {edit('d.u', 'assistant')}) AS a FROM d JOIN f r ON r.conv IS NOT DISTINCT FROM d.conv AND r.n = d.n + 1)")}),
t AS (SELECT conv, least(z, a) AS w FROM d QUALIFY row_number() OVER (PARTITION BY conv ORDER BY n DESC) = 1),
g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv)
SELECT t.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  t.w.c AS cost, t.w.a AS audit, sha256(substr(t.w.t, 2)) AS repaired_sha256 FROM t LEFT JOIN g ON g.conv IS NOT DISTINCT FROM t.conv"""


@query("op13_conversation_repair", _sql())
def op13(t):
    return repair(damaged(t("conversations"))).withColumnRenamed("conv", "conv_id")
