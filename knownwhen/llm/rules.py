"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document: the ledger keeps the measurements and one integer whose bit ``r`` says that rule
``r`` failed. Policies are masks over those bits with a version, so a new policy, or the effect of leaving a rule out, is a bitwise
operation on the ledger and reads no text again. One pass over the documents, no exchange; only the counts of ``ablation`` meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capitals", "n_open_lines")


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a function that gives the column of a measurement. ``bit`` is the rule's place in the ledger and is never reused."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any rule of ``hard``, or at least ``tolerated`` + 1 rules of ``soft``."""

    name: str
    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    tolerated: int = 0


# Whole-number forms, so that no verdict depends on rounding.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(3, "word_length", lambda m: (m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 10 * m("n_words"))),
    Rule(4, "few_letter_words", lambda m: 100 * m("n_letter_words") < 80 * m("n_words")),
    Rule(5, "duplicate_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule(6, "capitals", lambda m: 100 * m("n_capitals") > 30 * m("word_chars")),
    Rule(7, "open_lines", lambda m: 100 * m("n_open_lines") > 30 * m("n_lines")),
)
POLICIES = (
    Policy("base", 1, ("few_words", "repeated_words")),
    Policy("web", 2, ("few_words", "repeated_words", "symbols", "word_length", "few_letter_words"), ("duplicate_lines", "capitals", "open_lines"), 0),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that the text holds at least twice. Windows are sorted with their places, so that equal
    ones become neighbours; the covered words follow from the gaps between the places of such windows."""
    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("k"), i.alias("i")))

    def places(s: Column) -> Column:
        twin = lambda j: ((j > 0) & (F.get(s, j - 1)["k"] == s[j]["k"])) | F.coalesce(F.get(s, j + 1)["k"] == s[j]["k"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda j: s[j]["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end"))
        return F.aggregate(p, start, step)["n"]

    return F.when(F.size(words) >= 4, let(F.sort_array(window(words)), lambda s: let(places(s), covered))).otherwise(0)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__m`` of the measurements (long), over the whole text; a NULL text has none of anything.

    Words are runs without the six ASCII blanks; lines end at ``\\n`` and count if they hold a word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    rows = docs.withColumns({"__t": t, "__w": F.array_remove(F.split(t, "[ \\t-\\r]+"), ""),
                             "__l": F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANK, "") != "")})
    w, line = F.col("__w"), F.col("__l")
    values = {
        "n_words": F.size(w), "word_chars": F.length(F.translate("__t", BLANK, "")), "n_symbols": without(F.col("__t"), SYMBOLS),
        "n_lines": F.size(line), "n_dup_lines": F.size(line) - F.size(F.array_distinct(line)), "n_repeat_words": _repeat_words(w),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))), "n_capitals": without(F.col("__t"), CAPITALS),
        "n_open_lines": F.size(F.filter(line, lambda x: F.rtrim(x, F.lit(BLANK)).endswith("...") | F.rtrim(x, F.lit(BLANK)).endswith("…"))),
    }
    return rows.withColumn("__m", F.struct(*[values[k].cast("long").alias(k) for k in MEASURES])).drop("__t", "__w", "__l")


def mask(rules: Sequence[Rule], names: Sequence[str]) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def ledger(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """-> the columns ``keep``, every measurement and ``failed`` (long, bit r set where rule r fails), one row per input row.

    Rows never meet, so repeated rows and ids, NULL ids and ties need no rule; columns outside ``keep`` are left out, and a kept
    column may not have the name of a measurement (ValueError). Empty tables give empty ledgers.
    """
    if taken := sorted({*MEASURES, "failed"} & set(keep)):
        raise ValueError(f"names of measurements: {taken}")
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need different bits from 0 to 62")
    m = F.col("__m")
    bits = [F.when(r.fails(lambda k: m[k]), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, text).select(*keep, *[m[k].alias(k) for k in MEASURES], failed.alias("failed"))


def kept(policy: Policy, rules: Sequence[Rule] = RULES, failed: str = "failed") -> Column:
    """The policy's verdict on a ledger row."""
    bits = F.col(failed)
    fine = bits.bitwiseAND(F.lit(mask(rules, policy.hard)).cast("long")) == 0
    if policy.soft:
        fine = fine & (F.bit_count(bits.bitwiseAND(F.lit(mask(rules, policy.soft)).cast("long"))) <= policy.tolerated)
    return fine


def ablation(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, by: Sequence[str] = ()) -> DataFrame:
    """-> (*by, rule, n_docs, n_kept, n_failed, n_alone, n_kept_without): for each rule of the policy, how many documents it fails, how
    many it alone rejects, and how many the policy without it keeps.

    The ledger is first counted by its masked bits (at most one row per ``by`` and pattern, combined before the exchange); every
    figure is then a bitwise question to those patterns.
    """
    used = [r for r in rules if r.name in {*policy.hard, *policy.soft}]
    patterns = book.groupBy(*by, F.col("failed").bitwiseAND(F.lit(mask(rules, policy.hard + policy.soft)).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    now = kept(policy, rules)
    outcomes = []
    for r in used:
        fails = F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0
        less = Policy(policy.name, policy.version, tuple(x for x in policy.hard if x != r.name), tuple(x for x in policy.soft if x != r.name), policy.tolerated)
        without = kept(less, rules)
        outcomes.append(F.struct(F.lit(r.name).alias("rule"), F.sum("n").alias("n_docs"), count(now).alias("n_kept"), count(fails).alias("n_failed"),
                                 count(~now & without).alias("n_alone"), count(without).alias("n_kept_without")))
    return patterns.groupBy(*by).agg(F.array(*outcomes).alias("__o")).select(*by, F.inline("__o"))


def _sql() -> str:
    return r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
s AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM k),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(0, 3) o(j) WHERE g.n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
  len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_open_lines
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words
  AND 100 * n_letter_words >= 80 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_capitals <= 30 * word_chars AND 100 * n_open_lines <= 30 * n_lines AS kept,
  (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (word_chars NOT BETWEEN 3 * n_words AND 10 * n_words)::BIGINT
  + 16 * (100 * n_letter_words < 80 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 64 * (100 * n_capitals > 30 * word_chars)::BIGINT
  + 128 * (100 * n_open_lines > 30 * n_lines)::BIGINT AS failed FROM b"""


@query("op12_quality_rules", _sql())
def op12(t):
    base, web = POLICIES
    return ledger(t("documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept(base)).alias("base_failed"), (kept(base) & kept(web)).alias("kept"), "failed")
