"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes when an equal line, or one within some insertions, deletions and substitutions, stands at an earlier place: one
for each 20 characters by default (``near_by_share``), or a fixed number ``edits``. Two lines within ``edits`` share one of ``edits + 1`` even segments of the shorter one, at a place whose shift is bounded by
the segment's number and the difference in length: every distinct line is indexed by its segments and probes those of
lines up to ``edits`` shorter. Lines that meet under a key must also have nearly the same counts of some letters. What is
left is verified by a banded bit-parallel edit distance: for each number of errors a word holds the reachable diagonals,
and one step over a character moves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import WIDE, discard, spread
from .common import query, written

LETTERS = "enri"  # their counts make up the filter word, a byte each


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stripped(a: Column, b: Column) -> Column:
    """Struct (p, t): what is left of two different strings without their common prefix and suffix. Bisects on whole comparisons."""
    most = F.length(F.bin(F.least(F.length(a), F.length(b)))) - 1
    steps = F.transform(F.sequence(most, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    common = lambda x, y, end: F.aggregate(steps, F.lit(0), lambda n, s: F.when(end(x, n + s) == end(y, n + s), n + s).otherwise(n))
    rest = _let(common(a, b, F.left), lambda n: F.struct(F.substring(a, n + 1, F.lit(1 << 30)).alias("p"), F.substring(b, n + 1, F.lit(1 << 30)).alias("t")))
    cut = lambda x, n: F.left(x, F.length(x) - n)
    return _let(rest, lambda r: _let(common(r["p"], r["t"], F.right), lambda n: F.struct(cut(r["p"], n).alias("p"), cut(r["t"], n).alias("t"))))


def _reached(a: Column, b: Column, edits: int) -> Column:
    """The diagonals that a match of ``b`` against the start of ``a`` can end on with up to ``edits`` errors, as bits.

    Bit d of word e means: with e errors, the first j characters of ``b`` match the first j + d - edits of ``a``.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    start = [((1 << (edits + e + 1)) - 1) & ~((1 << edits) - 1) & mask for e in range(edits + 1)]  # leading deletions

    def equal(p: Column, t: Column, j: Column) -> Column:
        same = F.lit(0)
        for d in range(width):
            same = same.bitwiseOR(F.when(F.get(p, j + (d - edits)) == F.get(t, j), F.lit(1 << d)).otherwise(F.lit(0)))
        return same

    def step(state: Column, j: Column) -> Column:
        out = []
        for e in range(edits + 1):
            new = state[f"r{e}"].bitwiseAND(state["c"])
            if e:
                less = state[f"r{e - 1}"]
                new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(out[e - 1], 1))
            out.append(new.bitwiseAND(F.lit(mask)))
        # The characters of the next step are compared here, so that their word is built once.
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(out)], state["p"].alias("p"), state["t"].alias("t"), equal(state["p"], state["t"], j).alias("c"))

    def run(x: Column) -> Column:
        begin = F.struct(*[F.lit(s).alias(f"r{e}") for e, s in enumerate(start)], x["p"].alias("p"), x["t"].alias("t"), equal(x["p"], x["t"], F.lit(0)).alias("c"))
        return F.aggregate(F.sequence(F.lit(1), F.size(x["t"])), begin, step, lambda end: reduce(lambda m, n: m.bitwiseOR(n), [end[f"r{e}"] for e in range(edits + 1)]))

    return _let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t")), run)


def within_edits(a: Column, b: Column, edits: int, probe: int = 16) -> Column:
    """Whether the edit distance of two strings is at most ``edits`` (up to 14): banded and bit-parallel, between the ends
    that they have in common. Strings that differ more mostly run out of diagonals within the first ``probe`` characters."""

    def judge(x: Column) -> Column:
        p, t = x["p"], x["t"]
        at = F.length(p) - F.length(t) + edits
        ended = F.call_function("shiftright", _reached(p, t, edits), at).bitwiseAND(F.lit(1)) == 1
        return (F.when(~at.between(0, 2 * edits), False).when((F.length(p) == 0) | (F.length(t) == 0), F.length(p) + F.length(t) <= edits)
                .when(F.greatest(F.length(p), F.length(t)) <= edits, True)
                .when(_reached(F.left(p, F.lit(probe + edits)), F.left(t, F.lit(probe)), edits) == 0, False).otherwise(ended))

    return F.when(a == b, True).when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(_let(_stripped(a, b), judge))


def _segments(length: str, edits: int) -> list[tuple[str, str]]:
    """SQL: (start, size) of the ``edits + 1`` even segments of a line of the given length: the longer ones come last."""
    n = edits + 1
    out = []
    for i in range(n):
        size = f"cast(({length} + {i}) div {n} as int)"
        start = " + ".join([f"cast(({length} + {k}) div {n} as int)" for k in range(i)]) or "0"
        out.append((start, size))
    return out


def keys(edits: int, line: str = "line", length: str = "n") -> str:
    """SQL: (key, own) of a line: its own segments (own = 1), and the substrings that probe lines up to ``edits`` shorter; null where there are none."""
    out = []
    for short in range(edits + 1):
        target = f"({length} - {short})"
        for i, (start, size) in enumerate(_segments(target, edits)):
            for shift in range(max(-i, short - (edits - i)), min(i, short + (edits - i)) + 1):
                key = f"xxhash64({target}, {i}, substring({line}, {start} + {shift} + 1, {size}))"
                inside = [f"{target} > {edits}"] + [f"{start} + {shift} >= 0"] * (shift < 0) + [f"{start} + {shift} + {size} <= {length}"] * (shift > short)
                out.append(f"if({' and '.join(inside)}, struct({key} as key, {int(short == 0 and shift == 0)} as own), null)")
    return f"array({', '.join(out)})"


def _letters(line: str = "line") -> str:
    """SQL: the counts of some letters, modulo 256, a byte each."""
    parts = [f"shiftleft(cast((octet_length({line}) - octet_length(replace({line}, '{c}', ''))) & 255 as bigint), {8 * k})" for k, c in enumerate(LETTERS)]
    return " | ".join(parts)


def _close(a: str, b: str, edits: int | str) -> str:
    """SQL: whether two words of letter counts differ by at most two for each edit."""
    terms = []
    for k in range(len(LETTERS)):
        byte = lambda x: f"(shiftright({x}, {8 * k}) & 255)"  # noqa: B023, E731
        d = f"(({byte(a)} - {byte(b)} + 256) & 255)"
        terms.append(f"least({d}, 256 - {d})")
    return f"{' + '.join(terms)} <= 2 * {edits}"


def _lines(docs: DataFrame) -> DataFrame:
    """(id, text) -> (id, version, pos, line): the lines with more than blanks; ``version`` tells rows with equal ids apart by their text."""
    lines = docs.where("text is not null").select("id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where("line rlike '[^ \\\\t\\\\r]'")


def near_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """(line) -> (a, b): hashes of different lines that may be within ``edits``. Each pair is one of a segment's owner and a prober."""
    keyed = (lines.select("line", F.length("line").alias("n"), F.xxhash64("line").alias("id"), F.expr(_letters()).alias("letters"))
             .select("id", "letters", F.expr(f"inline({keys(edits)})")).where("key is not null").repartition(F.col("key")).distinct())
    side = lambda k: keyed.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("id", "letters", "own")])
    # One product, which the optimizer can't pull apart: both sides stay the same exchange, and it runs once.
    once = "own1 * if(id1 < id2, 1, if(id1 > id2, 1 - own2, 0)) = 1"
    met = side(1).join(side(2), "key").where(f"{once} and {_close('letters1', 'letters2', edits)}")
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


WIDER = 1.5  # a class of lengths is that much wider than the last
COMMON = 3  # keys that a near pair has in common
MISS = 1e-9  # up to this chance of fewer
PARTS = 8  # slots of a class of lengths
TURNS = 4  # parts of a slot's keys that are sorted one after the other
STRETCH = 6  # size of a stretch, in edits that a line may have
KEY = "cast((x & 4294967295) - 2147483648 as int)"  # what travels of a hash x
EXACT = 500  # numbers of common keys whose limits are tabled
GRAMS = ((0, 11), (4.3, 12), (6.4, 13), (9.7, 14), (49, 15), (110, 16))  # sizes of grams for 20 characters an edit, from a length in edits on


def _classes(per: int, whole: int) -> list[tuple[int, int]]:
    """(q, width) for each class of lengths: the size of its grams, and the size of the stretches that places are told by.

    Long grams seldom meet by chance, but edits leave fewer of them alone: the longer a line, the longer its grams may be."""
    out = []
    for c in range(54):
        n = max(WIDER ** c, (whole + 1) * per)
        edits = min(math.ceil(WIDER ** (c + 1)), (1 << 31) - 1) // per + 1
        q = max(size for start, size in GRAMS if n >= start * per)
        out.append((max(1, q * per // 20), STRETCH * edits))
    return out


def _fewer(common: int, rate: float) -> float:
    """The chance that of ``common`` keys, each taken at ``rate``, fewer than ``COMMON`` are taken."""
    choose = lambda j: math.lgamma(common + 1) - math.lgamma(j + 1) - math.lgamma(common - j + 1)
    return sum(math.exp(choose(j) + j * math.log(rate) + (common - j) * math.log1p(-rate)) for j in range(min(COMMON, common + 1)))


@lru_cache(maxsize=1)
def _limits() -> tuple[list[int], float]:
    """Below which of 2**24 places a key's hash must fall where lines have 1, 2, ... ``EXACT`` keys in common, so that fewer than ``COMMON`` are taken of them
    with a chance of at most ``MISS``; never rising. For more common keys: how many must be taken on average, by Poisson's law, whose chance is larger."""
    out = []
    for common in range(1, EXACT + 1):
        low, high = 0, (1 << 24) - 1
        while low + 1 < high:
            low, high = (low, mid) if _fewer(common, (mid := (low + high) // 2) / (1 << 24)) <= MISS else (mid, high)
        out.append(high)
    low, high = 1.0, 1000.0
    while high - low > 1e-6:
        mid = (low + high) / 2
        low, high = (mid, high) if sum(math.exp(j * math.log(mid) - math.lgamma(j + 1) - mid) for j in range(COMMON)) > MISS else (low, mid)
    return out, high


def _wide(line: str = "line") -> str:
    """SQL: a line as four bytes a character, so that a piece of it is found without a walk. What is no character counts as one, as in ``length``."""
    odd = f"transform(sequence(1, length({line})), i -> substring({line}, i, 1))"
    odd = f"unhex(array_join(transform({odd}, x -> if(is_valid_utf8(x), hex(encode(x, 'UTF-32')), left(md5(x), 8))), ''))"
    return f"if(is_valid_utf8({line}), encode({line}, 'UTF-32'), {odd})"


def _share_keys(per: int, whole: int = 3) -> str:
    """SQL: (slot, keys) of a line (``line``, its length ``n``): every pair within one edit for each ``per`` characters of the longer line has ``COMMON``
    keys in common, up to a chance of ``MISS``.

    Up to ``whole`` edits these are the segments of ``keys``, of which one is enough, under slots below ``PARTS * (whole + 1)``. Beyond, they are the grams, each told
    also by the stretch of the line that it starts in, whose hash is small, per class of lengths; a line whose longer partner may be in the next class is in both.

    A line of n characters and a shorter one within ``n div per`` edits have at least n - q + 1 - q (n div per) grams of q characters in common whose places
    are at most the edits apart. Of lines with few repeated grams only different ones count, which are fewer in common by no more than either line repeats;
    beyond a quarter the j-th equal gram of a stretch counts as another one than the first, and the limit is that of a line with a quarter repeated. How small
    a hash must be follows a line's own length: a shorter line takes all that a longer one would, so the longer one's limit holds for both.
    A gram that starts as many places before the next stretch as there may be edits is in both, too: of two grams that an alignment pairs, the
    earlier one is also in the stretch of the later one. A slot holds the keys of a stretch, or some of the segments', so that what else is known
    of a line travels once for some keys.
    """
    part = lambda c: f"transform(sequence(0, 3), b -> struct({c} * {PARTS} + b as slot, transform(filter(h, x -> (shiftright(x, 32) & 3) = b), x -> {KEY}) as keys))"
    segments = lambda c: f"array_distinct(transform(filter({keys(c)}, x -> x is not null), x -> x.key))"
    let = lambda value, name, use: f"element_at(transform(array({value}), {name} -> {use}), 1)"
    found = [f"if(n between {(per - 1) * c} and {per * (c + 1) - 1}, {let(segments(c), 'h', part(c))}, array())" for c in range(1, whole + 1)]
    sized = lambda x: f"cast(floor(ln({x}) / ln({WIDER}D)) as int)"
    table = lambda k: f"element_at(array({', '.join(str(x[k]) for x in _classes(per, whole))}), c + 1)"
    # Of each stretch b the grams that start there or up to k places before it, cut out of four bytes a character.
    told = "transform(sequence(4 * greatest(b * w - k, 0) + 1, 4 * least((b + 1) * w, n - q + 1) - 3, 4), i -> xxhash64(substring(p, i, z), b))"
    grams = f"transform(sequence(0, (n - q + k) div w), b -> {let(told, 'a', 'struct(a as a, array_distinct(a) as d)')})"
    grams = let("4 * q", "z", grams)
    before = f"aggregate(array({', '.join(str(1 << k) for k in range(20, -1, -1))}), 0, (m, t) -> if(get(s, i - m - t) = x, m + t, m))"
    again = let("sort_array(g.a)", "s", f"filter(transform(s, (x, i) -> if(i > 0 and get(s, i - 1) = x, xxhash64(x, {before}), null)), x -> x is not null)")
    limits, average = _limits()
    limit = f"if(m > {EXACT}, cast(ceil({average * (1 << 24)}D / m) as int), element_at(array({', '.join(map(str, limits))}), greatest(m, 1)))"
    edits = f"cast(n div {per - 1} as int)"  # of the longest line that this one may be near
    least = f"cast(n - n * cast(q as bigint) div {per} as int) - q - 1"
    below = let(let("cast(m - least(r, m div 4) as int)", "m", limit), "t", f"(cast(t as bigint) - {1 << 23}) * {1 << 40}")  # of hashes as signed numbers
    taken = f"transform(filter(if(r <= m div 4, g.d, concat(g.d, {again})), x -> x < t), x -> {KEY})"
    slots = f"transform(a, (g, b) -> struct(c * {PARTS} + least(b, {PARTS - 1}) as slot, {taken} as keys))"
    own = let("aggregate(a, 0, (r, g) -> r + size(g.a) - size(g.d))", "r", let(below, "t", slots))
    own = let(table(0), "q", let(least, "m", let(edits, "k", let(table(1), "w", let(grams, "a", own)))))
    grouped = f"flatten(transform(sequence({sized('n')}, {sized(f'n * {per}D / {per - 1}D + 1')}), c -> {own}))"
    found.append(f"if(n >= {(per - 1) * (whole + 1)}, {let(_wide(), 'p', grouped)}, array())")
    return f"filter(concat({', '.join(found)}), e -> size(e.keys) > 0)"


def _near(x: str, y: str, per: int) -> Column:
    """Whether two columns of strings are within one edit for each ``per`` characters of the longer one.

    Of two ends of a string that don't overlap one has at most half of the edits, so that it is within all of them of as long an end of the other
    string: strings that differ throughout mostly fail by their ends, as they are or without what they begin and end with in common."""
    allowed = f"cast(greatest(length({x}), length({y})) div {per} as int)"
    distance = lambda p, t, k: F.call_function("levenshtein", p, t, k)
    ends = lambda p, t, k, size: (F.least(F.length(p), F.length(t)) < 2 * size) | (distance(F.left(p, size), F.left(t, size), k) >= 0) | (distance(F.right(p, size), F.right(t, size), k) >= 0)
    rest = lambda s, k: F.when(ends(s["p"], s["t"], k, k * 4), distance(s["p"], s["t"], k) >= 0).otherwise(False)
    whole = lambda k: F.when(ends(F.col(x), F.col(y), k, k * 3), _let(_stripped(F.col(x), F.col(y)), lambda s: rest(s, k))).otherwise(False)
    return F.expr(f"abs(length({x}) - length({y})) <= {allowed}") & _let(F.expr(allowed), whole)


OFTEN = ("etao", "inr ")  # characters whose counts are compared, a word for four


def _counts(line: str = "line") -> str:
    """SQL: the counts of the characters of ``OFTEN`` modulo 32, in 5 bits each: as they travel."""
    return " | ".join(f"shiftleft(cast((octet_length({line}) - octet_length(replace({line}, '{c}', ''))) % 32 as bigint), {5 * k})" for k, c in enumerate("".join(OFTEN)))


def _word(k: int, counts: str = "counts") -> str:
    """SQL: word ``k`` of four of the counts, each as 16 bits of which n and n + d for d up to 16 differ in d: as they are compared."""
    codes = ", ".join(f"{(1 << r) - 1 if r <= 16 else 65536 - (1 << r - 16)}L" for r in range(32))
    return " | ".join(f"shiftleft(get(array({codes}), cast(shiftright({counts}, {5 * (4 * k + j)}) & 31 as int)), {16 * j})" for j in range(4))


def _alike(x: str, y: str, edits: str) -> str:
    """SQL: whether the counts of two lines differ by at most two for each edit; an edit changes them by no more."""
    return f"{' + '.join(f'bit_count({x}w{k} ^ {y}w{k})' for k in range(len(OFTEN)))} <= 2 * ({edits})"


def near_by_share(lines: DataFrame, per: int, whole: int = 3, group: int = 32) -> DataFrame:
    """(id, pos, line) -> (line), written: lines with a different line at an earlier place within one edit for each ``per`` characters of the longer one.

    Lines meet under their keys once, with their lengths and letter counts. Pairs that these allow are counted, and may be near if they have enough keys in
    common. Of these a line's best pair is verified first, the others if the line stays. Under a key of more than ``group`` lines a line first meets the earliest one only, which settles groups of near copies in as many pairs as
    lines; lines that this leaves meet all others there.
    """
    place = F.struct("id", "pos")
    made = []  # stage results that go when the lines are found

    def stage(df: DataFrame) -> DataFrame:
        made.append(written(df))
        return made[-1]

    words = [f"w{k}" for k in range(len(OFTEN))]
    about = ["id", "pos", "h", "n", *words]
    told = lines.select("id", "pos", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h"), F.expr(_counts()).alias("counts"))
    slots = told.select("id", "pos", "h", "n", "counts", F.expr(f"inline({_share_keys(per, whole)})")).transform(spread, "slot", least=WIDE)
    # Sorted by key first, whose values differ; both stay within the tasks of the slots.
    by = Window.partitionBy("key", "slot").orderBy("id", "pos", "h")
    sized = f"e.h <> h and abs(e.n - n) <= greatest(e.n, n) div {per}"
    alike = F.expr(_alike("", "e.", f"greatest(e.n, n) div {per}"))
    crowded = F.col("size") > group

    def meet(turn: int) -> DataFrame:
        """The pairs and the crowds under the keys of one turn. Turns read the same exchange, each sorts a part of it."""
        met = slots.select("slot", "id", "pos", "h", "n", "counts", F.explode("keys").alias("key")).where(f"(key & {TURNS - 1}) = {turn}")
        met = met.withColumn("size", F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        met = met.where("size > 1").withColumns({w: F.expr(_word(k)) for k, w in enumerate(words)}).drop("counts").withColumn("prior", F.collect_list(F.when(F.col("size") <= group, F.struct(*about))).over(by.rowsBetween(1 - group, -1)))
        met = met.select("*", F.expr(f"explode(if(size > {group}, array(struct({', '.join(about)})), filter(prior, e -> {sized})))").alias("e"))
        return met.where(crowded | alike).select("h", F.when(~crowded, F.col("e.h")).alias("y"), "slot", *[F.when(crowded, F.col(c)).alias(c) for c in ("key", "id", "pos", "n", *words)])

    met = stage(reduce(DataFrame.unionAll, [meet(turn) for turn in range(TURNS)]))
    weight = F.when(F.col("slot") < PARTS * (whole + 1), COMMON).otherwise(1).alias("weight")

    def verified(pairs: DataFrame) -> DataFrame:
        """(x, y) -> (h, line): of each near pair the line whose first place is later."""
        pairs = stage(pairs)
        wanted = pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct()
        found = stage(lines.withColumn("h", F.xxhash64("line")).join(wanted, "h", "left_semi").groupBy("h", "line").agg(F.min(place).alias("at")))
        x, y = [found.select(F.col("h").alias(s), *[F.col(c).alias(f"{c[0]}{s}") for c in ("line", "at")]) for s in ("x", "y")]
        near = pairs.join(x, "x").join(y, "y").where(_near("lx", "ly", per))
        return near.select(F.when(F.col("ay") < F.col("ax"), F.struct(F.col("x").alias("h"), F.col("lx").alias("line"))).otherwise(F.struct(F.col("y").alias("h"), F.col("ly").alias("line"))).alias("v")).select("v.*").distinct()

    crowd = met.where("y is null").select("slot", "key", *about)
    other = crowd.select("slot", "key", F.struct(*about).alias("e"))
    first = other.groupBy("slot", "key").agg(F.min("e").alias("e"))
    fits = F.expr(f"{sized} and struct(e.id, e.pos, e.h) < struct(id, pos, h)") & alike
    pair = [F.col("h").alias("x"), F.col("e.h").alias("y"), weight]
    enough = lambda pairs: pairs.groupBy("x", "y").agg(F.sum("weight").alias("weight")).where(f"weight >= {COMMON}")
    small = stage(met.where("y is not null").select(F.col("h").alias("x"), "y", weight).groupBy("x", "y").agg(F.sum("weight").alias("weight")))
    # y is at an earlier place than x: once x is known to go, its other pairs tell nothing. So each x first tries the y it has most keys in common with.
    tried = stage(enough(small.union(crowd.join(first, ["slot", "key"]).where(fits).select(*pair))).groupBy("x").agg(F.max_by("y", F.struct("weight", "y")).alias("y")))
    star = stage(verified(tried))
    gone = star.select(F.col("h").alias("x"))
    left = crowd.join(star.select("h"), "h", "left_anti").select("slot", "key", *about)
    rest = small.join(gone, "x", "left_anti").union(left.join(other, ["slot", "key"]).where(fits).select(*pair))
    rest = verified(enough(rest).select("x", "y").join(tried, ["x", "y"], "left_anti"))
    found = written(star.select("line").union(rest.select("line")).distinct())
    discard(*made)
    return found


def dedup_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", *, edits: int | None = None, per: int = 20, least: int = 20, hot: int = 10_000, small: int = 2_000_000) -> DataFrame:
    """``docs`` with ``text`` holding only kept lines, and with ``n_lines``, ``n_removed`` (longs; columns of these names are replaced).

    Places are ordered by (id, line number), null ids first. A line is removed when an equal line stands at an earlier place,
    or, from ``least`` characters on, one within ``edits``, or without such a number one edit for each ``per`` characters of the longer
    line, however long; what the earlier line's own fate is does not matter. Blank lines
    stay. Rows with equal ids are versions of one document: equal lines at equal places of them count as one place. A null
    text stays null with no lines; a text that loses all its lines becomes empty.

    The ``hot`` most frequent lines are broadcast (a fixed number) so that only their first places emit segments. Candidate
    lines are fetched by broadcasting their hashes while there are at most ``small`` of them, by a shuffled join beyond.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    lines, digest = _lines(rows), F.unhex(F.md5("line"))
    places = written(lines.select("id", "version", "pos", digest.alias("digest")))
    repeats = written(places.groupBy("digest").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    frequent = repeats.orderBy(F.desc("copies"), "digest").limit(hot).select(F.col("digest").alias("d"), F.col("first").alias("f"))
    long = lines.where(F.length("line") >= max(least, (edits or 0) + 1))
    fresh = long.join(F.broadcast(frequent), digest == F.col("d"), "left").where(F.col("d").isNull() | (F.struct("id", "pos") == F.col("f")))
    if edits is None:
        near = near_by_share(fresh.select("id", "pos", "line"), per).select(digest.alias("digest"))
    else:
        pairs = written(near_pairs(fresh.select("line"), edits))
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
        hint = F.broadcast if wanted.count() <= small else (lambda x: x)
        found = written(long.withColumn("h", F.xxhash64("line")).join(hint(wanted), "h", "left_semi").groupBy("h", "line").agg(F.min(F.struct("id", "pos")).alias("first")))
        a = found.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("first").alias("fa"))
        b = found.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("first").alias("fb"))
        near = (pairs.join(a, "a").join(b, "b").where((F.col("la") != F.col("lb")) & within_edits(F.col("la"), F.col("lb"), edits))
                .select(F.when(F.col("fa") < F.col("fb"), F.col("lb")).otherwise(F.col("la")).alias("line")).select(digest.alias("digest")).distinct())
    judged = repeats.select("digest", "first").join(near.withColumn("near", F.lit(True)), "digest", "full")
    gone = (places.join(judged, "digest").where(F.coalesce("near", F.lit(False)) | (F.struct("id", "pos") != F.col("first")))
            .groupBy("id", "version").agg(F.collect_set("pos").alias("gone")))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(*kept).withColumn("__version", F.xxhash64(F.col(text).cast("string")))
    joined = whole.join(gone.select(F.col("id").alias("__id"), F.col("version").alias("__v"), F.col("gone").alias("__gone")), F.col(id).eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__v")), "left")
    split = F.split(F.col(text).cast("string"), "\n")
    alive = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains("__gone", i), x)), lambda x: x.isNotNull())
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(alive, "\n")).alias(text) if c == text else F.col(c) for c in kept],
                         F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


@query("op1_line_dedup", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
d AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM l WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY line),
h AS (SELECT *, left(line, 10) AS head, right(line, 10) AS tail FROM d WHERE n >= 20),
c AS (SELECT a.line AS x, b.line AS y, b.n AS n FROM h a JOIN h b ON a.head = b.head AND b.n - a.n BETWEEN 0 AND 1 AND a.line <> b.line
      UNION SELECT a.line, b.line, b.n FROM h a JOIN h b ON a.tail = b.tail AND b.n - a.n BETWEEN 0 AND 1 AND a.line <> b.line),
e AS (SELECT x, y FROM c WHERE n - 1 <= len(list_filter(range(1, n + 1), lambda i: left(x, i) = left(y, i) AND length(left(x, i)) = i))
                              + len(list_filter(range(1, n + 1), lambda i: right(x, i) = right(y, i) AND length(right(x, i)) = i))),
g AS (SELECT CASE WHEN a.first < b.first THEN y ELSE x END AS line FROM e JOIN d a ON a.line = x JOIN d b ON b.line = y),
r AS (SELECT l.doc_id, l.pos, l.line, d.first IS NOT NULL AND ((l.doc_id, l.pos) <> d.first OR l.line IN (SELECT line FROM g)) AS gone FROM l LEFT JOIN d USING (line)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM documents LEFT JOIN k USING (doc_id)""")
def op1(t):
    kept = dedup_lines(t("documents").select("doc_id", "text"), edits=1)  # as its SQL has it
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


@query("op1_line_dedup_by_length")
def op1_by_length(t):
    """As ``op1_line_dedup``, with the edits allowed by the length of the lines: the form that the pipeline runs."""
    kept = dedup_lines(t("documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))
