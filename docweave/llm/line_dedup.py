"""Operator 5: line deduplication by a segment-partition edit join, with DataFrame functions only.

Two lines are alike if they lie within a threshold of edits (characters inserted, deleted or replaced) that the
length of the shorter one sets (``THRESHOLDS``): none under 24 characters and 2 from there, unless the caller lets
longer lines differ more. Alike lines fall into one class, transitively. A line is cut into threshold + 1 segments, of which a line within the threshold must
keep at least one; lines are found by their own segments and by those substrings of their text that could be a
segment of another line of about the same length, at the positions that the edits allow. In every bucket of equal
segments all lines are compared with the smallest line first, one row for each member; buckets that still hold
several classes are then searched for the remaining pairs, by length and in blocks of ``BLOCK`` lines. Parity
signatures of the characters and of their pairs thin out what is compared. Comparisons use a banded bit-parallel edit distance over
2 * threshold + 1 diagonals.

Lines are trimmed of white space. The first line of a class, by document and line number, stays.

Defined results: null, empty and blank texts have no lines; lines are known by a 64-bit hash of their text; an
empty table gives an empty result; rows are told apart by id and text, so that rows of one id or without id are
documents of their own, those without id first in the order, and rows that agree in both count as one document
(``line_classes`` returns their lines as often as they are given, ``dedup_lines`` keeps one); other columns are
ignored (``line_classes``) or kept (``dedup_lines``).
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from math import floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.components import connected_components
from docweave.llm.shared import SPACES, broadcast_if_few, cut, hot_keys, join_hot, one_of_each, row_named, text_key, tidied

#: The least length from which lines may differ, and by how many edits; further pairs let longer lines differ more.
THRESHOLDS = ((24, 2),)
CLASS_RATIO = 1.2
LONGEST = 1 << 31
LISTED = 1024  # lengths below are looked up in a list of their classes
BLOCK = 1024
BROADCAST_IDS = 1_000_000  # 8 MB of ids


def length_classes(thresholds: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """(least length, threshold) of every class of lengths; a class never spans a change of the threshold."""
    out = []
    for (low, t), (end, _) in zip(thresholds, [*thresholds[1:], (LONGEST, 0)], strict=True):
        if low < 2 * (t + 1):
            raise ValueError("a line must hold two characters for each segment")
        while low < end:
            out.append((low, t))
            low = max(low + 1, floor(low * CLASS_RATIO))
    return out


def threshold_of(n_chars: Column, thresholds: tuple[tuple[int, int], ...]) -> Column:
    t = F.lit(0)
    for low, edits in thresholds:
        t = F.when(n_chars >= low, F.lit(edits)).otherwise(t)
    return t


def _trimmed(raw: Column) -> Column:
    outer = [f for c in SPACES for f in (raw.startswith(c), raw.endswith(c))]
    return F.when(reduce(or_, outer), F.btrim(raw, F.lit(SPACES))).otherwise(raw)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))
    trimmed = split.select("doc_id", "text_key", "line_no", _trimmed(F.col("raw")).alias("line")).filter("line <> ''")
    return trimmed.select("*", F.xxhash64("line").alias("id"), F.char_length("line").alias("n_chars"))


def _places(t: int) -> list[tuple[int, bool, int, int]]:
    """(segment, counted from the line's start, place from that end, shift) of the substrings that stand for segments.

    With i segments between it and that end, a segment is shifted by i characters at most, or there would be a
    better one."""
    places = [(i, True, i, d) for i in range(t // 2 + 1) for d in range(-i, i + 1)]
    return places + [(i, False, t - i, d) for i in range(t // 2 + 1, t + 1) for d in range(i - t, t - i + 1)]


def segment_keys(lines: DataFrame, thresholds: tuple[tuple[int, int], ...]) -> DataFrame:
    """(id, key, own): the segments of every line, and its substrings that may be segments of another line.

    Lines of similar length form a class (ratio ``CLASS_RATIO``) whose t + 1 segments have one size, a share of the
    class's least length, so that they are disjoint in every line of it. The first half of them is placed from the
    line's start and the rest from its end. A line also stands in the class of lines t shorter."""
    classes = length_classes(thresholds)
    lows = [low for low, _ in classes]
    struct = F.struct

    def placed(t: int, low: bool) -> Column:
        return F.array(*[struct(F.lit(i).alias("i"), F.lit(left).alias("left"), F.lit(n).alias("n"), F.lit(d).alias("d"), F.lit(low).alias("low")) for i, left, n, d in _places(t)])

    known = F.expr(f"array({', '.join(str(bisect_right(lows, length) - 1) for length in range(LISTED))})")

    def class_of(n: Column) -> Column:
        return F.when(n < LISTED, F.get(known, n)).otherwise(F.size(F.filter(F.array(*[F.lit(low) for low in lows]), lambda x: x <= n)) - 1)

    n = F.col("n_chars")
    nearest = F.greatest(F.lit(classes[0][0]), n - threshold_of(n, thresholds))
    classed = lines.filter(n >= classes[0][0]).select("id", "line", "n_chars", class_of(n).alias("high"), class_of(nearest).alias("low"))
    sizes = F.array(*[F.lit(low // (t + 1)) for low, t in classes])
    tiers = sorted({t for _, t in classes})
    limits = F.array(*[F.lit(t) for _, t in classes])

    def entries(at: str, low: bool) -> Column:
        out = placed(tiers[0], low)
        for t in tiers[1:]:
            out = F.when(F.get(limits, F.col(at)) == t, placed(t, low)).otherwise(out)
        return out

    both = F.when(F.col("high") == F.col("low"), entries("high", False)).otherwise(F.concat(entries("high", False), entries("low", True)))
    sized = classed.select("*", F.explode(both).alias("e")).withColumn("class", F.when(F.col("e.low"), F.col("low")).otherwise(F.col("high"))).withColumn("size", F.get(sizes, F.col("class")))
    start = F.when(F.col("e.left"), F.col("e.n") * F.col("size")).otherwise(n - (F.col("e.n") + 1) * F.col("size")) + F.col("e.d")
    at = sized.withColumn("start", start).filter("start >= 0 AND start + size <= n_chars")
    return at.select("id", F.xxhash64("class", "e.i", F.substring("line", F.col("start") + 1, F.col("size"))).alias("key"), (~F.col("e.low") & (F.col("e.d") == 0)).alias("own"))


def parity_signatures(line: Column) -> tuple[Column, Column]:
    """One bit for each character code, and for each pair of neighbouring ones, modulo 64: whether it occurs an odd
    number of times. An edit flips two bits of the first at most, and four of the second."""
    none, chars = F.lit(0).cast("long"), F.split(line, "", -1)

    def flipped(bits: Column, code: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), code))  # a shift is taken modulo 64

    codes = F.transform(chars, lambda c: F.ascii(c))
    pairs = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: a * 131 + F.coalesce(b, F.lit(0)))
    return F.aggregate(codes, none, flipped), F.aggregate(pairs, none, flipped)


def _let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edit_distance(a: str, b: str, t: int) -> Column:
    """Distance of two string columns if it is at most ``t``; else some number above ``t``.

    Bit k of the vectors stands for row j - t + k of column j. The distance is followed down the lower edge of the
    band, then along the last row."""
    long_first = F.char_length(a) >= F.char_length(b)
    x, y = F.when(long_first, F.col(a)).otherwise(F.col(b)), F.when(long_first, F.col(b)).otherwise(F.col(a))
    width, mask = 2 * t + 1, (1 << (2 * t + 1)) - 1
    m, n = F.char_length(x), F.char_length(y)
    state = "struct<vp:int,vn:int,d:int,j:int>"

    def left(v: Column, by: int | Column) -> Column:
        return F.call_function("shiftleft", v, F.lit(by) if isinstance(by, int) else by)

    def bit(v: Column, at: Column | int) -> Column:
        return F.call_function("shiftright", v, F.lit(at) if isinstance(at, int) else at).bitwiseAND(F.lit(1))

    def flip(v: Column) -> Column:
        return F.bitwise_not(v).bitwiseAND(F.lit(mask))

    def step(s: Column, match: Column) -> Column:
        vp, vn, j = s["vp"], s["vn"], s["j"]
        kept = match.bitwiseAND(vp)
        d0 = (kept + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(mask))

        def after(z: Column) -> Column:
            hp, hn = vn.bitwiseOR(flip(z.bitwiseOR(vp))), z.bitwiseAND(vp)
            down = F.call_function("shiftright", z, F.lit(1))
            row = s["m"] - j + t
            d = s["d"] + F.when(j <= s["m"] - t, 1 - bit(z, 2 * t)).otherwise(bit(hp, row) - bit(hn, row))
            return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.cast("int").alias("d"), (j + 1).alias("j"), s["m"].alias("m"))

        return _let(d0, after)

    def compare(pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        matches = F.transform(
            q,
            lambda c, j: sum(
                (left(F.when(F.get(p, j + (k - t)) == c, F.lit(1)).otherwise(F.lit(0)), k) for k in range(1, width)),
                F.when(F.get(p, j - t) == c, F.lit(1)).otherwise(F.lit(0)),
            ),
        )
        start = F.struct(
            F.lit(((1 << (t + 1)) - 1) << t).alias("vp"), F.lit(0).alias("vn"), F.lit(t).alias("d"), F.lit(1).alias("j"), F.size(p).alias("m")
        )
        return F.aggregate(matches, start, step, lambda s: s["d"])

    chars = F.struct(F.split(x, "", -1).alias("p"), F.split(y, "", -1).alias("q"))
    return F.when((m - n > t) | (n <= t), F.lit(t + 1)).otherwise(_let(chars, compare))


def _close(a: str, b: str, thresholds: tuple[tuple[int, int], ...]) -> Column:
    """Whether lengths and signatures allow two lines, whose columns have these prefixes, to be alike."""
    n_a, n_b = F.col(f"{a}n_chars"), F.col(f"{b}n_chars")
    t = threshold_of(F.least(n_a, n_b), thresholds)

    def flips(c: str) -> Column:
        return F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))

    return (F.abs(n_a - n_b) <= t) & (flips("sig") <= 2 * t) & (flips("sig2") <= 4 * t)


def _verified(pairs: DataFrame, texts: DataFrame, thresholds: tuple[tuple[int, int], ...]) -> DataFrame:
    """The pairs (a, b) of line ids that are alike."""
    few = ["n_chars", "sig", "sig2"]

    def side(c: str, columns: list[str]) -> DataFrame:
        return texts.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns])

    near = pairs.join(side("a", few), "a").join(side("b", few), "b").filter(_close("a_", "b_", thresholds)).select("a", "b")
    with_both = near.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    n_a, n_b = F.char_length("line_a"), F.char_length("line_b")
    tier, alike = threshold_of(F.least(n_a, n_b), thresholds), F.lit(False)
    for t in sorted({t for _, t in thresholds}):
        alike = F.when(tier == t, edit_distance("line_a", "line_b", t) <= t).otherwise(alike)
    return cut(with_both.filter(alike).select("a", "b"))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, out: str) -> DataFrame:
    joined = rows.join(labels.select(F.col("node").alias(id_col), F.col("label").alias(out)), id_col, "left")
    return joined.withColumn(out, F.coalesce(out, id_col))


def _facing(rest: DataFrame, widest: int, thresholds: tuple[tuple[int, int], ...]) -> DataFrame:
    """(a, b): lines of one bucket and different labels that lengths and signatures allow to be alike. Lines meet by
    length; many lines of one bucket and length are dealt into blocks, so that no key holds more than BLOCK of each side."""
    x = rest.filter("own").withColumn("n", F.col("n_chars"))
    y = rest.withColumn("n", F.explode(F.sequence(F.col("n_chars") - widest, F.col("n_chars") + widest)))
    blocks = (
        x.groupBy("key", "n").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
        .join(y.groupBy("key", "n").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("columns")), ["key", "n"])
    )
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    x = x.join(blocks, ["key", "n"]).withColumn("i", F.pmod(mine, F.col("rows"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).alias("x")
    y = y.join(blocks, ["key", "n"]).withColumn("j", F.pmod(mine, F.col("columns"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).alias("y")
    same_place = (F.col("x.key") == F.col("y.key")) & (F.col("x.n") == F.col("y.n")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    other = (F.col("x.label") != F.col("y.label")) & (~F.col("y.own") | (F.col("x.id") < F.col("y.id")))
    close = _close("x.", "y.", thresholds)
    return x.join(y, same_place & other & close).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


@tidied
def line_classes(docs: DataFrame, thresholds: tuple[tuple[int, int], ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, line_no, n_chars, line_id, class_id, first_doc_id, first_text_key, first_line_no, keep for every line with a word."""
    lines = _lines(docs, id_col, text_col)
    occurrences = cut(lines.select("doc_id", "text_key", "line_no", "n_chars", "id"))
    keys = segment_keys(lines, thresholds)

    # buckets with two lines, one of them by its own segment
    buckets = cut(
        keys.groupBy("key")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.when(F.col("own"), F.col("id"))).alias("leader"))
        .filter("low <> high AND leader IS NOT NULL")
        .select("key", "leader")
    )
    members = cut(keys.join(buckets, "key").groupBy("key", "leader", "id").agg(F.max("own").alias("own")))
    wanted = cut(members.select("id").distinct())
    texts = cut(
        lines.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")
        .select("id", "line", "n_chars")
        .dropDuplicates(["id"])
        .select("*", *[s.alias(c) for c, s in zip(("sig", "sig2"), parity_signatures(F.col("line")), strict=True)])
    )

    stars = members.filter("leader <> id").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    links = _verified(stars, texts, thresholds)
    labels = connected_components(links)

    seen = _labelled(_labelled(members.select("key", "leader", "id", "own"), labels, "leader", "at"), labels, "id", "label")
    open_keys = seen.filter("at <> label").select("key").distinct()
    rest = cut(seen.join(open_keys, "key", "left_semi").join(texts.select("id", "n_chars", "sig", "sig2"), "id").select("key", "id", "own", "label", "n_chars", "sig", "sig2"))
    cross = _facing(rest, max(t for _, t in thresholds), thresholds)
    more = _verified(cross.join(stars, ["a", "b"], "left_anti"), texts, thresholds)
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    # the first place of each line, then of each class, then back to the lines
    place = F.struct("doc_id", "text_key", "line_no")
    classed = cut(_labelled(occurrences.groupBy("id").agg(F.min(place).alias("own_first")), labels, "id", "class_id"))
    first = classed.groupBy("class_id").agg(F.min("own_first").alias("first"))
    told = cut(join_hot(classed, first, "class_id", hot_keys(classed, "class_id")).select("id", "class_id", "first"))
    return join_hot(occurrences, told, "id", hot_keys(occurrences, "id")).select(
        "doc_id",
        "text_key",
        "line_no",
        "n_chars",
        F.col("id").alias("line_id"),
        "class_id",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.text_key").alias("first_text_key"),
        F.col("first.line_no").alias("first_line_no"),
        place.eqNullSafe(F.col("first")).alias("keep"),
    )


def dedup_lines(docs: DataFrame, thresholds: tuple[tuple[int, int], ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without their repeated lines; documents all of whose lines repeat earlier ones go."""
    docs = one_of_each(docs, id_col, text_col)
    gone = broadcast_if_few(
        line_classes(docs, thresholds, id_col, text_col)
        .groupBy(F.col("doc_id").alias("id"), "text_key")
        .agg(F.collect_set(F.when(~F.col("keep"), F.col("line_no"))).alias("gone"), F.max("keep").alias("some"))
        .filter("size(gone) > 0")
        .withColumnRenamed("text_key", "key")
    )
    text = F.col(f"row.`{text_col}`")
    rows = row_named(docs, "row").withColumn("text_key", text_key(text))
    joined = rows.join(gone, F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").filter("gone IS NULL OR some")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(left)
    return joined.select(*[(cleaned if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
