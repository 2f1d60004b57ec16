"""Operator 7: n-gram Jaccard join of all documents with themselves, exact.

A document's set holds the hashes of its distinct word n-grams. Two documents link when
``den * |A & B| >= num * |A | B|``. Such a pair's sizes lie close together and its sets differ in at most K
elements, K following from the sizes. So documents are put into overlapping bands of sizes; in a band the hash
space is cut into more than K ranges, and a linked pair must agree on one whole range at least. A tile is all
documents of a band that agree on one range. As K + 1 + E ranges are cut, a pair agrees on more than E, so a
document with at most E empty ranges needs no tile for its empty ones.

1. All rows of one text are one node, named by a 64-bit hash of the text's digest; digests that would share a hash
   get other names. So ids may repeat, with equal or with different texts.
2. In a tile every node is paired with the smallest one (first in the map task, then over all), which costs
   one row for each member. For every node the partner with most common tiles is compared exactly.
3. Tiles whose members are not yet in one component are searched for more links. Those with the same smallest
   member form one group. Bitmaps of hashed n-grams bound every remaining pair's overlap from above by bit counts,
   and what the bound leaves is intersected as sorted arrays. A group of up to ``BLOCK`` members and
   ``BLOCK_GRAMS`` n-grams is searched in one place; a larger one is dealt into blocks of that size by band and component, and two blocks meet if their
   bands touch and they are not of one component. A member is sent once for each block that it meets. No tile is
   skipped or sampled, so no component is missed.

Defined results: a null text or one without words has an empty set and links with nothing, not even with its
copies; a text of fewer than n words is one gram; every row is judged by its own text, whatever rows share its id, and
is returned as often as it is given; rows whose id is null link like others, but only ids that are not null name a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import md5
from math import ceil, exp, log, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.components import connected_components
from docweave.llm.shared import cut, hot_keys, join_hot, tidied

BAND_RATIO = 1.5
BLOCK, BLOCK_GRAMS = 1024, 8_000_000  # members of a block, and n-grams of all of them: 32 to 64 MB, and as much for bitmaps
KEYS_PER_TASK = 400_000
REMEMBERED = 500_000
BROADCAST_IDS = 1_000_000  # 8 MB of ids
HOT_LISTS = 10_000  # lists of the blocks of one band of a large group
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.encode("utf-8", "replace").translate(LOWER).split()), np.uint64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a sequence of word hashes."""
    if not len(words):
        return words
    size = min(n, len(words))
    m = len(words) - size + 1
    x = np.full(m, size, np.uint64)
    for j in range(size):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m])
    return np.unique(x)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


@dataclass(frozen=True)
class Rule:
    """n-gram length and the least similarity num / den."""

    n: int
    num: int
    den: int

    def links(self, common: int, a: int, b: int) -> bool:
        return common > 0 and self.den * common >= self.num * (a + b - common)

    @cached_property
    def bands(self) -> list[tuple[int, int, int, int]]:
        """(least size, largest size, number of ranges, E) of each band, up to 2 ** 40 elements."""
        out, low = [], 1
        while low < 1 << 40:
            high = max(low + 1, ceil(low * BAND_RATIO))
            most = (high - 1) * self.den // self.num
            k = (high - 1 + most) * (self.den - self.num) // (self.den + self.num)
            spare = 0
            for _ in range(8):  # so many empty ranges as the smallest documents are likely to have
                empty = (k + 1 + spare) * exp(-low / (k + 1 + spare))
                spare = ceil(empty + 3 * sqrt(empty)) if k and empty > 0.02 else 0
            out.append((low, most, k + 1 + spare, spare))
            low = high
        return out

    def keys(self, g: np.ndarray) -> np.ndarray:
        """The tiles of a set, as 64-bit keys."""
        found = []
        for band, (low, most, ranges, spare) in enumerate(self.bands):
            if low > len(g):
                break
            if len(g) > most:
                continue
            part = ((g >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), first)
            part = part[first]
            if ranges - len(first) > spare:
                absent = np.setdiff1d(np.arange(ranges, dtype=np.uint64), part)
                part, content = np.concatenate([part, absent]), np.concatenate([content, np.zeros(len(absent), np.uint64)])
            found.append(mix(content + mix(part + (np.uint64(band + 1) << np.uint64(48)))))
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """One row of 64-bit words for each set: one bit for each hash prefix, about 32 bits for each element of the
    largest set. ``width`` is the number of bits of the hashes."""
    bits = max(6, (32 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), 1 << (bits - 6)), np.uint64)
    for row, g in zip(out, sets, strict=True):
        at = g >> g.dtype.type(width - bits) if bits < width else g
        np.bitwise_or.at(row, (at >> g.dtype.type(6)).astype(np.int64), np.uint64(1) << (at & g.dtype.type(63)).astype(np.uint64))
    return out


def bound(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of one set with others: bits that only one side has stand for lost elements."""
    only_one = np.bitwise_count(one & ~many).sum(axis=1, dtype=np.int64)
    only_other = np.bitwise_count(many & ~one).sum(axis=1, dtype=np.int64)
    return np.minimum(size - only_one, sizes - only_other)


def _paired(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document; whether each row begins a key; the smallest document of each row's key."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return order, first, np.repeat(d[at], np.diff(np.append(at, len(k)))) if len(k) else d


TILE = "kind int, key long, leader long, doc long, n int"
SET, MEMBER, PAIR = 0, 1, 2


def _rows(kind: int, key: np.ndarray, leader: np.ndarray, doc: np.ndarray, n: np.ndarray | int = 0) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.int32(kind), "key": key.astype(np.int64), "leader": leader, "doc": doc, "n": np.int32(n) if np.isscalar(n) else n.astype(np.int32)})


def _spread_out(rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            batch = batch[np.fromiter((d not in seen for d in batch["doc"]), bool, len(batch))].drop_duplicates("doc")  # copies are one node
            seen.update(batch["doc"])  # as many as a task has rows
            sets = [grams(hashes.of(t), rule.n) for t in batch["text"]]
            ids, sizes = batch["doc"].to_numpy(np.int64), np.array([len(g) for g in sets], np.int64)
            yield _rows(SET, ids, ids, ids, sizes)
            keys = [rule.keys(g) for g in sets]
            key = np.concatenate(keys or [np.zeros(0, np.uint64)]).astype(np.int64)
            doc = np.repeat(ids, [len(k) for k in keys])
            order, first, leader = _paired(key, doc)
            key, doc = key[order], doc[order]
            yield _rows(MEMBER, key[first], doc[first], doc[first])
            yield _rows(PAIR, key[~first], leader[~first], doc[~first])

    return run


def _gather_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs each member of a tile with the tile's smallest one; the rest passes through."""
    keys, docs = [], []
    for batch in batches:
        member = batch["kind"].to_numpy() == MEMBER
        keys.append(batch["key"].to_numpy()[member])
        docs.append(batch["doc"].to_numpy()[member])
        if not member.all():
            yield batch[~member]
    if keys:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order, first, leader = _paired(key, doc)
        key, doc = key[order], doc[order]
        other = leader != doc
        yield _rows(PAIR, key[other], leader[other], doc[other])


def _exact(rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [(grams(hashes.of(x), rule.n), grams(hashes.of(y), rule.n)) for x, y in zip(batch["text_a"], batch["text_b"], strict=True)]
            linked = [rule.links(overlap(x, y), len(x), len(y)) for x, y in sets]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": np.array(linked, bool)})

    return run


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (doc, text) of a checkpointed table of ids (doc); the table is broadcast if it is small."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(few, "doc", "left_semi").dropDuplicates(["doc"])


def exact_links(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linked) for a checkpointed table of distinct pairs of ids of ``texts`` (doc, text)."""
    wanted = cut(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct())
    few = cut(_texts_of(texts, wanted))
    with_a = pairs.join(few.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(few.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(with_both.select("a", "b", "text_a", "text_b").mapInPandas(_exact(rule), "a long, b long, linked boolean"))


def _hashed_sets(rule: Rule, width: int):
    """Sorted hashes of ``width`` bits; narrow hashes can only make an overlap look larger."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = (grams(hashes.of(t), rule.n) for t in batch["text"])
            packed = [(g if width == 64 else (g >> np.uint64(32)).astype(np.uint32)).tobytes() for g in sets]
            yield pd.DataFrame({"doc": batch["doc"], "grams": packed})

    return run


def links_in_group(rule: Rule, doc: list[int], label: list[int], block: list[int], sets: list[np.ndarray], one_block: bool, width: int) -> list[tuple[int, int]]:
    """Links between the group's components, enough to connect what the group connects. Members of one block are
    compared with each other if the group has one block here, else with those of the other block."""
    root = {x: x for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out, size = [], np.array([len(g) for g in sets], np.int64)
    bits = bitmaps(sets, width) if len(sets) > 8 else None
    for x in range(len(sets)):
        if bits is None:
            near = range(x + 1, len(sets))
        else:
            most = bound(bits[x], size[x], bits[x + 1 :], size[x + 1 :])
            near = (x + 1 + np.flatnonzero(rule.den * most >= rule.num * (size[x] + size[x + 1 :] - most))).tolist()
        for y in near:
            if (one_block or block[x] != block[y]) and (p := find(label[x])) != (q := find(label[y])) and rule.links(overlap(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                root[max(p, q)] = min(p, q)
                out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
    return out


def _group_links(rule: Rule, width: int):
    """Rows sorted by group and blocks (home, i, j): links of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []

        def closed() -> list[tuple[int, int, int]]:
            doc, label, block, packed = zip(*rows, strict=True)
            sets = [np.frombuffer(g, np.uint64 if width == 64 else np.uint32) for g in packed]
            return [(at[0], a, b) for a, b in links_in_group(rule, doc, label, block, sets, at[1] == at[2], width)]

        for batch in batches:
            done = []
            for home, i, j, *row in zip(*(batch[c].tolist() for c in ("home", "i", "j", "doc", "label", "block", "grams")), strict=True):
                if (home, i, j) != at:
                    if len(rows) > 1:
                        done += closed()
                    at, rows = (home, i, j), []
                rows.append(row)
            yield pd.DataFrame(done, columns=["home", "a", "b"], dtype=np.int64)
        if len(rows) > 1:
            yield pd.DataFrame(closed(), columns=["home", "a", "b"], dtype=np.int64)

    return run


def _labelled(nodes: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    return nodes.join(labels.select(F.col("node").alias(node), F.col("label").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))


def _dealt(members: DataFrame, rule: Rule) -> DataFrame:
    """home, i, j, block, doc, label: members (home, doc, label, n) at the places where their blocks meet others."""
    filled = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)  # how many blocks the rows fill
    sizes = cut(members.groupBy("home").agg(filled.alias("filled")).filter(F.col("filled") > 1).select("home"))
    if sizes.isEmpty():
        return _dealt_small(members)
    wide = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    small = _dealt_small(members.join(wide, "home", "left_anti"))
    band = F.floor(F.log("n") / (log(rule.den / rule.num) + 1e-9)).cast("int")
    large = members.join(wide, "home", "left_semi").withColumn("band", band)
    # members of a component of more than a block stand in blocks of their own, which need not meet each other
    own = large.groupBy("home", "band", "label").agg(filled.alias("filled")).filter(F.col("filled") > 1).select("home", "band", "label", F.lit(True).alias("own"))
    grouped = cut(large.join(own, ["home", "band", "label"], "left").withColumn("lab", F.when(F.col("own"), F.col("label"))).drop("own"))
    blocks = grouped.groupBy("home", "band", "lab").agg(F.ceil(filled).cast("int").alias("blocks"))
    sized = blocks.select(F.col("home").alias("home_"), F.col("band").alias("band_"), F.col("lab").alias("lab_"), "blocks")
    same = (F.col("home") == F.col("home_")) & (F.col("band") == F.col("band_")) & F.col("lab").eqNullSafe(F.col("lab_"))
    placed = grouped.join(sized, same).select("home", "band", "lab", "doc", "label", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("blocks")).cast("int").alias("at"))
    listed = blocks.select("home", F.col("band").alias("to"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("lab").alias("lab"), b.alias("at")))).alias("o"))
    lists = cut(listed.groupBy("home", "to").agg(F.collect_list("o").alias("others")))  # one entry for a block
    facing = placed.select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("to"))
    met = facing.join(F.broadcast(lists) if lists.count() <= HOT_LISTS else lists, ["home", "to"]).select("*", F.explode("others").alias("o"))
    met = met.filter(~F.coalesce(F.col("lab") == F.col("o.lab"), F.lit(False)))
    mine, other = F.struct("band", "lab", "at"), F.struct(F.col("to").alias("band"), F.col("o.lab").alias("lab"), F.col("o.at").alias("at"))
    i, j = F.xxhash64(F.least(mine, other)), F.xxhash64(F.greatest(mine, other))
    return small.unionByName(met.select("home", i.alias("i"), j.alias("j"), F.xxhash64(mine).alias("block"), "doc", "label"))


def _dealt_small(members: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return members.select("home", zero.alias("i"), zero.alias("j"), zero.alias("block"), "doc", "label")


def _search_groups(members: DataFrame, texts: DataFrame, rule: Rule, width: int) -> DataFrame:
    """(home, a, b) from members (home, doc, label, n) of groups that hold several components."""
    sets = _texts_of(texts, cut(members.select("doc").distinct())).mapInPandas(_hashed_sets(rule, width), "doc long, grams binary")
    groups = _dealt(members, rule).join(sets, "doc").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", "doc")
    return cut(groups.select("home", "i", "j", "doc", "label", "block", "grams").mapInPandas(_group_links(rule, width), "home long, a long, b long"))


def _name(digest: Column) -> Column:
    return F.xxhash64(digest)


def _renamed(digests: DataFrame) -> dict[str, int]:
    """Other names for the digests whose name another one has: of n texts about n * n / 2 ** 65, none as a rule."""
    renamed: dict[str, int] = {}
    while True:
        named = digests.select("digest", _node(F.col("digest"), renamed).alias("node"))
        shared = named.groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").collect()
        if not shared:
            return renamed
        for r in shared:
            renamed[r.high] = int.from_bytes(md5(f"{len(renamed)} {r.high}".encode()).digest()[:8], "little", signed=True)


def _node(digest: Column, renamed: dict[str, int]) -> Column:
    if not renamed:
        return _name(digest)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in renamed.items() for x in item]), digest), _name(digest))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


@tidied
def ngram_classes(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two checkpointed tables: doc_id, digest of every row; and for every text digest, first_doc (its smallest id),
    n_shingles, component (a number for each group of linked texts) and component_id (the component's smallest id)."""
    rule = Rule(n, num, den)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    digests = cut(named.select("doc_id", "digest", F.octet_length("text").alias("bytes")))
    renamed = _renamed(digests)
    node = _node(F.col("digest"), renamed)
    classes = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("first_doc")).withColumn("node", node))
    texts = named.select(node.alias("doc"), "text")

    # about one word for five bytes, and one key for each element that may differ
    volume = digests.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(volume / 5 * 1.7 * 2 * (den - num) / (den + num) / KEYS_PER_TASK))
    spread = texts.mapInPandas(_spread_out(rule), TILE).repartition(tasks, "key")
    tiles = cut(spread.mapInPandas(_gather_tiles, TILE))
    sets = cut(tiles.filter(F.col("kind") == SET).groupBy("doc").agg(F.max("n").alias("n")))
    stars = tiles.filter(F.col("kind") == PAIR).select("key", F.col("leader").alias("a"), F.col("doc").alias("b")).filter("a <> b")

    shared = stars.groupBy("a", "b").agg(F.count("*").alias("k"))
    best = cut(shared.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b"))
    tried = exact_links(best, texts, rule)
    links = tried.filter("linked").select("a", "b")
    labels = connected_components(links)

    # tiles that still hold several components, those with the same smallest member together
    seen = _labelled(_labelled(stars, labels, "a", "at"), labels, "b", "label")
    open_keys = seen.filter("at <> label").select("key").distinct()
    inside = stars.join(open_keys, "key", "left_semi")
    members = cut(inside.select("key", F.col("b").alias("doc")).union(inside.select("key", F.col("a").alias("doc"))).distinct())
    homes = members.groupBy("key").agg(F.min("doc").alias("home"))
    groups = members.join(homes, "key").select("home", "doc").distinct()
    full = cut(_labelled(groups, labels, "doc", "label").join(sets, "doc"))
    found = _search_groups(full, texts, rule, 32)
    checked = exact_links(cut(found.select("a", "b").distinct()), texts, rule)
    more = checked.filter("linked").select("a", "b")
    # an overlap that only narrow hashes made large enough: search that group again with whole ones
    wrong = cut(found.join(checked.filter("NOT linked").select("a", "b"), ["a", "b"]).select("home").distinct())
    if not wrong.isEmpty():
        again = _search_groups(cut(full.join(wrong, "home", "left_semi")), texts, rule, 64)
        more = more.union(again.select("a", "b"))
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    linked = cut(labels.join(classes, "node").select("node", "label", "first_doc"))
    smallest = linked.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    joined = join_hot(linked, smallest, "label", hot_keys(linked, "label")).select("node", F.col("label").alias("component"), "component_id", F.lit(True).alias("linked"))
    known = classes.join(sets.select(F.col("doc").alias("node"), "n"), "node", "left").join(joined, "node", "left")
    told = known.select(
        "digest",
        "first_doc",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component", "node").alias("component"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_doc")).alias("component_id"),
    )
    return digests.select("doc_id", "digest"), cut(told)


def ngram_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest id that links reach, itself included."""
    rows, classes = ngram_classes(docs, n, num, den, id_col, text_col)
    told = join_hot(rows, classes, "digest", hot_keys(rows, "digest"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", "n_shingles", own.alias("component_id"))
