"""Operator 12: the prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

A turn's id is the 16-byte digest of its role and text, a conversation's key is its turns' ids one after the other in
big-endian order. Keys are dealt by range into parts of about ``PART_BYTES``, equal keys by conversation id, so that
a very common conversation or first turn fills many parts. A task builds one adaptive radix tree over its part: nodes
grow from 4 to 16, 48 and 256 children, and a path without branches is one edge; only byte depths at a turn's end
give nodes. A node whose members all lie in one part is complete there. The few that go on in a neighbouring part lie
on the part's first or last key; their sums are added up afterwards. So that nothing counts twice, each part is told
three facts about its neighbours: how many turns its first key shares with the key before it, how many its last key
shares with the key after it, and whether a later key goes on from its last key.

The ids of the conversations that end at a node are hashed as a stream in the order of the parts, in pieces of at most
``PIECE`` characters.

Defined results: rows without conversation id take no part; null roles and texts are empty; turns come by number, null
first, and turns of one number by their digests; a conversation without turns ends at the root; an empty table gives an
empty result; other columns are ignored. A task holds the turn ids (20 bytes a turn) of one conversation as one row,
never its texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import cut, hot_keys, join_hot

TURN = 16  # bytes of a turn's id
PART_BYTES, LEAST_PARTS = 4 << 20, 16
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Sorted:
    """Up to 4 or 16 children: their branch bytes in order, and the children beside them."""

    __slots__ = ("branches", "nodes", "room")

    def __init__(self, room: int):
        self.room, self.branches, self.nodes = room, bytearray(), []

    def get(self, branch: int):
        at = self.branches.find(branch)
        return None if at < 0 else self.nodes[at]

    def put(self, branch: int, node: Node) -> None:
        at = bisect_left(self.branches, branch)
        if at < len(self.branches) and self.branches[at] == branch:
            self.nodes[at] = node
        else:
            self.branches.insert(at, branch)
            self.nodes.insert(at, node)

    def full(self) -> bool:
        return len(self.nodes) == self.room

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.branches, self.nodes, strict=True)


class Indexed:
    """Up to 48 children: for each branch byte the number of its child."""

    __slots__ = ("nodes", "slots")

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, branch: int):
        slot = self.slots[branch]
        return self.nodes[slot - 1] if slot else None

    def put(self, branch: int, node: Node) -> None:
        if slot := self.slots[branch]:
            self.nodes[slot - 1] = node
        else:
            self.nodes.append(node)
            self.slots[branch] = len(self.nodes)

    def full(self) -> bool:
        return len(self.nodes) == 48

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class Direct:
    """A place for every branch byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, branch: int):
        return self.nodes[branch]

    def put(self, branch: int, node: Node) -> None:
        self.nodes[branch] = node

    def full(self) -> bool:
        return False

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """A branching point or an end: the bytes from the node above to here, children, who ends here, and sums of what lies below."""

    __slots__ = ("above", "children", "ends", "holder", "leaves", "low", "n", "on_first", "on_last", "path", "saved", "sizes", "tops")

    def __init__(self, path: bytes, sizes: np.ndarray):
        self.path, self.sizes = path, sizes  # text sizes of the turns of some key through here
        self.children, self.ends = None, []
        self.on_first = self.on_last = False

    def child(self, branch: int) -> Node | None:
        return self.children.get(branch) if self.children is not None else None

    def put(self, branch: int, node: Node) -> None:
        if self.children is None:
            self.children = Sorted(4)
        elif self.children.full() and self.children.get(branch) is None:
            layout = self.children
            self.children = Sorted(16) if isinstance(layout, Sorted) and layout.room == 4 else Indexed() if isinstance(layout, Sorted) else Direct()
            for b, n in layout.items():
                self.children.put(b, n)
        self.children.put(branch, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return iter(()) if self.children is None else self.children.items()


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Tree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, sizes: np.ndarray, conv_id: int) -> None:
        if self.root is None:
            self.root = Node(b"", sizes)
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:], sizes)
                node.put(key[at], leaf)
                node, at = leaf, len(key)
                break
            same = shared_bytes(below.path, key[at : at + len(below.path)])
            if same < len(below.path):
                above = Node(below.path[:same], below.sizes)
                below.path = below.path[same:]
                above.put(below.path[0], below)
                node.put(key[at], above)
                below = above
            node, at = below, at + same
        node.ends.append(conv_id)

    def mark(self, key: bytes, name: str) -> None:
        """Set the flag ``name`` of all nodes that lie on ``key``."""
        node, at = self.root, 0
        while node is not None:
            setattr(node, name, True)
            at += len(node.path)
            node = node.child(key[at]) if at < len(key) else None

    def nodes(self) -> list[Node]:
        """All nodes, parents before children. Sets how deep the edge of each begins (``above``) and ``holder``, the node
        whose edge has the last turn's end before that."""
        root, order = self.root, []
        root.above, root.holder = 0, None
        stack = [root]
        while stack:
            node = stack.pop()
            order.append(node)
            bottom = node.above + len(node.path)
            holder = node if node is root or bottom // TURN > node.above // TURN else node.holder
            for _, below in node.items():
                below.above, below.holder = bottom, holder
                stack.append(below)
        return order


@dataclass(frozen=True)
class Facts:
    """A part's neighbours: turns that its first key shares with the key before it, and its last key with the key after it
    (-1: there is none), and whether a later key goes on from its last key."""

    before: int = -1
    after: int = -1
    goes_on: bool = False


CLOSED, OPEN, ENDS = 0, 1, 2
PARTIAL = "kind int, node string, parent string, part int, piece int, depth long, low long, parent_low long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def names(key: bytes, depth: int) -> list[str]:
    """Digests of the first 0 to ``depth`` turns of a key."""
    digest = hashlib.sha256()
    out = [digest.hexdigest()]
    for d in range(depth):
        digest.update(key[d * TURN : (d + 1) * TURN])
        out.append(digest.hexdigest())
    return out


def pieces(ids: list[int]) -> Iterator[str]:
    """The ids joined by commas, at most about ``PIECE`` characters at a time."""
    for at in range(0, len(ids), PIECE // 20):
        yield ",".join(map(str, ids[at : at + PIECE // 20]))


def emitted(tree: Tree, part: int, facts: Facts, first: bytes, last: bytes) -> Iterator[tuple]:
    """Rows of ``PARTIAL``. A node of at most ``before`` turns of the first key has begun in an earlier part: it, or its
    being a child or a leaf, isn't counted again. Such a node and one of at most ``after`` turns of the last key is open."""
    tree.mark(first, "on_first")
    tree.mark(last, "on_last")
    first_names, last_names = names(first, facts.before), names(last, facts.after)

    def name(node: Node, depth: int) -> str | None:
        if node.on_first and depth <= facts.before:
            return first_names[depth]
        return last_names[depth] if node.on_last and depth <= facts.after else None

    order = tree.nodes()
    for node in reversed(order):
        below = [n for _, n in node.items()]
        node.n, node.leaves, node.saved = len(node.ends) + sum(n.n for n in below), sum(n.leaves for n in below), sum(n.saved for n in below)
        node.low = min([*node.ends[:1], *(n.low for n in below)])
        children = sum(n.tops for n in below)
        bottom = node.above + len(node.path)
        shallowest = node.above // TURN + 1 if node.holder else 0
        for depth in range(bottom // TURN, shallowest - 1, -1):
            begun = not (node.on_first and depth <= facts.before)
            goes_on = facts.goes_on and node.on_last and depth * TURN == len(last)
            size = int(node.sizes[depth - 1]) if depth else 0
            node.leaves += begun and not children and not goes_on
            node.saved += (node.n - begun) * size
            own, ends = name(node, depth), node.ends if depth * TURN == bottom else []
            upper = node if depth > shallowest else node.holder
            parent = name(upper, depth - 1) if upper and depth else None
            row = (own, parent, part, 0, depth, node.low, (upper, parent is None and depth > 0), node.n, children, node.leaves, node.saved)
            if own is None:
                yield (CLOSED, *row, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NO_ENDS)
            else:
                yield (OPEN, *row, None)
                for i, text in enumerate(pieces(ends)):
                    yield (ENDS, own, None, part, i, depth, None, None, None, None, None, None, text)
            children = int(begun)
        node.tops = children


def _trees(facts: dict[int, Facts]):
    """One tree over each part; its rows come in the order of key and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, first, last = Tree(), None, b""
        for batch in batches:
            for last, sizes, conv_id in zip(batch["key"], batch["sizes"], batch["conv_id"].tolist(), strict=True):
                first = last if first is None else first
                tree.insert(last, sizes, conv_id)
        if first is None:
            return
        part, columns = TaskContext.get().partitionId(), [c.split()[0] for c in PARTIAL.split(", ")]
        held = [list(row) for row in emitted(tree, part, facts[part], first, last)]
        for row in held:  # all nodes know their smallest members now
            if row[7] is not None:
                upper, wanted = row[7]
                row[7] = upper.low if wanted else None
        for at in range(0, len(held), 10_000):
            yield pd.DataFrame(held[at : at + 10_000], columns=columns).astype({c: "Int64" for c in columns[5:12]})

    return run


def _bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A part's first key, the first other one, and its last key."""
    first = other = last = None
    for batch in batches:
        for key in batch["key"]:
            first = key if first is None else first
            other = key if other is None and key != first else other
        last = batch["key"].iloc[-1] if len(batch) else last
    if first is not None:
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "other": [other], "last": [last]})


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of all parts' bounds in their order, what each part has to know of its neighbours."""
    rows, waiting, last = [], [], None  # waiting: parts that no other key has followed so far; all end on the same key
    for batch in batches:
        for b in batch.itertuples(index=False):
            before = -1 if last is None else shared_bytes(last, b.first) // TURN
            if rows:
                rows[-1][2] = before
            following = b.first if b.first != last else b.other
            if waiting and following is not None:
                for row in waiting:
                    row[3] = following.startswith(last)
                waiting = []
            rows.append([b.part, before, -1, False])
            waiting.append(rows[-1])
            last = b.last
    yield pd.DataFrame(rows, columns=["part", "before", "after", "goes_on"])


def _hashed_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each node, which come in their order."""
    node, digest = None, None
    for batch in batches:
        done = []
        for name, text in zip(batch["node"], batch["ends"], strict=True):
            if name != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
                digest.update(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=["node", "ends"])
    if node is not None:
        yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends"])


def turn_lists(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: each conversation's turns in their order, as digest and text size."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("id"), F.octet_length(text).alias("size")).alias("t"))
    listed = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


def spliced(lists: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation's first ``head`` turns (``most`` at most) replaced by as many of the conversation ``base``."""
    named = lists.select("conv_id", "turns", base.alias("base"), head.cast("int").alias("head"))
    heads = named.filter(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, most).alias("first"))
    nothing = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("head") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("head")))
    return named.join(heads, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("first", nothing), F.lit(1), F.col("head")), own).alias("turns"))


def prefix_trie(lists: DataFrame) -> DataFrame:
    """The trie of conversations given as ``turn_lists`` gives them: a row for each distinct beginning, the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (text bytes that the
    members below share), ends_sha256."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    keyed = cut(lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    size = keyed.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    parts = max(LEAST_PARTS, ceil(size / PART_BYTES))
    dealt = cut(keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"))
    bounds = dealt.select("key").mapInPandas(_bounds, "part int, first binary, other binary, last binary")
    told = bounds.repartition(1).sortWithinPartitions("part").mapInPandas(_facts, "part int, before int, after int, goes_on boolean")
    facts = {r.part: Facts(r.before, r.after, r.goes_on) for r in told.collect()}  # three numbers for each part
    rows = cut(dealt.mapInPandas(_trees(facts), PARTIAL))

    ends = rows.filter(F.col("kind") == ENDS).repartition("node").sortWithinPartitions("node", "part", "piece").mapInPandas(_hashed_ends, "node string, ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = rows.filter(F.col("kind") == OPEN).groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("low").alias("low"), *sums)
    merged = cut(merged.join(ends, "node", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))))
    upper = merged.select(F.col("node").alias("parent"), F.col("low").alias("upper_low"))

    fields = ["parent", "depth", "low", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    closed = rows.filter(F.col("kind") == CLOSED)
    below_open = cut(closed.filter("parent IS NOT NULL").select(*fields).unionByName(merged.filter("parent IS NOT NULL").select(*fields)))
    named = join_hot(below_open, upper, "parent", hot_keys(below_open, "parent"))
    others = closed.filter("parent IS NULL").select(*fields, F.col("parent_low").alias("upper_low"))
    root = merged.filter("parent IS NULL").select(*fields, F.lit(None).cast("long").alias("upper_low"))
    return named.unionByName(others).unionByName(root).select(
        F.col("low").alias("conv_id"), "depth", F.col("upper_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
