import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, node string, sizes int"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(4)


def found(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in pt.prefix_trie(df).collect()), key=repr)


def brute(lists):
    """Node tuples of {conversation: turns}, by loops."""
    members, ends, sizes = defaultdict(list), defaultdict(list), {(): 0}
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                sizes[turns[:d]] = len(turns[d - 1][1].encode())
        ends[turns].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in children[k]) if children[k] else 1
        saved[k] = (len(members[k]) - 1) * sizes[k] + sum(saved[c] for c in children[k])
    out = []
    for k, who in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), len(children[k]), leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def turns_of(rows):
    lists = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            lists[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: tuple(x[1:] for x in sorted(v)) for c, v in lists.items()}


@pytest.mark.parametrize("part_bytes", [400, 4 << 20])
def test_equals_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(pt, "PART_BYTES", part_bytes)
    monkeypatch.setattr(pt, "LEAST_PARTS", 3)
    monkeypatch.setattr(pt, "PIECE", 100)
    rnd = random.Random(part_bytes)
    rows = []
    for c in range(400):
        for turn in range(rnd.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]) if turn else "user", rnd.choice(["", "a", "bb", "ä", None])))
    for c in range(400, 700):  # a conversation that many share, as many others go on from it
        rows += [(c, 0, "user", "hot"), (c, 1, "assistant", "same")] + ([(c, 2, "user", str(c % 7))] if c % 3 == 0 else [])
    rows += [(800, t, "user", f"long {t}") for t in range(300)] + [(801, t, "user", f"long {t}") for t in range(150)]
    rows += [(900, None, "user", "null first"), (900, 0, "user", "then"), (None, 0, "user", "nobody"), (901, 5, None, None)]
    assert found(pt.turn_lists(frame(spark, rows))) == brute(turns_of(rows))


def test_wide_nodes_and_negative_ids(spark):
    rows = [(c - 500, 0, "user", f"first {c}") for c in range(1000)] + [(c - 500, 1, "user", "x" * (c % 5)) for c in range(0, 1000, 2)]
    assert found(pt.turn_lists(frame(spark, rows))) == brute(turns_of(rows))


def test_only_equal_conversations_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(pt, "LEAST_PARTS", 5)
    rows = [(c, t, "user", "same") for c in range(60) for t in range(3)]
    assert found(pt.turn_lists(frame(spark, rows))) == brute(turns_of(rows))
    assert found(pt.turn_lists(frame(spark, []))) == []
    assert pt.prefix_trie(pt.turn_lists(frame(spark, []))).columns == list(FIELDS)


def test_spliced_conversations_and_turnless_ones(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(23) for t in range(c % 4 + 1) if c not in (5, 10)]
    lists = turns_of(rows)
    want = {}
    for c, turns in lists.items():
        head = c % 6
        want[c] = lists.get(c - c % 5, ())[:head] + turns[head:]
    assert any(not t for t in want.values())  # conversations without a turn end at the root
    got = pt.spliced(pt.turn_lists(frame(spark, rows)), F.col("conv_id") - F.col("conv_id") % 5, F.col("conv_id") % 6, most=8)
    assert found(got) == brute(want)


def test_layouts_grow_and_keep_their_order():
    tree, seen = pt.Tree(), []
    for b in random.Random(1).sample(range(256), 256):
        tree.insert(bytes([7, b]) * 8, np.array([1]), b)
        seen.append(b)
        top = tree.root
        while top.children is not None and len(list(top.items())) == 1:
            top = next(top.items())[1]
        if len(seen) > 1:
            layout = type(top.children).__name__, getattr(top.children, "room", None)
            n = len(seen)
            assert layout == (("Sorted", 4) if n <= 4 else ("Sorted", 16) if n <= 16 else ("Indexed", None) if n <= 48 else ("Direct", None))
            assert [k for k, _ in top.items()] == sorted(seen)
            assert top.path == bytes([7])  # one edge for the shared byte
