import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row long, part int, anchor long"
FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], SCHEMA).repartition(5)


def mined(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in hn.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect())


def brute(rows, dim):
    ok = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (dim - len(v))
        ok.append((i, label, whole))
    out = []
    for a, (i, label, x) in enumerate(ok):
        if i % 10:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for b, (j, other, y) in enumerate(ok) if a != b]
        for minus, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            near = sorted(s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus)[:3]
            out += [(i, j, n + 1, k, -minus, -score) for n, (score, k, _) in enumerate(near)]
    return sorted(out)


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return [(i, (centres[i % 8] + 0.5 * rng.standard_normal(dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_equals_brute_force_with_ties_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 16)  # several trees
    rows = clustered(1, 600, 12)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(120)]  # equal vectors, many ties
    rows += [rows[10], rows[10], (10, rows[11][1], 2)]  # repeated rows, and an id that is not unique
    rows += [(None, rows[1][1], 1), (2000, None, 1), (2010, rows[1][1], None), (2020, [None] + [1.0] * 11, 1), (2030, [float("nan")] * 12, 1), (2040, [float("inf")] * 12, 1)]
    rows += [(2050, [], 1), (2060, [0.0] * 12, 2), (2070, rows[2][1][:5], 3), (2080, [0.001] * 12, 0)]
    assert mined(frame(spark, rows)) == brute(rows, 12)


def test_empty_tables_and_tables_without_anchors(spark):
    none = frame(spark, [])
    assert hn.hard_negatives(none, F.col("vec_id") % 10 == 0, F.col("label")).columns == list(FIELDS)
    assert mined(none) == []
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert mined(frame(spark, [(10, [1.0], 1)])) == []
    assert mined(frame(spark, [(10, [1.0], 1), (2, [1.0], 1)])) == []  # nothing of another label


def test_large_components_stay_exact_and_too_large_ones_are_an_error(spark):
    rows = [(i, [float(2**17 + i), float(i * 7 % 13)], i % 2) for i in range(40)]
    assert mined(frame(spark, rows)) == brute(rows, 2)  # products beyond 2^53
    with pytest.raises(ValueError, match="64-bit"):
        mined(frame(spark, [(10, [1e30], 1), (2, [1.0], 1)]))


def test_tree_spans_and_is_shortest():
    x = np.random.default_rng(2).standard_normal((60, 3))
    parent, edge = hn.shortest_tree(x)
    order = hn.walk(parent)
    place = {a: i for i, a in enumerate(order)}
    assert sorted(order) == list(range(60)) and all(parent[a] < 0 or place[parent[a]] < place[a] for a in order)
    # Kruskal's tree has the same length
    pairs = sorted((float(np.linalg.norm(x[a] - x[b])), a, b) for a in range(60) for b in range(a))
    root = list(range(60))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    total = 0.0
    for d, a, b in pairs:
        if top(a) != top(b):
            root[top(a)] = top(b)
            total += d
    assert np.isclose(total, edge.sum())


def test_bounds_spare_rescoring_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = 4000 * rng.standard_normal((20, 16))
    points = np.floor(centres[rng.integers(0, 20, 4000)] + 40 * rng.standard_normal((4000, 16)))
    import pandas as pd

    def rows(x, first):
        return pd.DataFrame({"row": np.arange(first, first + len(x)), "id": np.arange(first, first + len(x)), "label": np.arange(len(x)) % 2, "vector": [v.astype(np.int64).tobytes() for v in x]})

    part = hn.Part(rows(points, 0), 16, False)
    block = hn._treed(16)(rows(points[:200], 10_000).assign(block=0))
    hits = 0
    for place, which, scores in part.walk(block, 16, False, lambda place, low, high: np.flatnonzero(high >= hn.kth_largest(low, 5))):
        anchor = np.frombuffer(block["vector"].iloc[place], np.int64)
        exact = part.x @ anchor
        best = part.best(which, scores, 5)
        assert sorted(scores[best].tolist()) == sorted(np.sort(exact)[-5:].astype(np.int64).tolist())
        hits += 1
    assert hits == 200 and part.rescored < 0.25 * 200 * 4000
