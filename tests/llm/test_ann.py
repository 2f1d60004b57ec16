import numpy as np
from pyspark.sql import functions as F

from docweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, q long, id long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vectors], SCHEMA)


def exact(vectors, query, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    return sorted(((-float(ok[query] @ x), i) for i, x in ok.items() if i != query))[:k]


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 512 * 8 * 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    data = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    data += [(2000 + i, data[0][1]) for i in range(60)]  # equal vectors
    data += [(3000, None), (3001, [0.0] * 16), (3002, [None] + [1.0] * 15), (3003, [float("nan")] + [1.0] * 15), (3020, [float("inf")] + [1.0] * 15)]
    found = {}
    for r in ann.nearest(frame(spark, data), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i, _ in data if i % 20 == 0 and i < 3000}
    hits = 0
    for q, got in found.items():
        got.sort()
        best = exact(data, q, 20)
        assert [r for r, *_ in got] == list(range(1, 21)) and q not in {i for _, i, _ in got}
        assert got == sorted(got, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i, _ in got} & {i for _, i in best})
        scores = {i: -s for s, i in exact(data, q, len(data))}
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in got)
    assert hits >= 0.9 * 20 * len(found)


def test_few_vectors_are_all_returned(spark):
    data = [(20 * i, [float(i + 1), 1.0]) for i in range(4)]
    rows = ann.nearest(frame(spark, data), F.col("vec_id") % 20 == 0).collect()
    assert len(rows) == 12
    assert ann.nearest(frame(spark, []), F.lit(True)).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0, 2.0])]), F.lit(True)).count() == 0


def test_repeated_ids_and_short_vectors(spark):
    """Rows that share an id, or repeat as a whole, are rows of their own; shorter vectors count as filled up with zeros."""
    rng = np.random.default_rng(4)
    data = [(int(i), rng.standard_normal(d).round(2).tolist()) for i, d in zip(rng.integers(0, 60, 120), rng.choice([3, 4], 120), strict=True)]
    data += [data[0], data[1]] + [(20, [1.0, 0.0, 0.0, 0.0]), (20, [1.0]), (21, [1.0, 0.0]), (22, [2.0])]
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame(spark, data), F.col("vec_id") % 20 == 0).collect()]
    rows = [(i, np.array([*v, *[0.0] * (4 - len(v))], np.float32).astype(float)) for i, v in data]
    expected = []
    for a, (q, x) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float(np.dot(x, y)), i) for b, (i, y) in enumerate(rows) if a != b)[:20]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert len(found) == len(expected)
    for a, b in zip(sorted(found), sorted(expected), strict=True):
        assert a[:2] == b[:2] and abs(a[3] - b[3]) < 1e-9
