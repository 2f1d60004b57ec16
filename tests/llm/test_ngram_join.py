import random
from itertools import combinations

import pytest

from docweave.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, key string, label int, n int"


def brute(rows, n, num, den):
    def grams(text):
        w = [x for x in (text or "").encode().translate(nj.LOWER).split()]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n_docs):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, base = [], []
    for i in range(n_docs):
        if base and rnd.random() < 0.7:
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                w = w[: -rnd.randint(1, 5)]
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 9, 20, 60, 150]))]
        base.append(w)
        rows.append((i * 3, " ".join(w).upper() if rnd.random() < 0.2 else "\n ".join(w)))
    return rows + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, ""), (10_004, "word " * 3000), (10_005, "word " * 3001)]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10), (2, 6, 10)])
def test_components_equal_brute_force(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    rows = corpus(n, 260)
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(docs, n, num, den).collect()}
    assert found == brute(rows, n, num, den)


def test_blocks_are_bounded_by_their_grams(spark, monkeypatch):
    """A group of few but long texts is dealt into several blocks too."""
    monkeypatch.setattr(nj, "BLOCK_GRAMS", 500)
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rnd.choice([0, 3, 8, 20])):
            words[rnd.randrange(300)] = f"x{rnd.randrange(5000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t) for i, t in corpus(5, 40)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(docs, 3, 90, 100).collect()} == brute(rows, 3, 90, 100)


def test_empty_nulls_and_repeated_rows(spark):
    assert nj.ngram_components(spark.createDataFrame([], SCHEMA), 3, 90, 100).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", "", 0, 0), (1, "a b c d", "", 0, 0), (None, "a b c d", "", 0, 0), (2, "A b c d", "", 0, 0)], SCHEMA)
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in nj.ngram_components(docs, 3, 90, 100).collect())
    assert found == [(-1, 1), (1, 1), (1, 1), (2, 1)]


def brute_rows(rows, n, num, den):
    """(doc_id, n_shingles, component_id) of every row, ids repeating or not."""
    by_row = brute(list(enumerate(t for _, t in rows)), n, num, den)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[by_row[k][1]] = min(least.get(by_row[k][1], i), i)
    return sorted((i, by_row[k][0], least[by_row[k][1]]) for k, (i, _) in enumerate(rows))


def test_repeated_ids_with_other_texts(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    rows = [(1, "a b c d"), (1, "x y z w v"), (2, "x y z w v"), (3, "a b c d")]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(docs, 3, 90, 100).collect()) == [(1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 2, 1)]
    rnd = random.Random(8)
    rows = [(i if rnd.random() < 0.8 else rnd.randrange(200) * 3, t) for i, t in corpus(9, 200)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(docs, 3, 90, 100).collect())
    assert found == brute_rows(rows, 3, 90, 100)


def test_texts_whose_names_collide_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(nj, "_name", lambda digest: F.pmod(F.xxhash64(digest), F.lit(3)))
    rows = corpus(4, 30)
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(docs, 3, 90, 100).collect()} == brute(rows, 3, 90, 100)
