import random

from docweave.llm import toxicity as tox

SCHEMA = "doc_id long, text string, spam int, toxic int, ids int"


def corpus(n):
    rnd = random.Random(5)
    words, bad = [f"word{i}" for i in range(300)], ["vileword", "nastyterm", "gruffness"]
    rows = []
    for i in range(n):
        toxic, spam = rnd.random() < 0.15, rnd.random() < 0.15
        text = [rnd.choice(words) + ("%%%" if spam else "") for _ in range(rnd.randint(20, 80))]
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(bad) + rnd.choice(["", "en", "s"])
        rows.append((i, " ".join(text), int(spam), int(toxic), 1))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1600)
    docs = spark.createDataFrame([*rows, (9000, None, 0, 0, 0), (9001, "", 0, 0, 0), (9002, "x", None, None, 0)], SCHEMA)
    chain = tox.fit(docs.filter("doc_id % 4 <> 0"), ["spam", "toxic"])
    found = {r.doc_id: r for r in tox.predict(docs, chain).select("doc_id", "_toxicity.*").collect()}
    assert len(found) == len(rows) + 3 and len(chain.models[1].earlier) == 1
    for k in ("spam", "toxic"):
        held = [(r[2 if k == "spam" else 3] == 1, found[r[0]][f"is_{k}"]) for r in rows if r[0] % 4 == 0]
        hits = sum(t and p for t, p in held)
        assert hits >= 0.95 * sum(t for t, _ in held) and hits >= 0.95 * sum(p for _, p in held)
    assert not found[9000].is_toxic and 0 <= found[9001].p_toxic <= 1


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(i, "a b c", 0, 0, 0) for i in range(10)], SCHEMA)
    chain = tox.fit(one, ["toxic"])
    assert not any(r._toxicity.is_toxic for r in tox.predict(one, chain).collect())
    empty = tox.fit(one.limit(0), ["toxic"])
    assert {(r._toxicity.p_toxic, r._toxicity.is_toxic) for r in tox.predict(one, empty).collect()} == {(0.0, False)}


def test_predictions_equal_loops(spark):
    """The chain by plain loops: each category's sum over the text's features and the earlier probabilities."""
    import math

    rows = [*corpus(300), *corpus(5), (9000, None, 0, 0, 0), (9003, "vileword " * 30_000, 0, 1, 0)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA + ", _toxicity string")
    chain = tox.fit(docs, ["spam", "toxic"])
    predicted = tox.predict(docs, chain)
    assert predicted.columns == [*docs.columns, "__toxicity"]
    for r in predicted.collect():
        text, earlier = r.text or "", []
        features = set(tox.shape_features(text, len(text.split()), len(set(text.split()))))
        for word in set(text.split()):
            core = word.lower().strip(tox.STRIP)
            for name in {core, *(core[:n] + "~" for n in tox.BEGINNINGS if len(core) >= n)} if core else ():
                features.add(tox.xxhash.xxh64_intdigest(name, 2) >> (64 - tox.DIM_BITS))
        for name, m, threshold in zip(chain.categories, chain.models, chain.thresholds, strict=True):
            logit = sum(float(m.weights[f]) for f in features) + sum(w * p for w, p in zip(m.earlier, earlier, strict=True)) + m.bias
            p = 1 / (1 + math.exp(-max(-30, min(30, logit))))
            got = r["__toxicity"]
            assert abs(got[f"p_{name}"] - p) < 1e-4 and got[f"is_{name}"] == (got[f"p_{name}"] >= threshold) and r["_toxicity"] == "mine"
            earlier.append(got[f"p_{name}"])


def test_threshold_is_the_best_of_all():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(50):
        y = np.array([float(rnd.random() < 0.4) for _ in range(30)])
        p = np.array([rnd.random() for _ in y])
        f1 = lambda t: 2 * (y * (p >= t)).sum() / max(1, (p >= t).sum() + y.sum())
        if 0 < y.sum() < len(y):
            assert abs(f1(tox.best_threshold(p, y)) - max(f1(t) for t in p)) < 1e-12
