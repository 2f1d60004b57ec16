import numpy as np
import pytest

from docweave.llm import mil_quality as mq
from docweave.llm.queries import op11_quality_classifier


def test_gradients_agree_with_differences():
    words = mq.Words()
    rng = np.random.default_rng(1)
    numbers = [words.numbers(t) for t in ("a b c " * 40 + "D! e# f,", "", "one Two 3 | four.", "x " * 200)]
    x, y = mq.passages(words, numbers), np.array([1.0, 0.0, 1.0, 0.0])
    model = mq.Model(0.4, seed=3)

    def loss():
        p = model.forward(x, 4)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model.gradients(x, y).items():
        flat = model.p[name].reshape(-1)
        places = np.flatnonzero(g.reshape(-1)) if name == "E" else np.arange(flat.size)
        for at in rng.choice(places, min(8, len(places)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g.reshape(-1)[at], abs=1e-7, rel=1e-3), name


def test_passages_cover_every_word():
    words = mq.Words()
    x = mq.passages(words, [words.numbers("w " * 130), words.numbers(None), words.numbers("a a b")])
    assert np.diff(x.start).tolist() == [64, 64, 2, 0, 3] and x.text.tolist() == [0, 0, 0, 1, 2]
    assert x.shares[0, 9] == pytest.approx(63 / 64) and x.shares[4, 11] == pytest.approx(1 / 3)


def test_slices_give_the_words_of_the_whole_text(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + " " + "z" * 60
    words = mq.Words()
    whole = words.numbers(text)
    monkeypatch.setattr(mq, "SLICE", 64)
    assert words.numbers(text).tolist() == whole.tolist()


def noisy(i):
    return " ".join(f"w{i}{j}###" if j % 2 else f"W{j}!!" for j in range(60))


def plain(i):
    return " ".join(f"word{(i * j) % 97}" for j in range(60)) + "."


def test_one_bad_passage_among_good_ones_is_seen(spark):
    rows = []
    for i in range(300):
        good = [plain(i * 7 + k) for k in range(5)]
        rows.append((" ".join(good), 1))
        good[i % 5] = noisy(i)
        rows.append((" ".join(good), 0))
    labelled = spark.createDataFrame(rows, "text string, quality int")
    model = mq.fit(labelled)
    got = mq.score(labelled, model).collect()
    assert np.mean([(r["_quality"] >= 0.5) == r.quality for r in got]) > 0.97
    # the gate looks at the bad passage
    words = mq.Words()
    text = " ".join([plain(1), plain(2), noisy(3) + " x" * 4, plain(4)])
    t = model.forward(mq.passages(words, [words.numbers(text)]), 1)
    assert t["score"][0] < 0.5


def test_defined_results(spark):
    schema = "doc_id long, text string, quality int, _quality string"
    docs = spark.createDataFrame([(1, None, 1, "a"), (2, "", 0, "b"), (3, " \n ", None, "c"), (4, "x y", 1, "d"), (4, "x y", 1, "d"), (5, "long " * 300_000, 1, "e")], schema)
    unlearned = mq.fit(docs.limit(0))
    out = mq.score(docs, unlearned)
    assert out.columns[-1] == "__quality" and {r["__quality"] for r in out.collect()} == {0.5}
    model = mq.fit(docs.filter("quality = 1"))
    scores = {(r.doc_id, r["__quality"]) for r in mq.score(docs, model).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 and s > 0.5 for _, s in scores)
    assert mq.score(docs.limit(0), model).collect() == []


def test_equal_models_for_any_row_order(spark):
    rows = [(noisy(i) if i % 2 else plain(i), i % 2) for i in range(80)]
    a = mq.fit(spark.createDataFrame(rows, "text string, quality int").repartition(7))
    b = mq.fit(spark.createDataFrame(rows[::-1], "text string, quality int").repartition(2))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_held_out_accuracy(spark):
    got = op11_quality_classifier(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = got.filter("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert {r.predicted == int(r.score >= 0.3) for r in held} == {True}
