import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, unit string, c int, chunk int"


def corpus(n):
    """Texts in which one of a few words follows each word."""
    rnd = random.Random(1)
    stems = ["lor", "mag", "dun", "kel", "vor", "é"]
    words = ["".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3))) for _ in range(80)]

    def text():
        at, out = rnd.randrange(80), []
        for _ in range(rnd.randint(0, 80)):
            at = (at * 7 + rnd.choice([0, 0, 0, 1, 2, 40])) % 80
            out.append(words[at])
        return rnd.choice([" ", "\n", "  "]).join(out)

    return [(i, text()) for i in range(n)]


def test_base_columns_and_model(spark):
    rows = [*corpus(400), (900, None), (901, ""), (902, " \n\t"), (903, "NEW words Qqq"), (904, "z" * 30_000), (905, "The the THE")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    found = {r.doc_id: r for r in lm.lm_scores(docs, F.col("doc_id") % 7 != 2).collect()}
    words = {i: (t or "").encode().translate(lm.LOWER).split() for i, t in rows}
    counts = Counter(w for i, ws in words.items() if i % 7 != 2 for w in ws)
    ends = sum(i % 7 != 2 for i in words)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert set(found) == set(words)
    for i, ws in words.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert (r.n_tokens, r.train_tokens, r.learn) == (len(ws) + 1, n, i % 7 != 2)
        assert r.n_known == sum(counts[w] > 0 for w in ws) + 1
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0 and r.bits_per_byte > 0
    held = [i for i, _ in corpus(400) if i % 7 == 2]
    assert sum(found[i].score for i in held) > sum(found[i].base_score for i in held)
    assert found[904].bits_per_byte < 8.5


def told_by_loops(rows, learn):
    """(answer, share of what followed) of each token, from dictionaries."""
    one, two, three, texts = Counter(), Counter(), Counter(), {}
    for k, (i, t) in enumerate(rows):
        w = ["^", "^", *(t or "").encode().translate(lm.LOWER).split(), "$"]
        texts[k] = w
        if learn(i):
            for a, b, c in zip(w, w[1:], w[2:], strict=False):
                one[c] += 1
                two[b, c] += 1
                three[a, b, c] += 1
    ends, out = sum(learn(i) for i, _ in rows), []
    for k, (i, _) in enumerate(rows):
        own, told = int(learn(i)), []
        for n, (a, b, c) in enumerate(zip(texts[k], texts[k][1:], texts[k][2:], strict=False)):
            s3, s2 = (two[a, b] - own if n else 0), (one[b] if n else ends) - own
            d3, d2, d1 = three[a, b, c] - own, two[b, c] - own, one[c] - own
            told.append((3, s3 / d3) if s3 > 0 and d3 > 0 else (2, s2 / d2) if s2 > 0 and d2 > 0 else (1, 1 / d1) if d1 > 0 else (0, 1))
        out.append((i, [t for t, _ in told], sum(math.log2(s) for _, s in told), b" ".join(w for w, (t, _) in zip(texts[k][2:], told, strict=True) if t == 0 and w != "$")))
    return sorted(out, key=str)


def test_what_followed_what_equals_loops(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(lm, "GRAMS_PER_RANGE", 900)
    rows = [*corpus(120), *corpus(20), (None, "lor mag lor"), (None, None), (5, "Lor mag"), (8, ""), (9, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    told, _ = lm.tell(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2)
    found = sorted(
        ((r.doc_id, (lm._unpack(r.facts, np.uint16).reshape(2, -1)[0] >> 8).tolist(), r.named, bytes(r.spelt)) for r in told.filter("distinct IS NULL").collect()), key=str
    )
    expected = told_by_loops(rows, lambda i: (i or 0) % 7 != 2)
    assert told.agg(F.sum("distinct")).first()[0] == len({w for i, t in rows if (i or 0) % 7 != 2 for w in (t or "").lower().split()}) + 1
    assert sorted((i, t, s) for i, t, _, s in [(str(i), t, n, s) for i, t, n, s in found]) == sorted((str(i), t, s) for i, t, _, s in expected)
    assert abs(sum(n for *_, n, _ in found) - sum(n for *_, n, _ in expected)) < 1e-6


def test_probabilities_of_all_continuations_add_up():
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    mixer = lm.spelling_mixer()
    places, gate, bit, _ = lm.spelling(words)
    np.add.at(mixer.counts.reshape(-1), (places * 2 + bit.astype(np.int64)).ravel(), 1)
    mixer.learn(*lm._flat(places, gate, bit), count=False)

    def cost(word):
        return mixer.bits(*lm._flat(*lm.spelling([word])[:3])).reshape(8, -1)[:, : len(word)].sum()

    following = [cost(b"ab" + bytes([b])) - cost(b"ab") for b in range(256)]
    assert abs(sum(2.0**-x for x in following) - 1) < 0.02
    asked = lm.asked_mixer()
    facts = np.array([[rnd.randrange(256) | (rnd.randrange(4) << 8) for _ in range(500)], [rnd.randrange(50) for _ in range(500)]], np.uint16)
    places, gate, bit, _ = lm.questions([facts])
    asked.learn(places, gate, bit, count=True)
    yes, no = asked.bits(places, gate, np.ones_like(bit)), asked.bits(places, gate, np.zeros_like(bit))
    assert np.allclose(2.0**-yes + 2.0**-no, 1)


def test_equal_scores_for_any_order_and_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    rows = [*corpus(150), (None, "lor mag"), (3, None), (4, "lor mag dun"), (4, "lor mag dun")]
    found = []
    for order, parts in ((rows, 2), (rows[::-1], 7)):
        docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in order], SCHEMA).repartition(parts)
        scores = lm.lm_scores(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2).collect()
        found.append(sorted((str(r.doc_id), round(r.base_score, 6), r.score) for r in scores))
    for a, b in zip(*found, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9)


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64)), np.arange(300, dtype=np.uint64)):
        assert (lm._unpack_sorted(lm._pack_sorted(keys)) == keys).all()


def test_no_training_rows_and_empty(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    r = lm.lm_scores(spark.createDataFrame([(1, "ab", "", 0, 0)], SCHEMA), F.lit(False)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)


def test_words_and_counts_are_those_of_plain_python():
    """Words told in one pass over a chunk's bytes, and hashes sorted with their mark, or by places where no bit is free."""
    texts = ["", None, "  ", "\x0b\x0ca\tB\r\n", "é  É x  y", "a", "\ud800 z", "\x00 \x1c q\x85\xa0r", "a b a b a"]
    learn = np.arange(len(texts)) % 2 == 0
    words, many = lm.words_of(texts)
    plain = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    assert words.to_pylist() == [w for ws in plain for w in ws] and many.tolist() == [len(ws) for ws in plain]
    for bits in (20, 63, 64):
        chunk = lm.Chunk(texts, bits)
        marked = learn[chunk.doc]
        for (keys, at), (found, counts) in zip(chunk.tables(), chunk.counted(marked), strict=True):
            assert keys.tolist() == found.tolist()
            assert sum(np.bincount(a[marked], minlength=len(keys)) for a in at).tolist() == counts.tolist()


def test_stretched_predictions_follow_the_counts(monkeypatch):
    """They are told once for counts that stay, for all contexts, and anew when the counts change."""
    calls = []
    monkeypatch.setattr(lm, "stretch", lambda z, o, plain=lm.stretch: calls.append(z.shape) or plain(z, o))
    mixer = lm.Mixer(10, 2, 1)
    places, gate, bit = np.array([[1, 2, 3], [5, 5, 9]]), np.zeros(3, np.int64), np.array([1, 0, 1], np.float32)
    mixer.learn(places, gate, bit, count=True)
    for _ in range(3):
        mixer.inputs(places, gate)
    for _ in range(3):
        s, _, _ = mixer.inputs(places, gate, bit)
    assert calls == [(10,)] * 4
    zeros, ones = (mixer.counts[places][..., k] for k in (0, 1))
    assert s.tolist() == np.log((np.maximum(0, ones - bit) + np.float32(0.4)) / (np.maximum(0, zeros - (1 - bit)) + np.float32(0.4))).tolist()
