import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docweave.llm import bpe, language_id, packing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, shard int, bucket int, _row int, size string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, 1, 1, 1, "x") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \n\t", "a", "same text here", "same text here", "x" * 200_000, "one two three\n" * 400, "日本語 😀 <|endoftext|> ñ's"]


# sharding
def brute_capacity(sizes, k):
    best = sum(sizes)
    for cuts in combinations(range(1, len(sizes)), min(k, len(sizes)) - 1):
        at = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False)))
    return best


def test_minimax_capacity_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        k = rnd.randint(1, 4)
        capacity, starts = sharding.minimax_cuts(sizes, k)
        assert capacity == brute_capacity(sizes, k)
        at = [*starts, len(sizes)]
        assert starts[0] == 0 and len(starts) <= k and all(sum(sizes[a:b]) <= capacity for a, b in zip(at, at[1:], strict=False))
    assert sharding.minimax_cuts([], 4) == (0, [])


def test_a_hot_atom_leaves_the_other_shards_even():
    rnd = random.Random(9)
    for share in (3, 8):
        sizes = [rnd.randint(1, 200) for _ in range(3000)]
        hot = sum(sizes) // (share - 1)
        sizes.insert(900, hot)
        capacity, starts = sharding.minimax_cuts(sizes, 16)
        at = [*starts, len(sizes)]
        loads = sorted(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False))
        assert len(loads) == 16 and loads[-1] == capacity == hot
        assert loads[-2] < 1.15 * sum(loads[:-1]) / 15
    for _ in range(300):  # within the capacity, and as many runs as there are shards or atoms
        sizes = [rnd.choice([1, 2, 3, 30, 60]) for _ in range(rnd.randint(1, 12))]
        k = rnd.randint(1, 6)
        capacity, starts = sharding.minimax_cuts(sizes, k)
        at = [*starts, len(sizes)]
        assert len(starts) == min(k, len(sizes)) and starts == sorted(set(starts)) and starts[0] == 0
        assert max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False)) == capacity == brute_capacity(sizes, k)


def test_sharding_contract(spark):
    rnd = random.Random(1)
    texts = ODD + ["hot copy"] * 3000 + ["".join(rnd.choice("abc é") for _ in range(rnd.randint(1, 90))) for _ in range(2000)]
    rows = sharding.assign_shards(frame(spark, texts), 16).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    groups = {}
    for r in rows:
        groups.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(frame(spark, []), 16).count() == 0


def test_capacity_is_the_least_over_all_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ATOM_HEX", 1)
    monkeypatch.setattr(sharding, "REFINED_GROUPS", 20)
    rnd = random.Random(12)
    for hot in (1, 400):
        texts = ["x" * rnd.randint(0, 300) + str(i) for i in range(700)] + ["hot text " * 9] * hot
        rows = sharding.assign_shards(frame(spark, texts), 16).collect()
        groups = {}
        for t in texts:
            groups[t] = groups.get(t, 0) + len(t.encode()) + 1
        sizes = [groups[t] for t in sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())]
        load = {}
        for r in rows:
            load[r.shard] = load.get(r.shard, 0) + r["size"]
        assert max(load.values()) == sharding.minimax_cuts(sizes, 16)[0] and len(load) == 16
        order = sorted((hashlib.md5(texts[r.doc_id].encode()).hexdigest(), r.shard) for r in rows)
        assert [s for _, s in order] == sorted(s for _, s in order)


def test_sharding_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, "same" if i % 2 else f"t{i % 5}", "en", 1, 1, 1, "x") for i in range(5000)], SCHEMA)
    rows = sharding.assign_shards(docs, 4).collect()
    assert len(rows) == 5000
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


# packing
def test_packing_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, "a b " * (i % 4), "en", 1, 1, 1, "x") for i in range(300)], SCHEMA)
    rows = packing.pack(docs, max_tokens=4, budget=16, buckets=3).collect()
    assert sum(r.n_tokens for r in rows) == sum(2 * (i % 4) for i in range(300))
    assert len({(r.bucket, r.batch, r.row_in_batch) for r in rows}) == len(rows)


def test_boundaries_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(40), rnd.randint(1, 8)))
        counts = [rnd.randint(1, 9) for _ in lengths]
        k = rnd.randint(1, 4)
        bounds, padding = packing.optimal_boundaries(lengths, counts, k)

        def cost(b):
            return sum(c * (min(y for y in b if y >= x) - x) for x, c in zip(lengths, counts, strict=True))

        options = [[*c, lengths[-1]] for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m)]
        assert padding == min(map(cost, options)) == cost(bounds) and len(bounds) <= k
    assert packing.optimal_boundaries([], [], 3) == ([], 0)


def test_packing_keeps_every_token_and_the_budget(spark):
    rnd = random.Random(4)
    texts = ODD + [" ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 300))) for _ in range(900)]
    rows = packing.pack(frame(spark, texts), max_tokens=64, budget=256, buckets=5, rows_per_chunk=16).collect()
    for i, t in enumerate(texts):
        own = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == i)
        assert sum(n for _, n in own) == len((t or "").encode().split())
        assert [s for s, _ in own] == [k * 64 for k in range(len(own))]
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.pad_to
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for own in batches.values():
        assert len(own) * own[0].pad_to <= 256 and sorted(r.row_in_batch for r in own) == list(range(len(own)))
    for b in {k for k, _ in batches}:
        assert sorted(x for k, x in batches if k == b) == list(range(sum(k == b for k, _ in batches)))
    assert packing.pack(frame(spark, [])).count() == 0


# quality
def repeated_words(words):
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(5))
    return len(covered)


def test_quality_base_measures(spark):
    rnd = random.Random(5)
    texts = ODD + [rnd.choice(["\n", " "]).join(rnd.choice(["a", "bb", "c", "d$", "é|"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    for r in quality.quality_rules(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated_words(words)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_quality_lines(spark):
    prose = "The river was cold in the morning, and nobody had crossed it since the bridge fell."
    cases = {
        prose: (True, prose),
        prose + "\nHome | About | Contact | News": (True, prose),
        "of%%% the&&& thea*** the&&& ha%%% anonre### thor### ananat%%% Inea*** orrely$$$ inghe### eaesti$$$": (False, None),
        "Home | News | Sport | Travel | Food | Culture | Weather | Video | Shop | Jobs | More": (False, None),
        prose + "\nWe use cookies, see our Cookie Policy for more.": (True, prose),
        "short text": (False, None),
        prose + "\n12 comments\n- Home page\n7\n1,204 likes\nLire la suite »\nThe story so far ...": (True, prose),
        prose + "\nWOW!! NOW!! BUY!!\nWeitere Angaben stehen in der Datenschutzerklärung.": (True, prose),
        prose + "\n- A point that is made in a sentence, and so stays.\nHe said no ...": (True, prose + "\n- A point that is made in a sentence, and so stays."),
        "The " + "long line about what a privacy policy of a firm may say, " * 5 + "stays.": (False, None),
        "A line says " + " ".join(f"w{i}" for i in range(60)) + " about what a privacy policy of a firm may say and stays.": (True, None),
    }
    docs = frame(spark, list(cases))
    kept = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    assert quality.clean_documents(docs).columns == docs.columns
    assert kept == {i: clean or t for i, (t, (ok, clean)) in enumerate(cases.items()) if ok}


# language identification
def test_language_id(spark):
    rnd = random.Random(6)
    stems = {"xx": ["lor", "mag", "dun", "kel", "vor"], "yy": ["isa", "oué", "ani", "eta", "ulo"]}
    rows = [(i, " ".join("".join(rnd.choice(stems[k]) for _ in range(3)) for _ in range(60)), k) for i in range(120) for k in [rnd.choice(["xx", "yy"])]]
    docs = spark.createDataFrame([(i, t, k, 0, 0, 0, "") for i, t, k in rows] + [(900, None, "xx", 0, 0, 0, ""), (901, "12 34 !", "xx", 0, 0, 0, ""), (902, "lormag", None, 0, 0, 0, "")], SCHEMA)
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    found = {r.doc_id: r for r in language_id.identify(docs, model).select("doc_id", "_language.*").collect()}
    assert all(found[i].lang_pred == k and found[i].accepted for i, _, k in rows)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[900].lang_pred == found[901].lang_pred == "und" and not found[900].accepted
    empty = language_id.fit(docs.limit(0))
    assert {r._language.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_language_id_equals_loops(spark):
    import re
    import zstandard

    rnd = random.Random(10)
    stems = {"xx": ["lor", "mag", "dun"], "yy": ["lor", "oué", "ani"], "zz": ["pi"]}
    rows = [(i, " ".join("".join(rnd.choice(stems[k]) for _ in range(3)) for _ in range(rnd.choice([1, 5, 3000]))), k) for i in range(90) for k in [rnd.choice(["xx", "xx", "yy"])]]
    rows += [(i, "lor LOR. 12 lor", "yy") for i in (200, 200)] + [(None, "pi pi", "zz"), (None, "ani ani, ani", "yy"), (300, "a", None), (301, "Q", None), (302, "lor" * 60_000, None)]
    schema = "doc_id long, text string, lang string, _language string, h long, rank int"
    docs = spark.createDataFrame([(i, t, k, "mine", 5, 6) for i, t, k in rows], schema)
    model = language_id.fit(docs, dict_bytes=3000)
    names = [k for k, _ in model.dictionaries]
    assert names == ["xx", "yy", "zz"] and all(len(d) <= 3000 for _, d in model.dictionaries) and dict(model.dictionaries)["zz"] == b"pi pi   "
    identified = language_id.identify(docs, model)
    assert identified.columns == [*docs.columns, "__language"]
    for r in identified.collect():
        data = re.sub(r"[^\w]|[\d_]", " ", r.text.lower())
        data = " ".join(data.split()).encode()
        sizes = {}
        for level in (language_id.QUICK_LEVEL, language_id.STRONG_LEVEL):
            for k, d in model.dictionaries:
                zd = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(level=level, dict_data=zd, write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[k] = sum(len(c.compress(data[i : i + language_id.BLOCK])) for i in range(0, len(data), language_id.BLOCK))
            best, second = sorted(sizes.values())[:2]
            if (second - best) / second >= language_id.NARROW:
                break
        found = r["__language"]
        assert found.lang_pred == min(names, key=lambda k: sizes[k]) and r["_language"] == "mine"
        assert found.accepted == ((second - best) / second >= model.min_margin)


# byte pair encoding
def test_bpe_keeps_columns_of_the_same_name(spark):
    v = bpe.Vocabulary.load(PATH)
    docs = spark.createDataFrame([(1, "hello", "mine", 4)], "doc_id long, text string, ids string, decoded int")
    r = bpe.decode_documents(bpe.encode_documents(docs, v), v, ids_col="_ids").collect()[0]
    assert (r.ids, r.decoded, r._decoded) == ("mine", 4, "hello")


def test_bpe_equals_the_library(spark):
    rnd = random.Random(7)
    alphabet = [*"aaabcde 'stre\n\t\r\x1c\x85 é日😀１²_-.,!", "<|endoftext|>", "'ll", "   ", "zq", "　", "\x00"]
    texts = [t for t in ODD if t is not None] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + [None]
    v, t = bpe.Vocabulary.load(PATH), Tokenizer.from_file(PATH)
    encoded = bpe.encode_documents(frame(spark, texts), v)
    for r in bpe.decode_documents(encoded, v).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_cuts(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    v, t = bpe.Vocabulary.load(PATH), Tokenizer.from_file(PATH)
    e = bpe.Encoder(v)
    for text in ("hello there world", "again <|endoftext|> hello", "", "aaaa aaaaa aaaaaa"):
        assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert not v.inside[ord("q"), ord("z")] and v.inside[ord("t"), ord("h")]
    assert hashlib.sha256(bpe.decode(np.zeros(0, np.int64), v).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("text", ["a" * 4000, " " * 3000, "abab" * 900])
def test_bpe_long_runs(text):
    v, t = bpe.Vocabulary.load(PATH), Tokenizer.from_file(PATH)
    assert bpe.Encoder(v).encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
