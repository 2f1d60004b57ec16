import random

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"aa": ["lor", "mag", "dun", "kel", "vor", "pi"], "bb": ["isa", "oué", "ani", "eta", "ulo", "ñe"]}


def prose(rnd, lang, words):
    out = []
    for i in range(words):
        w = "".join(rnd.choice(STEMS[lang]) for _ in range(rnd.randint(1, 4)))
        out.append(w + (".\n" if i % 17 == 16 else ""))
    return " ".join(out).replace("\n ", "\n") + "."


def test_each_stage_acts_and_keeps_clean_documents(spark):
    rnd = random.Random(3)
    clean = {i: (prose(rnd, k := rnd.choice(["aa", "bb"]), rnd.randint(30, 200)), k) for i in range(150)}
    clean[5] = (prose(rnd, "aa", 150).replace("\n", " "), "aa")  # one line
    passage = prose(rnd, "aa", 17 * 4).split("\n")[0]
    texts = {i: t for i, (t, _) in clean.items()}
    lang = {i: k for i, (_, k) in clean.items()}
    words = texts[5].split(" ")
    words[len(words) // 2] = "changed"
    extra = {
        500: texts[3],  # an exact copy
        501: " ".join(words),  # a near copy
        502: passage + "\n" + prose(rnd, "aa", 60),
        503: passage + "\n" + prose(rnd, "aa", 60),  # the same line again
        504: "of%%% the&&& thea*** the&&& ha%%% anonre### thor### ananat%%% Inea*** orrely$$$ inghe### eaesti$$$",
        505: None,
        506: "1234 5678 9012 3456 7890 1111 2222 3333 4444 5555 6666 7777",
    }
    for i, t in extra.items():
        texts[i], lang[i] = t, "aa"
    docs = spark.createDataFrame([(i, t, lang[i], "s", 1) for i, t in texts.items()], SCHEMA)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "").checkpoint()
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert set(clean) <= ids, name
        if name == "quality_rules":
            assert not ids & {504, 505} and 506 in ids
        elif name == "language_id":
            assert 506 not in ids and 500 in ids
        elif name == "line_dedup":
            assert 500 not in ids and {502, 503} <= ids
            left = {r.doc_id: r.text for r in docs.filter("doc_id > 500").collect()}
            assert passage in left[502] and passage not in left[503]
        else:
            assert ids == {*clean, 502, 503}
    packed = cp.packing_stage(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {*clean, 502, 503}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "").checkpoint()
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_rows_without_an_id_of_their_own(spark):
    rnd = random.Random(4)
    a, b, c, d = (prose(rnd, "aa", 90) for _ in range(4))
    repeat = prose(rnd, "bb", 17).split("\n")[0]
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (1, repeat + "\n" + a[::-1]), (None, repeat + "\n" + b[::-1]), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], SCHEMA)
    kept = cp.line_dedup_stage(spark, docs, "").collect()
    # the null id comes first and keeps the repeated line; no other row loses a line by it
    expected = [(None, a), (None, b), (7, c), (7, d), (1, a[::-1]), (None, repeat + "\n" + b[::-1]), (8, None), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(expected, key=str)

    near = c.replace(c.split(" ")[40], "changed", 1)
    rows = [(None, a), (None, a), (5, a), (7, c), (7, d), (7, d), (3, near), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], SCHEMA)
    kept = cp.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, a), (3, near), (7, d), (8, None), (8, None)], key=str)


def grouped(names, linked):
    """The smallest name that links reach from each."""
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in names:
        for b in names:
            if a < b and find(a) != find(b) and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in names}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(8)
    base = [prose(rnd, "aa", n).split(" ") for n in (6, 30, 60, 120)]
    texts = {}
    for i in range(60):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = f"other{rnd.randrange(9)}"
        texts[i] = " ".join(words)
    texts |= {70: None, 71: "", 72: " \n", 73: "one two", 74: "ONE two", 75: "three"}

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    group = grouped(sorted(texts), lambda a, b: bool(sets[a] and sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in texts.items()], SCHEMA).repartition(6)
    kept = {(r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {(i, t) for i, t in texts.items() if group[i] == i}


def test_line_dedup_equals_brute_force(spark):
    from test_line_dedup import distance, edited

    rnd = random.Random(9)
    lines = [prose(rnd, "aa", n).replace("\n", " ") for n in (2, 3, 6, 8, 12)]
    texts = {}
    for i in range(50):
        texts[i] = "\n".join(rnd.choice([rnd.choice(lines), edited(rnd, rnd.choice(lines), rnd.choice([1, 2, 3])), prose(rnd, "bb", 7).replace("\n", " "), "", " "]) for _ in range(rnd.randint(1, 4)))
    texts |= {60: None, 61: ""}
    places = [(i, n, raw.strip()) for i, t in texts.items() for n, raw in enumerate((t or "").split("\n")) if raw.strip()]
    alike = lambda a, b: len(a) >= 24 and len(b) >= 24 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2
    group = grouped(sorted({x for *_, x in places}), alike)
    first = {}
    for i, n, x in places:
        first[group[x]] = min(first.get(group[x], (i, n)), (i, n))
    gone = {(i, n) for i, n, x in places if first[group[x]] != (i, n)}
    want = set()
    for i, t in texts.items():
        own = [n for j, n, _ in places if j == i]
        if own and all((i, n) in gone for n in own):
            continue
        want.add((i, t if not any((i, n) in gone for n in own) else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)))
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in texts.items()], SCHEMA).repartition(6)
    assert {(r.doc_id, r.text) for r in cp.line_dedup_stage(spark, docs, "").collect()} == want
