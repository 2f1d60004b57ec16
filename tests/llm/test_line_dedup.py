import random

from docweave.llm import line_dedup as ld
from docweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, line_no int, id long, label string, class int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n):
    chars = list(text)
    for _ in range(n):
        i = rnd.randrange(len(chars))
        kind = rnd.randrange(3)
        if kind == 0:
            chars.insert(i, rnd.choice("abé "))
        elif kind == 1:
            chars.pop(i)
        else:
            chars[i] = rnd.choice("abé ")
    return "".join(chars)


def test_edit_distance_equals_brute_force(spark):
    rnd = random.Random(1)
    pairs = []
    for _ in range(800):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 50)))
        pairs.append((a, edited(rnd, a, rnd.randint(0, 5))))
    for t in (1, 2, 3):
        for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.edit_distance("a", "b", t).alias("d")).collect():
            true = distance(r.a, r.b)
            if min(len(r.a), len(r.b)) > t:
                assert (r.d <= t) == (true <= t) and (true > t or r.d == true)


def test_classes_equal_brute_force(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([10, 24, 26, 40, 41, 90, 158, 160, 200]))) for _ in range(40)]
    texts = []
    for _ in range(90):
        lines = [edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3, 4, 5])) for _ in range(rnd.randint(0, 4))]
        texts.append("\n".join(f" {x}\t" if rnd.random() < 0.2 else x for x in lines))
    texts += [None, "", " \n\t\n", "x" * 50_000, "x" * 50_001]
    docs = spark.createDataFrame([(i, t, 0, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)
    lines = [(i, n, x) for i, t in enumerate(texts) for n, raw in enumerate((t or "").split("\n")) if (x := raw.strip(ld.SPACES))]
    distinct = list(dict.fromkeys(x for *_, x in lines))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            t = 4 if min(len(a), len(b)) >= 160 else 2
            if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= t and (len(a) > 1000 or distance(a, b) <= t):
                root[find(a)] = find(b)
    first = {}
    for i, n, x in lines:
        first.setdefault(find(x), (i, n))
    expected = {(i, n): (*first[find(x)], first[find(x)] == (i, n)) for i, n, x in lines}
    found = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.keep) for r in ld.line_classes(docs, ((24, 2), (160, 4))).collect()}
    assert found == expected


def test_dedup_lines(spark):
    line = "This is a line that is long enough to be compared."
    rows = [(1, line + "\nshort"), (2, line.replace("long", "lung") + "\nshort\nAnother line that only this document has, so far."), (3, line), (4, None)]
    docs = spark.createDataFrame([(i, t, 7, 8, "k", 9) for i, t in rows], SCHEMA)
    kept = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert kept == {1: line + "\nshort", 2: "Another line that only this document has, so far.", 4: None}
    assert ld.dedup_lines(docs).columns == docs.columns
    assert ld.line_classes(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "X\nA"), (1, "B\nX"), (2, "X\nC"), (2, "X\nC"), (None, "A\nD"), (None, "E\nD")]
    docs = spark.createDataFrame([(i, t, 7, 8, "k", 9) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in ld.dedup_lines(docs).collect()]
    lines = [x for _, t in kept for x in t.split("\n")]
    assert sorted(lines) == list("ABCDEX") and sorted(i or 0 for i, _ in kept) == [0, 0, 1, 1, 2]


def test_large_buckets_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 4)
    rnd = random.Random(5)
    texts = ["This form is the same for all: " + "".join(rnd.choice("ab") for _ in range(7)) for _ in range(60)]
    texts += ["This form is the same for all: " + "".join(rnd.choice("xyzuvw") for _ in range(9)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, 0, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if distance(texts[i], texts[j]) <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id: r.first_doc_id for r in ld.line_classes(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_documents_of_which_only_short_repeats_are_left_go(spark):
    line = "This is a line that is long enough to be compared."
    rows = [(1, line + "\nshort"), (2, line + "\nshort"), (3, "short\n" + line + "\nnew"), (4, "short"), (None, "short\nfirst")]
    docs = spark.createDataFrame([(i, t, 7, 8, "k", 9) for i, t in rows], SCHEMA)
    kept = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert kept == {1: line, 3: "new", None: "short\nfirst"}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 400), (400, 300), (7, 7)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 40), 1), 300: 300, 400: 300, 500: 300}
