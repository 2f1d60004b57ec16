"""Windows, sweeps, orders, states, votes and scorers against loops that restate their rules."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweave.functions.islands import folded
from docweave.operators import alignment as al
from docweave.operators import entries as en
from docweave.operators import fields as fd
from docweave.operators import headings as hd
from docweave.operators import layout as lo
from docweave.operators import projects as pj
from docweave.operators import scoring
from docweave.operators import table_functions as tf
from docweave.streaming import streams as st

TOKEN = "doc_id long, page int, line_index int, token_index int, token string, x0 double, y0 double, x1 double, y1 double, section string, bio_label string"


def test_windows_merge_as_a_loop_does_for_every_length(spark):
    rnd, rows, want = random.Random(3), [], {}
    for n in sorted({*range(1, 700, 7), 250, 251, 310, 400, 401, 550}):
        best, label, start = [float("inf")] * n, ["O"] * n, 0
        while start < n:
            end = min(start + 250, n)
            for pos in range(start, end):
                said = rnd.choice(["O", "O", "B-A", "I-A"])
                rows.append((n, 0, pos // 10, pos % 10, pos, start, end, said))
                away = abs(pos - (start + end) / 2)
                if away < best[pos] or said != "O":
                    label[pos], best[pos] = said, away - 100 if said != "O" else away
            if end == n:
                break
            start += 150
        want.update({(n, pos): x for pos, x in enumerate(label)})
    scored = spark.createDataFrame(rows, 'doc_id long, page int, line_index int, token_index int, pos int, start int, `end` int, label string')
    got = fd.merge_windows(scored.repartition(7)).collect()
    assert {(r.doc_id, r.line_index * 10 + r.token_index): r.label for r in got} == want


def test_a_far_label_is_overturned_by_a_nearer_o(spark):
    """310 tokens: token 240 is 115 from the middle of the first window, which says B, and 10 from that of the second."""
    rows = [(1, 0, 0, 240, 240, 0, 250, "B-A"), (1, 0, 0, 240, 240, 150, 310, "O"), (1, 0, 0, 200, 200, 0, 250, "B-A"), (1, 0, 0, 200, 200, 150, 310, "O")]
    scored = spark.createDataFrame(rows, 'doc_id long, page int, line_index int, token_index int, pos int, start int, `end` int, label string')
    assert {r.token_index: r.label for r in fd.merge_windows(scored).collect()} == {240: "O", 200: "B-A"}


def page(rnd, doc, columns):
    rows = []
    for line in range(12):
        for side in range(columns):
            x = 40.0 + 260 * side + rnd.choice([0, 0, 2.5])
            for k in range(rnd.randint(1, 4)):
                word = rnd.choice(["word", "a", "--", "longer1", "|"])
                rows.append((doc, 0, line, side * 10 + k, word, x, 20.0 * line + rnd.choice([0, 1]), x + 7.3 * len(word), 20.0 * line + 11, "OTHER", "O"))
                x += 7.3 * len(word) + 4
    return rows


def gutter(rows):
    """Loop over whole x, then over lines."""
    low, high = min(r[5] for r in rows), max(r[7] for r in rows)
    start, end = int(low + 0.05 * (high - low)), int(low + 0.55 * (high - low))
    if end <= start:
        return None
    cover = lambda x, only: sum(r[5] < x < r[7] and (not only or any(c.isalnum() for c in r[4])) for r in rows)
    n, x = min((cover(x, True), x) for x in range(start, end + 1))
    free = 0
    for line in {r[2] for r in rows}:
        on = [r for r in rows if r[2] == line]
        left, right = [r[7] for r in on if r[7] <= x], [r[5] for r in on if r[5] >= x]
        if left and right and not any(r[5] < x < r[7] for r in on):
            free += 10 <= min(right) - max(left) <= 150
    return x, n, (n <= 3 or n < 0.08 * len(rows)) and free >= 2


def test_gutters_equal_a_loop_over_every_x(spark):
    rnd = random.Random(5)
    docs = {d: page(rnd, d, 1 + d % 2) for d in range(24)}
    tokens = spark.createDataFrame([r for rows in docs.values() for r in rows], TOKEN)
    found = {r.doc_id: (r.gutter_x, r.overlaps, r.has_gutter) for r in lo.detect_gutter(tokens).collect()}
    assert found == {d: g for d, rows in docs.items() if (g := gutter(rows))}
    assert {g[2] for g in found.values()} == {True, False}
    unknown = tokens.withColumn("section", F.lit(None).cast("string"))
    assert lo.detect_gutter(unknown).count() == len(found) and lo.detect_gutter(tokens.limit(0)).count() == 0


def test_reading_order_on_pages_of_one_and_two_columns(spark):
    rnd = random.Random(6)
    two = page(rnd, 1, 2)
    rows = list(two)
    # a section read by rows: tokens of one visual row that stand on two heights
    rows += [(2, 0, 0, 0, "b", 100.0, 10.0, 110.0, 20.0, "SKILLS", "O"), (2, 0, 1, 0, "a", 50.0, 12.0, 60.0, 22.0, "SKILLS", "O"), (2, 0, 2, 0, "c", 10.0, 40.0, 20.0, 50.0, "SKILLS", "O")]
    # one read by lines, though its second line stands higher; and a section above it
    rows += [(3, 0, 5, 0, "first", 10.0, 90.0, 20.0, 99.0, "PROJECT", "O"), (3, 0, 6, 0, "second", 10.0, 60.0, 20.0, 69.0, "PROJECT", "O"), (3, 0, 9, 0, "top", 10.0, 1.0, 20.0, 9.0, "SUMMARY", "O")]
    got = lo.order_reading(spark.createDataFrame(rows, TOKEN)).collect()
    order = lambda d: [r.token for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.read_pos)]
    x, _, has = gutter(two)
    assert has
    side = lambda r: (r[5] + r[7]) / 2 >= x
    assert order(1) == [r[4] for r in sorted(two, key=lambda r: (side(r), r[6], r[5], r[2], r[3]))]
    assert order(2) == ["a", "b", "c"] and order(3) == ["top", "first", "second"]


def date_loop(rows):
    """Roles by a list of open dates, as a reader would close ranges."""
    roles, waiting = {}, []
    for i, (kind, text, half) in enumerate(rows):
        if kind == "title":
            waiting = []
        if kind == "date":
            if text in ("Present", "till date"):
                roles[i] = "EDATE"
            elif half:
                roles[i] = "EDATE" if half == "right" else "SDATE"
            else:
                waiting.append(i)
                roles[i] = "SDATE"
                if len(waiting) == 2:
                    roles[i], waiting = "EDATE", []
    return roles


def test_date_roles_close_pairs(spark):
    rnd, rows, want = random.Random(7), [], {}
    fixed = [[("date", "Present", None)], [("title", "t", None), ("date", "2019", None), ("date", "2020", None), ("date", "2021", None)], [("date", "2019", None), ("title", "t", None), ("date", "2020", None)]]
    for d in range(40):
        doc = fixed[d] if d < 3 else [rnd.choice([("title", "t", None), ("date", "2019", None), ("date", "Present", None), ("date", "till date", None), ("text", "x", None), ("date", "2001", "left"), ("date", "2002", "right")]) for _ in range(12)]
        rows += [(d, 0, i, 0, 0.0, *r) for i, r in enumerate(doc)]
        want[d] = date_loop(doc)
    df = spark.createDataFrame(rows, "doc_id long, page int, line_index int, token_index int, x0 double, kind string, text string, half string")
    found = {d: {} for d in want}
    for r in en.date_roles(df, F.col("kind") == "title", F.col("kind") == "date", F.col("text"), F.col("half")).collect():
        found[r.doc_id][r.line_index] = r.date_role
    assert found == want


LINE = "doc_id long, page int, line_index int, text string, begins boolean, inside boolean, hinted boolean"
#: text, scored as a start, as going on, hinted: is it a head?
BOUNDARIES = [
    ("Engineer at Example ( Jan 2019 - Present )", True, False, False, True),
    ("• Built a store in 2019", True, False, False, False),  # a description
    ("Example Ltd", True, False, False, False),  # no date
    ("Example Ltd | 2019", True, False, False, False),  # goes on with an entry
    ("Example Ltd", True, False, True, True),  # hinted
    ("Senior Engineer Jan 2021", False, True, False, False),  # within five lines of a head
    ("plain words", False, True, False, False),
    ("more plain words", False, True, False, False),
    ("still plain words", False, True, False, False),
    ("and plain words", False, True, False, False),
    ("Senior Engineer Jan 2021", False, True, False, True),  # six lines after the last head
    ("Engineer 2021", False, True, False, False),  # one word before the date
    ("Platform X | Java | 2020", False, False, True, True),  # hinted, an entry inside an entry
    ("• Some item", False, True, True, True),  # a hinted bullet that goes on
    ("Summer internship 2018", False, False, True, True),
]


def test_experience_boundaries_branch_by_branch(spark):
    df = spark.createDataFrame([(1, 0, i, t, b, g, h) for i, (t, b, g, h, _) in enumerate(BOUNDARIES)], LINE)
    found = {r.line_index: r.is_head for r in en.exp_boundary_fix(en.exp_line_rules(df, "begins", "inside", "hinted")).collect()}
    assert [found[i] for i in range(len(BOUNDARIES))] == [x[-1] for x in BOUNDARIES]
    blank = spark.createDataFrame([(1, 0, 0, None, None, None, None), (1, 0, 1, "", True, True, False)], LINE)
    assert not any(r.is_head for r in en.exp_boundary_fix(en.exp_line_rules(blank, "begins", "inside", "hinted")).collect())
    other_page = spark.createDataFrame([(1, 0, 9, BOUNDARIES[0][0], True, True, False), (1, 1, 1, "Senior Engineer Jan 2021", False, True, False)], LINE)
    assert all(r.is_head for r in en.exp_boundary_fix(en.exp_line_rules(other_page, "begins", "inside", "hinted")).collect())


FLAGS = ("in_project", "begins", "resets", "has_bullet", "is_counted", "suppress", "is_continuation", "is_title", "is_numbered", "is_link_title")


def boundary_loop(rows):
    heads, is_open, before = [], False, False
    for r in rows:
        turn = before and not r["has_bullet"]
        before = r["has_bullet"]
        if not r["in_project"]:
            is_open = False
            heads.append(False)
            continue
        may, force, head = r["has_bullet"] or r["is_counted"] or r["resets"] or turn, r["is_numbered"] or r["is_link_title"], False
        if r["begins"]:
            head = not (is_open and not may) and not r["suppress"] and not r["is_continuation"] and not (r["has_bullet"] and not r["is_title"])
        elif r["is_title"]:
            head = (may or force) and (not is_open or r["has_bullet"] or turn or force)
        is_open = is_open or head
        heads.append(head)
    return heads


def test_project_boundaries_equal_the_state_machine(spark):
    rnd, rows, want = random.Random(9), [], {}
    for d in range(200):
        doc = [{f: rnd.random() < (0.85 if f == "in_project" else 0.3) for f in FLAGS} for _ in range(10)]
        rows += [(d, 0, i, *[r[f] for f in FLAGS]) for i, r in enumerate(doc)]
        want[d] = boundary_loop(doc)
    df = spark.createDataFrame(rows, "doc_id long, page int, line_index int, " + ", ".join(f"{f} boolean" for f in FLAGS))
    found = {d: [False] * 10 for d in want}
    for r in pj.proj_boundary_fix(df).collect():
        found[r.doc_id][r.line_index] = r.is_head
    assert found == want


def test_nearest_heads_equal_all_pairs(spark):
    rnd, missed, found = random.Random(10), set(), set()
    for d in range(60):
        missed |= {(d, rnd.randrange(6), rnd.randrange(30)) for _ in range(5)}
        found |= {(d, rnd.randrange(6), rnd.randrange(30)) for _ in range(rnd.choice([0, 1, 4]))}
    schema = "doc_id long, page int, line_index int"
    got = {(r.doc_id, r.page, r.line_index): (r.near_page, r.near_line) for r in al.nearest_head(spark.createDataFrame(sorted(missed), schema), spark.createDataFrame(sorted(found), schema)).collect()}
    want = {}
    for d, p, line in missed:
        if near := [(abs(p - q), abs(line - x), q, x) for e, q, x in found if e == d]:
            want[d, p, line] = min(near)[2:]
    assert got == want


def test_merged_tokens_find_bounded_parts(spark):
    truth = [(1, 0, 0, 0, "July'22", 10.0, 5.0, 50.0, 15.0, "X", "B-SDATE"), (1, 0, 1, 0, "(Acme)", 10.0, 30.0, 50.0, 40.0, "X", "B-COMP"), (1, 0, 2, 0, "Acmex", 10.0, 60.0, 50.0, 70.0, "X", "B-ROLE"), (1, 0, 3, 0, "C++", 10.0, 90.0, 50.0, 99.0, "X", "B-SKILL")]
    cases = [("July", 30.0, 5.0, "B-SDATE"), ("22", 40.0, 6.0, "B-SDATE"), ("Acme", 99.0, 32.0, "B-COMP"), ("Acme", 99.0, 60.0, None), ("Acme", 10.5, 60.0, "B-ROLE"), ("Acmex-Labs", 10.0, 61.0, "B-ROLE"), ("++", 200.0, 90.0, None), ("+", 10.9, 90.0, None), ("July", 10.0, 9.0, None), ("", 10.0, 5.0, None)]
    found = [(1, 0, 9, i, t, x, y, x + 9, y + 9, "X", "O") for i, (t, x, y, _) in enumerate(cases)]
    got = {r.token_index: r.truth for r in al.align_merged(spark.createDataFrame(found, TOKEN), spark.createDataFrame(truth, TOKEN)).collect()}
    assert [got.get(i) for i in range(len(cases))] == [c[-1] for c in cases]


def test_lines_meet_by_pairs_of_words_as_all_pairs_do(spark):
    rnd, rows = random.Random(11), []
    for line in range(60):
        n = rnd.choice([1, 2, 3, 7, 12, 40, 60])
        words = [f"w{rnd.randrange(9)}" for _ in range(n)] if n < 13 else [f"w{i}" for i in range(n)]
        for _ in range(rnd.choice([0, 1, 3])):
            words[rnd.randrange(len(words))] = f"other{rnd.randrange(3)}"
        rows.append((1, line % 3, line, " ".join(words)))
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_index int, text string")
    changed = [(d, p, k, t + " more" if k % 4 == 0 else t) for d, p, k, t in rows]
    got = {(r.page, r.a_line): (r.b_line, r.score) for r in al.align_line_jaccard(spark.createDataFrame(changed, lines.schema), lines).collect()}
    want = {}
    for _, p, k, t in changed:
        a, best = set(t.split()), []
        for _, q, j, u in rows:
            b = set(u.split())
            if p == q and len(a & b) >= 0.85 * len(a | b):
                best.append((-len(a & b) / len(a | b), j))
        if best:
            want[p, k] = (min(best)[1], round(-min(best)[0], 6))
    assert got == want


def test_label_maps_and_votes(spark):
    labels = ["B-SKILL_CAT", "L-SKILL", "U-SKILL", "b-skill", "B-HEADING", None, "O", "I-PROJ_NAME", "LINK", "B-URL", "B-EDESC", "i-grade", "B-COMP_LOC", "I-ROLEMETA"]
    rows = [(1, 0, 0, i, "t", 0.0, 0.0, 1.0, 1.0, "X", x) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, TOKEN)
    got = {t: [r.mapped for r in sorted(fd.map_label(df, t).collect(), key=lambda r: r.token_index)] for t in fd.LABEL_MAPS}
    assert got["skills"] == ["B-SKILL_TYPE", "I-SKILL", "B-SKILL", "B-SKILL", "O", "O", "O", "O", "O", "O", "O", "O", "O", "O"]
    assert got["project"][7:10] == ["I-PROJ", "O", "O"] and got["project"][0] == "B-SKILL_CAT"
    assert got["education"][10:12] == ["B-DESC", "I-GPA"]
    assert got["experience"][12:] == ["COMP", "ROLE"] and got["experience"][4] is None

    def vote(*labels):
        rows = [(1, 0, 0, i, "t", 0.0, 0.0, 1.0, 1.0, "X", x) for i, x in enumerate(labels)]
        return fd.class_vote(spark.createDataFrame(rows, TOKEN), ("doc_id",)).first().label

    assert vote("O", "I-DESC", "I-DESC", "B-SDATE") == "DATE"  # the first start
    assert vote("I-DESC", "I-DESC", "I-ROLE", "I-ROLE") == "ROLE"  # priority in a tie
    assert vote("I-DESC", "I-DESC", "I-ROLE") == "DESC" and vote("O", "B-HEADING") is None
    seg = lambda text, *ls: fd.segment_vote(spark.createDataFrame([(1, 0, 0, i, text if i == 0 else "", 0.0, 0.0, 1.0, 1.0, "X", x) for i, x in enumerate(ls)], TOKEN), ("doc_id",), {"PROJ_NAME": "PROJECT_NAME"}, "DESC").first().label
    assert seg("Store", "B-PROJ_NAME", "I-PROJ_NAME", "O") == "PROJECT_NAME" and seg("since May 2019", "O", "O") == "DATE" and seg("x", "O", "I-EDATE") == "DATE"


def test_punctuation_is_bridged_block_by_block(spark):
    rnd, rows, want = random.Random(12), [], {}
    for d in range(120):
        doc = [(rnd.choice(["word", ",", "|"]), rnd.choice(["A", "B", "O"])) for _ in range(9)]
        labels = [x for _, x in doc]
        for i in range(1, 8):
            if not doc[i][0].isalnum() and labels[i - 1] == labels[i + 1]:
                labels[i] = labels[i - 1]
        rows += [(d, i, *r) for i, r in enumerate(doc)]
        want[d] = labels
    out = fd.bridge_punct(spark.createDataFrame(rows, "doc_id long, block int, text string, label string")).collect()
    assert {d: [r.label for r in sorted((r for r in out if r.doc_id == d), key=lambda r: r.block)] for d in want} == want


def test_long_folds(spark):
    df = spark.createDataFrame([(1, i, i % 7) for i in range(1000)] + [(2, 0, 5)], "k int, i int, v int")
    start = F.struct(F.lit(0).alias("s"))
    out = folded(df, ("k",), ("i",), start, "struct<s:int>", lambda s, r: F.struct(((s["s"] * 3 + r["v"]) % 101).alias("s")), "s", "int").collect()
    s, want = 0, {}
    for i in range(1000):
        s = (s * 3 + i % 7) % 101
        want[i] = s
    assert {r.i: r.s for r in out if r.k == 1} == want and [r.s for r in out if r.k == 2] == [5]


def test_a_scorer_gets_text_and_vector(spark):
    def counting(frames):
        for frame in frames:
            yield pd.DataFrame({"scores": [[float(len(t)), float(sum(v))] for t, v in zip(frame["text"], frame["v"], strict=True)]})

    def losing(frames):
        for frame in frames:
            yield pd.DataFrame({"scores": [[0.0, 1.0]] * (len(frame) - 1)})

    df = spark.createDataFrame([(i, "x" * (i % 5) if i % 9 else None, [1.0, 0.5] if i % 4 else None) for i in range(500)], "id int, text string, v array<double>").repartition(4)
    got = {r.id: r.label for r in scoring.score_with(df, "counting", lambda: counting, ["TEXT", "VECTOR"], ["id"]).collect()}
    assert got == {i: "TEXT" if (i % 5 if i % 9 else 0) >= (1.5 if i % 4 else 0) else "VECTOR" for i in range(500)}
    with pytest.raises(Exception, match="the scorer gave"):
        scoring.score_with(df, "losing", lambda: losing, ["A", "B"], ["id"]).collect()
    assert scoring.score_with(df.limit(0), "counting", lambda: counting, ["A", "B"], ["id"]).collect() == []


def test_the_table_function_splits_lines(spark):
    tf.register(spark)
    spark.createDataFrame([(1, "a,b (c)  2010-2014 http://x:1"), (2, None), (3, "")], "id int, line string").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT id, r.* FROM some_lines, LATERAL retokenise(line) AS r ORDER BY id, token_index, part").collect()
    assert [(r.id, r.token_index, r.part, r.token) for r in got] == [
        (1, 0, 0, "a"), (1, 0, 1, ","), (1, 0, 2, "b"), (1, 1, 0, "("), (1, 1, 1, "c"), (1, 1, 2, ")"), (1, 2, 0, ""), (1, 3, 0, "2010"), (1, 3, 1, "-"), (1, 3, 2, "2014"), (1, 4, 0, "http://x:1"), (3, 0, 0, ""),
    ]


HEADS = [
    ("WORK EXPERIENCE", False, 0.92, True), ("• Java", False, 0.78, False), ("Technical Skills:", False, 0.92, False), ("• Languages", False, 0.78, False), ("• Frontend", False, 0.78, False),
    ("• worked with the team", False, 0.3, False), ("Education details of mine", False, 0.6, False), ("Employment", False, 0.92, True), ("Developer 01 / 2019 to 02 / 2020", False, 0.82, True),
    ("Developer 01 / 2019 to 02 / 2020", False, 0.3, False), ("Software Engineer", False, 0.95, True), ("Email: x", False, 0.95, False), ("Jan 2019 - Present", False, 0.95, False), ("A | B | C", False, 0.95, True), ("HOBBIES", False, 0.92, False),
]


def test_headings_are_decided_with_what_stands_before(spark):
    rows = [(1, 0, i, t, b, 10.0) for i, (t, _, _, b) in enumerate(HEADS)] + [(1, 1, i, "plain text of no kind", False, 10.0) for i in range(20)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_index int, text string, is_bold boolean, font_median double")
    got = {r.line_index: (r.is_heading, r.heading_confidence) for r in hd.decide(lines).filter("page = 0").collect()}
    sure = [c for _, _, c, _ in HEADS]
    sure[1] = 0.3  # no heading of skills before it
    assert [got[i][1] for i in range(len(HEADS))] == sure
    assert all(head == (0.7 <= c < 0.95) for head, c in got.values())


def test_labels_are_mended_by_the_label_they_have(spark):
    cases = [("Tools", "OTHER", "SKILLS"), ("Awards", "EDUCATION", "EDUCATION"), ("Awards", "PROJECT", "OTHER"), ("Internship", "OTHER", "EXPERIENCE"), ("Internship", "EDUCATION", "EDUCATION"), ("Profile", "PERSONAL", "SUMMARY"), ("Profile", "PROJECT", "PROJECT"), ("My interests", "EDUCATION", "OTHER")]
    df = spark.createDataFrame(cases, "heading string, label string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", hd.normalise_label(F.col("heading"), F.col("label"))).collect())


@pytest.mark.parametrize(
    ("text", "score"),
    [("", 0.0), ("• Store | GitHub", 0.7), ("Code link", 0.45), ("Example Technologies", 0.3), ("1. Store project", 0.45), ("Store System: a shop", 0.3), ("plain words here", 0.0), ("A | React project, API", 1.0), ("( ) Store", 0.2)],
)
def test_title_likeness(spark, text, score):
    assert spark.createDataFrame([(text,)], "t string").select(lo.title_likeness(F.col("t"))).first()[0] == pytest.approx(score)


def events(folder, name, rows):
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/{name}.parquet")


def test_late_rows_go_and_state_with_them(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day = pd.Timestamp("2024-01-01")
    hour = pd.Timedelta(hours=1)
    events(folder, "a", [(i, day + i * hour, 1, "view", 1.0, "") for i in range(6)])
    events(folder, "b", [(10, day + 30 * hour, 1, "view", 1.0, "")])
    events(folder, "c", [(20, day + 0 * hour, 1, "view", 100.0, ""), (21, day + 31 * hour, 2, "buy", 1.0, "")])  # the first is a day late
    events(folder, "d", [(30, day + 60 * hour, 2, "view", 1.0, "")])
    for k, name in enumerate("abcd"):
        os.utime(folder / f"{name}.parquet", (1_700_000_000 + 10 * k,) * 2)
    stream = st.stage_latency(st.event_stream(spark, str(folder)))
    out = str(tmp_path / "out")
    query = st.ingest(stream, lambda df: df, out)
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out).collect()
    assert sorted((r.start - day.to_pydatetime()).total_seconds() / 3600 for r in rows) == [0, 1, 2, 3, 4, 5, 30, 31]
    assert {r.total for r in rows} == {1.0}  # the late hundred is in no window
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert max(s["numRowsTotal"] for s in state) >= 6 and state[-1]["numRowsTotal"] <= 1

    status = st.upserted_rows(st.latest_status(st.event_stream(spark, str(folder))), ["run_id"], str(tmp_path))
    assert sorted((r.run_id, r.status, r.events) for r in status.collect()) == [(1, "view", 8), (2, "view", 2)]


def test_token_sized_tables_are_not_broadcast(spark):
    import __spark_entry__ as entry

    for name in ("align_coord", "align_fuzzy_token", "align_merged", "write_back", "stamp_bio", "section_propagate"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan, name
