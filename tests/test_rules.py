"""Goldens of the rule packs, written down from the rules themselves, and rows that are null, empty or repeated."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import entries as en
from docweave.operators import fields as fd
from docweave.operators import headings as hd
from docweave.operators import linerules as lr
from docweave.operators import rulepacks as rp

LINE = "doc_id long, page int, line_index int, text string"


def lines(spark, texts, **columns):
    rows = [(1, 0, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, LINE)
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


EDUCATION = {
    "EDUCATION:": {"is_section_header", "suppress"},
    "——————————": {"has_bullet", "is_separator", "suppress"},
    "Examination  University  Year  Marks": {"is_table_header", "suppress"},
    "CGPA: 8.5 of 10": {"is_metadata", "suppress"},
    "• Completed two courses": {"has_bullet", "is_description", "suppress"},
    "Bachelor of Science": {"is_degree_opener", "is_degree", "is_title_only", "is_candidate", "promote"},
    "B.Tech, Example University, 2014": {"has_abbreviation", "has_date", "is_degree_opener", "is_institution", "is_degree", "is_candidate", "promote"},
    "Example College 2012": {"has_date", "is_institution", "is_split_institution", "is_degree", "is_candidate", "promote"},
    "Green Valley School 85%": {"is_institution", "is_split_institution", "is_candidate", "promote"},
    "12th Standard": {"is_exam", "is_degree", "is_title_only", "is_candidate", "promote"},
    "Higher Secondary Certificate": {"is_certificate", "is_degree_opener", "is_degree", "is_title_only", "is_candidate", "promote"},
    ") of Engineering": {"is_continuation", "suppress"},
    "Some other line of text": set(),
}


def test_education_lines(spark):
    found = lr.edu_line_rules(lines(spark, list(EDUCATION))).collect()
    assert {r.text: {k for k in lr.EDU_RULES if r[k]} for r in found} == EDUCATION


PROJECTS = {
    "• Store Portal:": {"is_bullet_head", "promote", "is_title"},
    "1. Store Portal": {"is_title"},
    "Project 3: Store": {"is_numbered", "promote", "is_title"},
    "Store (GitHub Link)": {"is_link_title", "promote", "is_title"},
    "GitHub Link": {"is_metadata", "suppress"},
    "Store Portal Jan 2020": {"is_link_title", "promote", "is_title"},
    "Technologies Used: Java": {"is_metadata", "suppress"},
    "Example Pvt": {"is_metadata", "suppress"},
    "• Developed the store": {"is_description", "suppress", "is_continuation"},
    "• Store Portal - a shop": {"is_title"},
    "and the rest of it": {"is_continuation"},
    "Served 10k+ users": {"is_continuation"},
    "Store": set(),
}


def test_project_lines(spark):
    found = lr.proj_line_rules(lines(spark, list(PROJECTS))).collect()
    assert {r.text: {k for k in lr.PROJ_RULES if r[k]} for r in found} == PROJECTS


def test_null_and_empty_lines(spark):
    some = lines(spark, [None, "", "  "])
    assert lr.edu_line_rules(some).count() == lr.proj_line_rules(some).count() == 3
    assert lr.edu_line_rules(some.limit(0)).count() == 0
    styled = lr.edu_line_rules(some.withColumns({"font_median": F.lit(10.0), "is_bold": F.lit(True), "x0": F.lit(0.0)}), "font_median", "is_bold", "x0")
    assert not any(r.promoted for r in rp.edu_style_rhythm(styled).collect())


@pytest.mark.parametrize(
    ("text", "key"),
    [("WORK EXPERIENCE", "WORK EXPERIENCE"), ("Tools & Technologies", "TOOLS & TECHNOLOGIES"), ("Project", "PROJECT"), ("Project Alpha", None), ("My Profile", None), ("Key Achievements", "KEY ACHIEVEMENTS"), ("Education Details", "EDUCATION")],
)
def test_heading_dictionary(spark, text, key):
    assert hd.match_dictionary(lines(spark, [text])).first().key == key


def test_segments_are_labelled_on_head_lines_only(spark):
    segments = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 0, 1, 1), (1, 0, 1, 2, 2), (1, 0, 2, 3, 3), (1, 0, 0, 4, 4)], "doc_id long, page int, line_index int, seg_index int, line_run int")
    heads = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 0, 2)], "doc_id long, page int, line_index int")
    found = {r.seg_index: r.label for r in en.label_segments(segments, heads).collect()}
    assert found == {0: "B-ENTRY", 1: "I-ENTRY", 2: "O", 3: "B-ENTRY", 4: "O"}  # a line is claimed once


TOKEN = "doc_id long, page int, line_index int, token_index int, x0 double, x1 double, token string, bio_label string"


def tokens(spark, texts, label="B-NAME"):
    rows = [(1, 0, n, i, 50.0 * i, 50.0 * i + 20, w, label) for n, t in enumerate(texts) for i, w in enumerate(t.split(" "))]
    return spark.createDataFrame(rows, TOKEN)


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("Developed a portal", ["O", "O", "O"]),
        ("Built shop | Ann", ["O", "O", "O", "B-NAME"]),
        ("Languages English sql", ["B-NAME", "B-NAME", "O"]),
        ("Some words here Hobbies chess", ["O", "O", "O", "B-NAME", "B-NAME"]),
        ("Hobbies | python led", ["B-NAME", "O", "O", "O"]),
        ("Phone +91-9876543210 a@b.com", ["O", "B-PHONE", "B-EMAIL"]),
        ("github.com/x linkedin.com/in/y", ["B-GITHUB", "B-LINKEDIN"]),
    ],
)
def test_personal_safeguards(spark, line, labels):
    found = sorted((r.token_index, r.clean_label) for r in rp.personal_leaks(tokens(spark, [line])).collect())
    assert [x for _, x in found] == labels


def test_dates_open_and_close_phrases(spark):
    t = tokens(spark, ["2019 - Present Pune"], "O").withColumn("seg", F.lit("I-SEG"))
    close = t.withColumn("x0", F.when(F.col("token") == "Present", F.lit(75.0)).otherwise(F.col("x0")))
    found = [x for _, x in sorted((r.token_index, r.seg) for r in rp.seg_date_entity(close).collect())]
    assert found == ["I-SEG", "I-SEG", "I-SEG", "I-SEG"]
    year = tokens(spark, ["Engineer 2019 Pune"], "O").withColumn("seg", F.lit("I-SEG"))
    assert {r.token: r.seg for r in rp.seg_date_entity(year).collect()} == {"Engineer": "I-SEG", "2019": "I-SEG", "Pune": "B-SEG"}


def test_windows_cover_every_token_and_merge(spark):
    rows = [(d, 0, 0, i, float(i), "B-A" if i % 7 == 0 else "O") for d, n in ((1, 1), (2, 250), (3, 251), (4, 1000)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_index int, token_index int, x0 double, bio_label string")
    windowed = fd.overlap_windows(df)
    starts = {(r.doc_id, r.start, r.end) for r in windowed.select("doc_id", "start", "end").distinct().collect()}
    assert {x for x in starts if x[0] == 3} == {(3, 0, 250), (3, 150, 251)} and {x for x in starts if x[0] < 3} == {(1, 0, 1), (2, 0, 250)}
    merged = fd.merge_windows(windowed.withColumn("label", F.col("bio_label")))
    assert {(r.doc_id, r.token_index, r.label) for r in merged.collect()} == {(d, i, x) for d, _, _, i, _, x in rows}
