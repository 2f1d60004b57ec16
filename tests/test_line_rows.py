"""Lines told from the stage table are the lines that ``build_lines`` makes of their tokens."""

from docweave.operators.lines import build_lines
from docweave.sources import tables
from docweave.plans import registry

TEXTS = ["one", "  leading blanks", "trailing blanks  ", "W O R K  E X P", "a   b", "", " ", None, "• Ünïcode ß", "TAB\tIN ONE", "ALL CAPS", "• ", "   x", "4 2"]


def test_line_rows_are_built_lines(spark, monkeypatch):
    kinds = ["name", "bullet", "heading", "job", "contact", "school", "project", "skill", "degree"]
    docs = (1, 2, None)
    rows = [(d, n, t, "S", kinds[(n + (d or 0)) % len(kinds)]) for d in docs for n, t in enumerate(TEXTS * 3)]
    staged = spark.createDataFrame(rows, "doc_id long, line_no int, txt string, section string, kind string")
    monkeypatch.setattr(tables, "resume_lines", lambda spark, sf_dir: staged)
    want = build_lines(tables.resume_tokens(spark, ""), "section", "kind")
    got = tables.resume_line_rows(spark, "", "section", "kind")
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 33 * len(docs)
    assert tables.resume_line_rows(spark, "").columns == build_lines(tables.resume_tokens(spark, "")).columns


def test_plans_over_lines_part_no_tokens(spark):
    """Plans that need lines only do not part them into tokens."""
    for name in ("title_likeness", "heading_dictionary", "heading_report", "heading_outliers", "edu_style_rhythm", "nearest_head", "segment_vector19", "align_line_jaccard"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan, name
