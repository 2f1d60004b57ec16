"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family; ``TEST_ALL=1`` compares all.
SAMPLE = """build_record src_html_blocks slug_key split_comma split_date_range strip_cid glyphs_to_tokens attach_link build_lines sentence_records
personal_segments detect_gutter line_vector10 heading_decide heading_style_propagate section_propagate group_entries shift_heads date_roles seg_gap stamp_bio
bio_sanitise contact_classify extract_entities fold_fields skill_groups align_cascade align_line_jaccard nearest_head metric_prf section_scorecard
stream_sessions stream_dedupe stream_stuck_runs edu_line_rules proj_line_rules exp_boundary_fix proj_boundary_fix cluster_rows decode_constrained score_sequential
label_segments personal_leak_rules seg_date_entity edu_style_rhythm edu_block_rules proj_block_rules segment_vector19 token_vector20 block_vector12 overlap_windows""".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return plain(list(v.values()))
    return str(v)


def names():
    from docweave.plans import registry

    return sorted(registry.ORACLES) if os.environ.get("TEST_ALL") else SAMPLE


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in (x.asDict() for x in df.collect()))
    theirs = sorted([plain(dict(zip(found.columns, r, strict=True))[c]) for c in columns] for r in found.fetchall())
    assert ours == theirs


def test_plans_read_the_stage_table_only(spark):
    """Queries over the résumés start from the stage table: no plan renders it anew."""
    for name in ("align_cascade", "section_propagate", "heading_decide", "fold_fields", "sentence_records"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "o_orderkey" not in plan and "docweave_resume_tokens" in plan


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "doc_id"


def test_the_rest_imports_without_the_llm_subpackage():
    import ast
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in (root / "docweave").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                module = getattr(node, "module", None) or ""
                assert not module.startswith("docweave.llm") and not any(a.name.startswith("docweave.llm") for a in getattr(node, "names", []) if isinstance(node, ast.Import))
