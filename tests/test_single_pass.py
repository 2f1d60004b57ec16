"""Queries do not read the stage table again for what one pass tells, and gather texts without lambdas."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "reads"), [("segment_vector19", 1), ("segment_vector16", 1), ("fold_fields", 2)])  # entries joins its heads
def test_the_stage_table_is_not_read_again(spark, name, reads):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet spark_catalog.default.docweave_resume_tokens") == reads


@pytest.mark.parametrize("name", ["noise_filters", "exp_fill_company", "fold_fields"])
def test_texts_are_sorted_without_lambdas(spark, name):
    assert "array_sort" not in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_heads_meet_lines_that_were_made_once(spark):
    plan = entry.queries()["align_head_content"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "docweave_resume_known_lines" in plan and "Exchange hashpartitioning" not in plan


def test_blocks_are_sorted_once(spark):
    from docweave.operators.fields import split_blocks
    from docweave.sources.tables import resume_tokens

    plan = split_blocks(resume_tokens(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_medians_are_those_of_percentile(spark):
    from docweave.operators.lines import build_lines

    sizes = {0: [10.0], 1: [10.0, 13.0], 2: [9.0, 16.0, 11.0], 3: [None, 8.0, 9.5], 4: [None]}
    rows = [(1, 0, k, i, f"w{i}", 10.0 * i, 0.0, 10.0 * i + 5, 9.0, x, i == 0) for k, xs in sizes.items() for i, x in enumerate(xs)]
    tokens = spark.createDataFrame(rows, "doc_id long, page int, line_index int, token_index int, token string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean")
    found = {r.line_index: (r.font_median, r.text, r.n_tokens, r.is_bold) for r in build_lines(tokens).collect()}
    assert found == {0: (10.0, "w0", 1, True), 1: (11.5, "w0 w1", 2, True), 2: (11.0, "w0 w1 w2", 3, True), 3: (8.75, "w0 w1 w2", 3, True), 4: (None, "w0", 1, True)}


def test_companies_are_filled_in_one_window_over_the_blocks(spark):
    plan = entry.queries()["exp_fill_company"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Window [") == 4


def test_blocks_switch_with_labels_and_bounds(spark):
    """Random tokens against a loop: a B- label of another class than the block's first one opens a block, a bound forgets it."""
    import random

    from docweave.operators.fields import split_blocks

    rnd = random.Random(5)
    labels = ["O", "B-A", "I-A", "B-B", "B-B-A", "B-", "I-B", None]
    rows = [(d, 0, n // 6, n % 6, rnd.choice(["w", "|", "•", "(", "v", "u"]), 50.0 * (n % 6) + rnd.choice([0, 0, 45]), rnd.choice(labels)) for d in (1, 2, 3) for n in range(60)]
    tokens = spark.createDataFrame([(*r[:6], r[5] + 48.0, r[6]) for r in rows], "doc_id long, page int, line_index int, token_index int, token string, x0 double, x1 double, bio_label string")
    expected, block, first = {}, 0, None
    for k, (d, _, line, at, token, x0, label) in enumerate(rows):
        past = rows[k - 1] if k and rows[k - 1][0] == d else None
        block, first = (block, first) if past else (0, None)
        later = rows[k + 1][6] if k + 1 < len(rows) and rows[k + 1][0] == d else None
        bound = past is None or (token == "(" and (later or "O").endswith("-DATE")) or token in "|•" or past[4] in "|•" or past[2] != line or x0 - (past[5] + 48.0) > 40
        opens = label if label and label.startswith("B-") else None
        if bound or (opens and first and opens != first):
            block, first = block + 1, opens
        first = first or opens
        expected[d, line, at] = block
    assert {(r.doc_id, r.line_index, r.token_index): r.block for r in split_blocks(tokens).collect()} == expected
