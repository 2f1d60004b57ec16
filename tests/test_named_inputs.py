"""Operators take tables whatever name their rows were given in a query before."""

import pytest

from docweave.operators import layout as lo

TOKENS = "doc_id long, page int, section string, line_index int, token_index int, token string, x0 double, x1 double, y0 double, y1 double"


def two_columns():
    rows = [(d, 0, s, line, 2 * line + k, "word", 100.0 * k, 100.0 * k + 60, 14.0 * line, 14.0 * line + 10) for d in (1, None) for s in ("TOOLS", None) for line in range(6) for k in (0, 1)]
    return [*rows, *rows[:3]]  # some rows come twice


@pytest.mark.parametrize("name", ["s", "z", "_step", "x"])
def test_named_tokens(spark, name):
    tokens = spark.createDataFrame(two_columns(), TOKENS)
    for run in (lo.detect_gutter, lo.order_reading):
        want, got = run(tokens), run(tokens.alias(name))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    gutters = lo.detect_gutter(tokens.alias(name)).collect()
    assert len(gutters) == 4 and all(g.has_gutter and g.gutter_x == 60 for g in gutters)
