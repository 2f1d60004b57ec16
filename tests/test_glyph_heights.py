"""Lines of glyphs are told from their tops: only those are sorted, and the rows are those of all glyphs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave.operators import tokenise as tk

SF = "/root/testdata/sf0.001"
LINE = ["doc_id", "page", "line_index"]


@pytest.mark.parametrize("name", ["chars_to_lines", "dominant_font"])
def test_glyphs_are_counted_before_they_are_sorted(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" in plan[plan.rindex("Window [") :]


def test_lines_and_fonts_are_those_of_all_glyphs(spark):
    """Tops that are null, repeat, lie at the tolerance and beyond it, and drift on; null pages and ids."""
    tops = [None, None, 1.0, 1.0, 4.0, 7.0, 7.0, 10.5, -3.0, 3.5, 13.6, 10.5, 1.0]
    made = [(d, p, i, t, ["A", "B", None][(i * i + j) % 3], 8.0 + i % 3) for j, (d, p) in enumerate([(1, 0), (1, 1), (None, 0), (2, None)]) for i, t in enumerate(tops[j:])]
    glyphs = spark.createDataFrame(made, "doc_id long, page int, seq long, top double, fontname string, size double")
    rows = lambda df: sorted(map(str, df.collect()))
    whole, few = tk.chars_to_lines(glyphs), tk.chars_to_lines(tk.heights(glyphs))
    assert rows(few.groupBy(LINE).agg(F.sum("n").alias("n"), F.min("top").alias("top"))) == rows(whole.groupBy(LINE).agg(F.count("*").alias("n"), F.min("top").alias("top")))
    assert rows(tk.dominant_font(tk.chars_to_lines(tk.heights(glyphs, "fontname", "size")), LINE, "n")) == rows(tk.dominant_font(whole, LINE))
