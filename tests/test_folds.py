"""Folds and closed forms against naive loops on random sequences, and rule goldens."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import entries as en
from docweave.operators import fields as fd
from docweave.operators import headings as hd
from docweave.operators import tokenise as tk
from docweave.streaming import streams as st


def rows(seed, n, make):
    rnd = random.Random(seed)
    return [make(rnd, d, k) for d in range(n) for k in range(rnd.randint(1, 30))]


def test_bio_sanitise_equals_the_loop(spark):
    labels = ["O", "B-A", "I-A", "B-B", "I-B"]
    data = rows(1, 60, lambda r, d, k: (d, 0, k // 5, k % 5, float(k), r.choice(labels)))
    df = spark.createDataFrame(data, "doc_id long, page int, line_index int, token_index int, x0 double, bio_label string")
    expected, last = {}, {}
    for d, _, line, i, _, label in data:
        before, own = last.get(d, "O"), label[2:]
        expected[d, line, i] = "O" if label == "O" else ("I-" if before == own else "B-") + own
        last[d] = own or "O"
    assert {(r.doc_id, r.line_index, r.token_index): r.clean_label for r in fd.bio_sanitise(df).collect()} == expected


def test_exp_boundary_fix_equals_the_loop(spark):
    flags = ("begins", "inside", "hinted", *en.EXP_RULES)
    data = rows(2, 60, lambda r, d, k: (d, k // 9, k % 9, *(r.random() < p for p in (0.2, 0.8, 0.1, 0.1, 0.15, 0.8, 0.05, 0.1, 0.05, 0.7, 0.1))))
    df = spark.createDataFrame(data, "doc_id long, page int, line_index int, " + ", ".join(f"{f} boolean" for f in flags))
    expected, last = {}, {}
    for d, page, line, *values in data:
        x = dict(zip(flags, values, strict=True))
        if x["begins"]:
            now = x["hinted"] or not (x["is_description"] or not x["has_date"] or x["is_continuation"])
        elif x["hinted"] and (x["has_date"] or x["is_internship"] or x["is_sub_entry"] or (x["is_bullet"] and x["inside"])):
            now = True
        else:
            near = last.get(d, (None, 0))
            recent = near[0] == page and 1 <= line - near[1] <= 5
            now = x["inside"] and x["has_date"] and x["has_role"] and not (x["is_description"] or x["has_bar"] or recent)
        if now:
            last[d] = (page, line)
        expected[d, page, line] = now
    assert {(r.doc_id, r.page, r.line_index): r.is_head for r in en.exp_boundary_fix(df).collect()} == expected


def test_decode_never_leaves_an_orphan(spark):
    labels = ["O", "B-A", "I-A", "B-B", "I-B"]
    data = rows(3, 40, lambda r, d, k: (d, 0, k // 6, k % 6, [r.random() for _ in labels]))
    df = spark.createDataFrame(data, "doc_id long, page int, line_index int, token_index int, scores array<double>")
    last = {}
    for r in sorted(fd.decode_constrained(df, labels).collect(), key=lambda r: (r.doc_id, r.line_index, r.token_index)):
        before = last.get((r.doc_id, r.line_index), "O")
        assert not r.label.startswith("I-") or before[2:] == r.label[2:]
        last[r.doc_id, r.line_index] = r.label


@pytest.mark.parametrize(
    ("token", "parts"),
    [("2010-2014", ["2010", "-", "2014"]), ("Jan2020–Present", ["Jan2020", "–", "Present"]), ("10-20", ["10-20"]), ("A-B", ["A-B"])],
)
def test_date_ranges(spark, token, parts):
    assert spark.createDataFrame([(token,)], "t string").select(tk.date_range_parts(F.col("t"))).first()[0] == parts


@pytest.mark.parametrize(("text", "norm"), [("S K I L L S", "SKILLS"), ("## Work Experiance:", "WORK EXPERIENCE"), ("• Projects", "PROJECTS"), ("W O R K  E X P", "WORK EXP")])
def test_headings_are_normalised(spark, text, norm):
    assert spark.createDataFrame([(text,)], "t string").select(hd.normalise(F.col("t"))).first()[0] == norm


@pytest.mark.parametrize(("text", "dated"), [("( July'22 - March' 2023 )", True), ("July’22", True), ("Present )", True), ("Room 12", False), ("1234567", False)])
def test_dates_are_found(spark, text, dated):
    df = spark.createDataFrame([(1, 0, 0, text)], "doc_id long, page int, line_index int, text string")
    assert en.date_anchor(df).first().has_date == dated


def test_same_result_for_any_partitioning(spark):
    data = rows(4, 30, lambda r, d, k: (d, 0, k // 5, k % 5, float(k), r.choice(["O", "B-A", "I-A"])))
    df = spark.createDataFrame(data, "doc_id long, page int, line_index int, token_index int, x0 double, bio_label string")
    results = {tuple(sorted(tuple(r) for r in fd.bio_sanitise(df.repartition(n)).collect())) for n in (1, 4, 50)}
    assert len(results) == 1


def test_stuck_runs_are_reported(spark, tmp_path):
    events = [(i, f"2024-01-01 {h:02d}:00:00", u, "click", 1.0, "{}") for i, (u, h) in enumerate([(1, 0), (2, 0), (2, 1), (1, 1), (3, 12), (3, 20)])]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    for k, part in enumerate((df.filter("user_id < 3"), df.filter("user_id = 3 AND event_id = 4"), df.filter("event_id = 5"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = st.drained(st.stuck_runs(st.event_stream(spark, str(tmp_path / "in" / "*"))), str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset(provider)
    assert {(r.run_id, r.last_event.hour) for r in out} >= {(1, 1), (2, 1)}
