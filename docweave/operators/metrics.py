"""Evaluation against truth, scorecards and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.alignment import line_compare


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6))


def head_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: matches, misses, extras, precision, recall, F1 and heading accuracy (Jaccard in percent, 100 if both are empty)."""
    n = line_compare(truth, found).groupBy("doc_id").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("MATCH", "MISSED", "EXTRA")])
    hit, missed, extra = F.col("match"), F.col("missed"), F.col("extra")
    return n.select(
        "*",
        ratio(hit, hit + extra).alias("precision"),
        ratio(hit, hit + missed).alias("fba_recall"),
        ratio(2 * hit, 2 * hit + missed + extra).alias("fba_f1"),
        F.round(F.when(hit + missed + extra > 0, 100 * hit / (hit + missed + extra)).otherwise(100.0), 4).alias("fha"),
    )


def token_accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracy of labels on alphanumeric tokens (token, truth, found) of each document."""
    kept = pairs.filter(F.col("token").rlike("[A-Za-z0-9]"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("found")).cast("double")), 6).alias("accuracy"))


def label_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label; their mean is the macro F1."""
    hit = pairs.filter("truth = found").groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("hit"))
    t, f = pairs.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("t")), pairs.groupBy(F.col("found").alias("label")).agg(F.count("*").alias("f"))
    n = t.join(f, "label", "full_outer").join(hit, "label", "left").na.fill(0, ["t", "f", "hit"])
    return n.select("label", "t", "f", "hit", ratio(F.col("hit"), F.col("f")).alias("precision"), ratio(F.col("hit"), F.col("t")).alias("recall"), ratio(2 * F.col("hit"), F.col("t") + F.col("f")).alias("f1"))


def derive_boundary(labels: Column) -> Column:
    """Boundary truth from field labels: fields that open an entry begin one."""
    return F.when(labels.isin("B-ROLE", "B-INSTITUTION", "B-PROJECT_NAME"), "B-ENTRY").when(labels == "O", "O").otherwise("I-ENTRY")


def section_confidence(rows: DataFrame) -> DataFrame:
    """Mean of the positive confidences in percent, one decimal."""
    return rows.groupBy("section").agg(F.round(100 * F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 1).alias("confidence"))


def scorecard(stages: DataFrame) -> DataFrame:
    """Duration, memory and value per section, and one row over all (section null)."""
    return stages.rollup("section").agg(F.round(F.sum("duration"), 4).alias("duration"), F.round(F.max("memory"), 4).alias("memory"), F.count("*").alias("n"))


def health(value: Column, good: float, warn: float) -> Column:
    return F.when(value <= good, "good").when(value <= warn, "warn").otherwise("bad")
