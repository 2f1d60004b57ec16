"""A training-data pipeline: quality rules, language, line dedup, near duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All stages but the last keep the columns of
``documents``. ``run`` applies them to the documents of ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import language_id, line_dedup, ngram_join, packing, quality
from docweave.llm.shared import bounded_batches, broadcast_if_few, cut, ensure_checkpoint_dir, hot_keys, join_hot, one_of_each, row_named, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail go. Null, empty and blank texts fail; rows that repeat are judged one by
    one; an empty table gives an empty result."""
    return quality.clean_documents(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go. Learns from the labelled documents that came this far.

    Null texts and those without a letter go; without any labelled text every document goes; rows that repeat get
    equal answers; an empty table gives an empty result."""
    bounded_batches(spark)
    model = language_id.fit(docs)
    identified = language_id.identify(docs, model)
    return identified.filter(F.col(identified.columns[-1]).getField("accepted")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, but for a few characters, an earlier line go; documents of which nothing is left go.

    Null, empty and blank texts have no lines and stay; rows are told apart by id and text, and of rows that agree in
    both one stays; an empty table gives an empty result."""
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, a row without id only where
    no row of the group has one. Rows are told apart by id and text; of rows that agree in both one stays.

    Null, empty and blank texts are near duplicates of nothing and all stay; an empty table gives an empty result."""
    bounded_batches(spark)
    docs = one_of_each(docs, "doc_id", "text")
    rows, classes = ngram_join.ngram_classes(docs, n=5, num=8, den=10)
    worded = classes.filter("n_shingles > 0")
    stays = worded.groupBy("component").agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "digest")).alias("first"))
    known = cut(worded.join(stays, "component").select("digest", F.col("first.first_doc").alias("first_doc"), (F.col("digest") == F.col("first.digest")).alias("stays")))
    placed = join_hot(rows, known, "digest", hot_keys(rows, "digest"))
    gone = broadcast_if_few(placed.filter(~F.col("stays") | ~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select(F.col("doc_id").alias("id"), F.col("digest").alias("gone")).distinct())
    keyed = row_named(docs, "row").select("row", ngram_join.text_digest(F.col("row.text")).alias("digest"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("gone"))
    return keyed.join(gone, same, "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left. A null or empty text is a piece without words; rows
    that repeat are packed one by one; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The language stage is not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
