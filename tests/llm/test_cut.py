"""A checkpoint leaves no shuffle files behind."""

import time

from pyspark.sql import functions as F

from docweave.llm.components import connected_components
from docweave.llm.shared import cut, hot_keys


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    out = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_"):
            out.add(name)
    return out


def test_shuffle_files_go_with_the_checkpoint(spark):
    before = shuffle_files(spark)
    counted = cut(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 10  # Spark removes them behind the query's back
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert counted.agg(F.sum("n")).first()[0] == 10_000 and counted.filter("n = 100").count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_shuffle_files_of_questions_go_too(spark):
    edges = cut(spark.range(3_000).select(F.col("id").alias("a"), (F.col("id") + F.col("id") % 2).alias("b")))
    before = shuffle_files(spark)
    labels = connected_components(edges)
    hot = hot_keys(cut(spark.range(30_000).select((F.col("id") % 7 % 3).alias("k"))), "k")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert labels.count() == 3_000 and labels.filter("label = node - 1").count() == 1_500 and labels.filter("label = node").count() == 1_500
    assert sorted(r.k for r in hot.collect()) == [0, 1, 2]
    assert hot_keys(cut(spark.range(900).select(F.lit(1).alias("k"))), "k") is None
