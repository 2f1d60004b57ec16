"""Helpers that several training-data operators use."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character list and as regular expressions.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RX = r"[\x20\x09-\x0D]"
WORD_RX = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Few rows in each Arrow batch: documents are long, and a Python worker holds whole batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where none is set and the master is local. On a
    cluster executors would not see such a folder, so that a missing setting is an error there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[.*])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
    elif where is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where or sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that begin here go as each one ends, not only when the driver collects garbage."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    found = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, found)


def tidied(run: Callable) -> Callable:
    """``run``, whose first argument is a table, with ``shuffles_removed`` for all jobs that it starts: counts and other
    questions about its tables shuffle as checkpoints do."""

    @wraps(run)
    def tidy(df: DataFrame, *args, **kwargs):
        with shuffles_removed(df.sparkSession):
            return run(df, *args, **kwargs)

    return tidy


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from the files; the shuffle files that led there go
    at once."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def row_named(docs: DataFrame, name: str) -> DataFrame:
    """Only one struct column ``name`` with the whole row, so that added columns clash with none of it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the table has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@tidied
def one_of_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group that agrees in id (null is a value) and text; texts without a word all stay."""
    keyed = row_named(docs, "row").select("row", F.col(f"row.`{id_col}`").alias("own_id"), text_key(F.col(f"row.`{text_col}`")).alias("own_text"))
    worded = keyed.filter(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).rlike(WORD_RX))
    repeated = cut(worded.groupBy("own_id", "own_text").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("own_id").alias("id"), F.col("own_text").alias("text")))
    if repeated.isEmpty():
        return docs
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_text") == F.col("text"))
    single = keyed.join(repeated, same, "left_anti")
    return single.union(keyed.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own_text"])).select("row.*")


BROADCAST_ROWS = 200_000  # of about 100 bytes: 20 MB


@tidied
def broadcast_if_few(rows: DataFrame) -> DataFrame:
    """``rows``, checkpointed, and marked for broadcast if there are at most ``BROADCAST_ROWS``: a join with it then leaves
    the other side, mostly texts, where it is. More rows are joined by a shuffle."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: A key is hot beyond so many rows, and beyond this share of all rows, so that at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 100_000


@tidied
def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys of ``rows`` (checkpointed) that too many rows share for one task: at most ``HOT_KEYS``; None without any."""
    total = rows.count()
    if total <= HOT_ROWS:
        return None
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(key))
    return None if hot.isEmpty() else hot


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows.join(table, key, how)`` for a table with one row for each key: the hot keys' rows stay where they are and
    meet a broadcast of at most ``HOT_KEYS`` rows, all others are joined by a shuffle."""
    if hot is None:
        return rows.join(table, key, how)
    few = F.broadcast(hot)
    here = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return here.unionByName(rows.join(few, key, "left_anti").join(table, key, how))


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text, which tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def train_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
