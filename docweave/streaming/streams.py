"""The same operators under Structured Streaming: ingest, latest status, windows, sessions, de-duplication, stuck runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of events; ``path`` is a folder or a pattern."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_status(events: DataFrame) -> DataFrame:
    """Last event of each run. In update mode each batch gives the runs that changed, for ``upserted``; the state holds one
    row for each run."""
    return events.groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"), F.count("*").alias("events"))


def marked(events: DataFrame, late: str | None) -> DataFrame:
    return events if late is None else events.withWatermark("ts", late)


def stage_latency(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = "30 minutes") -> DataFrame:
    """Event counts and sums by window and type. In append mode a window is given once, when the watermark has passed its
    end; its state goes then, and rows that come later than the watermark are dropped. Without a watermark (``late`` None)
    every row counts, in update or complete mode; the state holds one row for each window and type."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = marked(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = "30 minutes") -> DataFrame:
    """Activity sessions of each user: ended by a pause. In append mode a session is given once, when the watermark has
    passed its end, and its state goes then. Without a watermark (``late`` None) every row counts, in complete mode; the
    state holds every session."""
    by = marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row for each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class StuckRuns(StatefulProcessor):
    """Reports a run that has had no event for some minutes of event time."""

    minutes = 360

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [pd.Timestamp(x) for x in [self.last.get()[0]]] if self.last.exists() else []
        for batch in rows:
            seen.append(batch["ts"].max())
        self.last.update((max(seen).to_pydatetime(),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(max(seen).timestamp() * 1000) + self.minutes * 60_000)
        yield pd.DataFrame({"run_id": pd.Series(dtype="int64"), "last_event": pd.Series(dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"run_id": [key[0]], "last_event": [pd.Timestamp(last)]})

    def close(self) -> None:
        pass


def stuck_runs(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(StuckRuns(), "run_id long, last_event timestamp", "Append", "EventTime")


def _batches(stream: DataFrame, structure: Callable[[DataFrame], DataFrame], out: str, mode: str = "append"):
    """Every micro-batch in a folder of its own, which it replaces when it runs again after a restart."""

    def batch(df: DataFrame, batch_id: int) -> None:
        structure(df).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()


def ingest(stream: DataFrame, structure: Callable[[DataFrame], DataFrame], out: str):
    """Structures every micro-batch of new documents with a batch function; the results are Parquet, by batch."""
    return _batches(stream, structure, out)


def upserted(stream: DataFrame, keys: list[str], out: str):
    """Runs an update-mode stream into a table of one row for each key: every batch writes a new version, the last one's
    rows with the batch's rows in the place of those that share their keys. A batch that runs again after a restart
    replaces its version; the version before the last one is kept for that, older ones go."""
    spark, schema = stream.sparkSession, stream.schema
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        rows = df
        if batch_id:
            last = spark.read.schema(schema).parquet(f"{out}/version-{batch_id - 1}")
            new = df.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])  # a null key is a key
            rows = df.unionByName(last.join(new, same, "left_anti"))
        rows.write.mode("overwrite").parquet(f"{out}/version-{batch_id}")
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version-{batch_id - 2}"), True)
        df.unpersist()

    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()


def upserted_rows(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The table of ``upserted`` after all that is there."""
    spark, out = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    query = upserted(stream, keys, out)
    query.awaitTermination()
    done = [p["batchId"] for p in query.recentProgress if p["batchId"] >= 0]
    return spark.read.schema(stream.schema).parquet(f"{out}/version-{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Parquet files of ``folder`` and reads them: all batches in append mode,
    the last one in complete mode, which keeps all state and suits small results only."""
    spark, out = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    query = _batches(stream, lambda df: df, out, mode)
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["batchId"] >= 0]
    where = f"{out}/batch_id={progress[-1]['batchId']}" if mode == "complete" and progress else out
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(where)
