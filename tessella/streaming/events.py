"""Event streams: ingest, heartbeats and template memory, with batch forms that must agree."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch, ship

MEMORY = "user_id long, visits long, speaker_hits long, appearance_hits long, streak long"


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def heartbeat(events: DataFrame) -> DataFrame:
    """Running counters of each run; update or complete mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_id"), F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"))


heartbeat_batch = heartbeat


def windowed_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Event-time counts with a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def template_memory_batch(events: DataFrame) -> DataFrame:
    """Visits, hits and the streak of visits without a hit at the end, per key."""
    hit = F.col("event_type").isin("click", "purchase")
    last = F.max(F.when(hit, F.col("event_id"))).over(Window.partitionBy("user_id"))
    e = events.select("user_id", "event_id", "event_type").withColumn("_last", last)
    return e.groupBy("user_id").agg(F.count("*").alias("visits"), F.count_if(F.col("event_type") == "click").alias("speaker_hits"), F.count_if(F.col("event_type") == "purchase").alias("appearance_hits"), F.count_if(F.col("_last").isNull() | (F.col("event_id") > F.col("_last"))).alias("streak"))


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    visits, speakers, appearances, streak = state.get if state.exists else (0, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values("event_id")
    kinds = rows["event_type"]
    visits += len(rows)
    speakers += int((kinds == "click").sum())
    appearances += int((kinds == "purchase").sum())
    hits = kinds.isin(["click", "purchase"]).to_numpy().nonzero()[0]
    streak = len(rows) - 1 - int(hits[-1]) if len(hits) else streak + len(rows)
    state.update((visits, speakers, appearances, streak))
    yield pd.DataFrame({"user_id": [key[0]], "visits": [visits], "speaker_hits": [speakers], "appearance_hits": [appearances], "streak": [streak]})


def template_memory_stream(events: DataFrame) -> DataFrame:
    """template_memory_batch kept up to date on a stream whose files follow each other in id order."""
    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(_update, MEMORY, "visits long, speaker_hits long, appearance_hits long, streak long", "update", GroupStateTimeout.NoTimeout)


def settled(updates: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """What a stream has come to once all that is there has been read (trigger availableNow).

    Every micro-batch is written as a folder of its own in the shared folder, so a
    batch that is run again after a failure replaces itself; of each key the row of the
    last batch counts (complete mode: the last batch is everything).
    """
    spark = updates.sparkSession
    folder, schema = scratch(spark, "stream"), updates.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = updates.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema.simpleString()[7:-1].replace(":", " ") + ", batch long").parquet(f"{folder}/out")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    names = [f.name for f in schema if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(*keys, "s.*")


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a table, one file or a folder of them, as a stream."""
    # As a pattern, since a path that is a file can't be the base of a stream.
    return read_events(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path).schema)


STALLS = "user_id long, ticks long, stopped_at long"


class _Stalls(StatefulProcessor):
    """Ticks without progress in a row, and the event at which they first reached the limit."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stalls", "ticks long, stopped_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks, stopped = self.state.get() if self.state.exists() else (0, None)
        every = pd.concat(list(rows)).sort_values("event_id")
        for event, progress in zip(every["event_id"], every["progress"], strict=True):
            if stopped is None:
                ticks = 0 if progress else ticks + 1
                stopped = int(event) if ticks >= self.limit else None
        self.state.update((ticks, stopped))
        yield pd.DataFrame({"user_id": [key[0]], "ticks": [ticks], "stopped_at": pd.array([stopped], "Int64")})

    def close(self) -> None:
        pass


@contextmanager
def state_in_files(spark: SparkSession):
    """State of keyed processors is kept by RocksDB, which they need; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


def stalls_stream(events: DataFrame, progress, limit: int = 6) -> DataFrame:
    """(user_id, ticks, stopped_at) of each run: a watcher gives up after `limit` events without progress."""
    ship(events.sparkSession)
    rows = events.select("user_id", "event_id", progress.alias("progress")).groupBy("user_id")
    return rows.transformWithStateInPandas(statefulProcessor=_Stalls(limit), outputStructType=STALLS, outputMode="Update", timeMode="None")


def stalls_batch(events: DataFrame, progress, limit: int = 6) -> DataFrame:
    """The same over a table."""
    by_run = Window.partitionBy("user_id").orderBy("event_id")
    e = events.select("user_id", "event_id", progress.alias("p")).withColumn("island", F.sum(F.col("p").cast("int")).over(by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy("user_id", "island").orderBy("event_id")
    e = e.withColumn("ticks", F.sum((~F.col("p")).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = e.groupBy("user_id").agg(F.min(F.when(F.col("ticks") >= limit, F.col("event_id"))).alias("stopped_at"), F.max_by("ticks", "event_id").alias("last"))
    return end.select("user_id", F.when(F.col("stopped_at").isNotNull(), F.lit(limit)).otherwise(F.col("last")).cast("long").alias("ticks"), "stopped_at")
