"""Structured Streaming: event-time windows, and an index that follows changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.operators import maintain


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch, kept in state."""

    def step(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class Follower:
    """Keeps a table of files in step with batches of changes (path, hash, content; a null hash means gone). The table is a folder
    with one subfolder a batch and a pointer to the newest, so a reader never sees half a batch, and a batch that runs again
    replaces its own folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = "path string, hash string, content string"):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._pointer()
        root = path(self.folder)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def table(self, before: int | None = None) -> DataFrame:
        v = [x for x in self.versions() if before is None or x < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Of several changes to a path in a batch the last by its order column counts."""
        last = batch.groupBy("path").agg(F.max_by(F.struct("hash", "content"), "order").alias("x")).select("path", "x.hash", "x.content")
        old = self.table(before=epoch)
        touched = old.join(last.select("path"), "path", "left_semi")
        changes = maintain.diff(touched, last.where("hash is not null"))
        maintain.upsert(old, last.where("hash is not null"), changes).write.mode("overwrite").parquet(f"{self.folder}/v{epoch}")

    def start(self, changes: DataFrame, checkpoint: str, trigger: dict | None = None):
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
