"""Continuous maintenance: file snapshots as a stream, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgraph.operators.relations import snapshot_diff

POLL_SECONDS = 5.0


def snapshot_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Snapshots of files(project_id, file_path, content_hash, snapshot), a Parquet file each, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Watch:
    """Applies each snapshot to a state table and keeps what it changed.

    A file source can't tell that a file is gone, so each batch is a whole snapshot and is compared with the state by a full outer join; the
    state is a Parquet table that is written anew under the batch's number, so that a repeated batch gives the same result.
    """

    KEYS = ("project_id", "file_path")

    def __init__(self, spark: SparkSession, folder: str, on_change: Callable[[DataFrame, int], None] | None = None) -> None:
        self.spark, self.folder, self.on_change = spark, folder.rstrip("/"), on_change

    def _state(self, batch: int) -> DataFrame:
        from corpusgraph.sources.files import table_or_empty

        schema = "project_id string, file_path string, content_hash string"
        return table_or_empty(self.spark, f"{self.folder}/state/batch={batch}", schema) if batch >= 0 else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        new = batch.select(*self.KEYS, "content_hash").dropDuplicates(list(self.KEYS))
        diff = snapshot_diff(self._state(number - 1), new)
        diff.where("status <> 'skipped'").write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        new.write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")
        if self.on_change is not None:
            self.on_change(diff, number)

    def changes(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/changes").parquet(f"{self.folder}/changes")

    def start(self, snapshots: DataFrame, once: bool = False, seconds: float = POLL_SECONDS) -> StreamingQuery:
        writer = snapshots.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type; works on a stream and on a table. Times without zone are read as UTC."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    counts = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
