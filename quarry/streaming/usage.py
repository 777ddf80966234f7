"""Live usage counters and incremental ingestion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import fresh_folder
from quarry.sources.keyed import KeyedTable, newest


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Events by hour and type; the watermark bounds the state, hours are final once it has passed them."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    ).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result, from the shared folder; for bounded inputs and tests.

    A micro-batch writes its own folder, so that one that runs again replaces it. With mode "complete" the last batch is the result, else all are.
    """
    spark, folder, epochs = stream.sparkSession, fresh_folder(stream.sparkSession, "stream"), []

    def write(batch: DataFrame, epoch: int) -> None:
        epochs.append(epoch)
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], stream.schema)
    parts = [max(epochs)] if mode == "complete" else sorted(set(epochs))
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/out/batch={e}" for e in parts))


def read_events(spark: SparkSession, path: str, glob: str | None = None, batches: int | None = None) -> DataFrame:
    """A stream over a table's files, with the schema that the table has now: 8 files a micro-batch.

    batches: the files that are there now make no more micro-batches than these, for folds whose keys have events in all files: each micro-batch steps all keys forward.
    """
    there = spark.read.parquet(path)
    files = max(8, math.ceil(len(there.inputFiles()) / batches)) if batches else 8
    return spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files).parquet(glob or path)


def upsert_stream(files: DataFrame, folder: str, checkpoint: str, build, key: str = "id"):
    """Upsert what `build` makes of each micro-batch (with a `version`) into a keyed table; `latest` reads it.

    A batch writes its own change file and nothing else; one that runs again replaces it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        KeyedTable(batch.sparkSession, folder, key).write(epoch, newest(build(batch), key))

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, key: str = "id") -> DataFrame | None:
    """The rows of a table of upsert_stream; None before the first batch."""
    return KeyedTable(spark, folder, key).read()


def ingest_stream(files: DataFrame, index_path: str, checkpoint: str, build):
    """Append what `build` makes of each micro-batch to an index; a batch writes its own folder, so that a batch that runs again replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{index_path}/batch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
