"""Samples that arrive as files: a stream whose batches go through a batch function.

Rows that a batch repeats, or that arrive again within the watermark, are dropped by
their index; every batch is written under its id, so a replayed batch overwrites
itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import SAMPLES


def sample_stream(spark: SparkSession, path: str, schema: str = SAMPLES, delay: str = "1 hour") -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(path)
    return rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["index"])


def run_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    def one(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
