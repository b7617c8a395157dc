"""Tables that grow: new files go through the same operators as streams, with the same results as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values by type and tumbling window, for batches and, with a watermark, for streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events that follow one another within the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), "user_id", "n")


def process_new_files(spark: SparkSession, source: str, schema, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> int:
    """Runs the operator over files that came since the last call and writes each micro-batch to a folder of its number.

    A batch that is repeated after a failure overwrites its own folder, so every file counts once.
    """
    batches = []

    def write(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{target}/batch={number}")
        batches.append(number)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
