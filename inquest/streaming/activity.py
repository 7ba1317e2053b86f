"""Activity per entity and time window over a stream of events, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_activity(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Events per entity and window: entity_id, bucket_start, event_count. events: entity_id, at. State is dropped behind the watermark."""
    counted = events.withWatermark("at", late).groupBy("entity_id", F.window("at", f"{minutes} minutes"))
    return counted.agg(F.count(F.lit(1)).alias("event_count")).select("entity_id", F.col("window.start").alias("bucket_start"), "event_count")


def run_available(activity: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the finished windows of all data that is there, then stops; a restart goes on from the checkpoint."""
    return activity.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
