"""Windows, sessions, repeats and retention on event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_of(spark: SparkSession, path: str, schema: StructType, time: str = "ts", files_per_trigger: int = 100) -> DataFrame:
    """A stream over Parquet files; time is cast to timestamp, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed(events: DataFrame, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts by window and keys; rows later than the watermark are dropped. Works on streams and tables alike."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Sessions of each key that end after a gap."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day", time: str = "ts") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_newest(events: DataFrame, path: str, keys: list[str], time: str, tie: str, keep: int, checkpoint: str) -> StreamingQuery:
    """Maintains the newest `keep` rows of each key as one Parquet table a batch (path/batch=N); the last one counts."""
    from tidemill.operators.latest import newest_per_key

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        newest_per_key(rows, keys, time, tie, keep).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
