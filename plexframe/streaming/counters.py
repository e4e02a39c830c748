"""Running read counters over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream over the Parquet files of a folder, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(folder)


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` behind the watermark are ignored once a window is closed."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions that end after a pause of ``gap``."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs over what is there now and stops; exactly once with the same checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
