"""Tumbling bars of an unbounded stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bars(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Last, high, low, sum and count of each (user_id, bucket) of a stream (event_id, ts, user_id, value).

    State is one row per open bucket: a bucket closes when the watermark, the
    latest ``ts`` less ``late``, passes its end, and events that come after that
    are left out.  Repeated events count again; a null ``ts`` belongs to no bucket.
    """
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bucket = F.window("ts", f"{minutes} minutes")
    out = seen.groupBy("user_id", bucket).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("total"), F.count("*").alias("n"))
    return out.select("user_id", F.col("window.start").alias("bucket"), "last", "high", "low", "total", "n")


def write_bars(bars: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append closed bars to Parquet, exactly once per bar; ``once`` takes what has arrived and stops."""
    out = bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
