"""Streamed bars against the same bars of the whole table."""

from pyspark.sql import functions as F

from tessera.operators import pnl
from tessera.streaming.bars import stream_bars, write_bars

EVENTS = "event_id long, ts timestamp, user_id long, value double"


def feed(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, at string, user_id long, value double")
    df.select("event_id", F.to_timestamp("at").alias("ts"), "user_id", "value").coalesce(1).write.mode("append").parquet(folder)


def test_bars(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    bars = lambda: stream_bars(spark.readStream.schema(EVENTS).parquet(source))
    day = "2024-01-01 "
    feed(spark, source, [(1, day + "00:01:00", 7, 2.0), (2, day + "00:04:00", 7, 1.0), (3, day + "00:04:00", 7, 5.0), (4, day + "00:06:00", 7, None), (5, None, 7, 9.0), (6, day + "00:03:00", None, 4.0)])
    assert write_bars(bars(), out, state, once=True).awaitTermination(120)
    # 01:00 closes both buckets of 7; 00:02 still comes in time, as the watermark stands at 23:56 until now
    feed(spark, source, [(7, day + "00:02:00", 7, 0.5), (8, day + "01:00:00", 7, 3.0)])
    assert write_bars(bars(), out, state, once=True).awaitTermination(120)
    # too late: its bucket is closed
    feed(spark, source, [(9, day + "00:02:30", 7, -8.0)])
    assert write_bars(bars(), out, state, once=True).awaitTermination(120)
    columns = ("user_id", "bucket", "last", "high", "low", "total", "n")
    got = {tuple(r) for r in spark.read.parquet(out).select(*columns).collect()}
    table = spark.read.parquet(source).where("event_id < 8 and ts is not null")
    assert got == {tuple(r) for r in pnl.bars(table).select(*columns).collect()}
    assert len(got) == 3
