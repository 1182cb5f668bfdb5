"""Stateful streams, stopped and started again in the middle, against the same over whole tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import market
from tessera.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, live.STORE)
    yield
    spark.conf.set(name, old)


def run(stream, path, state):
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    query.stop()


def test_bars_of_open_days(spark, store, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 12").select(F.col("user_id").alias("ii"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 3).alias("price"), (F.col("event_id") % 7 + 1).cast("double").alias("vol"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    bucket = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int")
    stream = lambda: live.live_bars(spark.readStream.schema(events.schema).parquet(source), 30, 47)
    events.where(F.col("ts") < middle).coalesce(1).write.mode("append").parquet(source)
    run(stream(), out, state)
    events.where(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(source)
    run(stream(), out, state)
    # the watermark passes the last day's end
    spark.createDataFrame([(10**9, last.replace(year=last.year + 1), 0, 1.0, 1.0), (None, None, 1, 1.0, 1.0)], events.schema).coalesce(1).write.mode("append").parquet(source)
    run(stream(), out, state)
    got = spark.read.schema(live.BAR).parquet(out)
    ticks = events.select("ii", day.alias("dti"), bucket.alias("ti"), F.struct("ts", "event_id").alias("at"), "price", "vol")
    want = market.intraday_bars(ticks)
    names = ["ii", "dti", "ti", "last", "high", "low", "vol", "dvol", "cumvol", "cumdvol"]
    both = want.select(*names).join(got.select(*(F.col(c).alias(f"s_{c}") if c not in names[:3] else F.col(c) for c in names)), names[:3], "left")
    near = lambda c: F.abs(F.col(c) - F.col(f"s_{c}")) < 1e-6
    same = near("last") & near("vol") & near("dvol") & near("cumvol") & near("cumdvol") & (near("high") & near("low") | F.col("high").isNull() & (F.col("s_high").isNull() | F.isnan("s_high")))
    assert both.where(~F.coalesce(same, F.lit(False))).count() == 0
    assert got.count() == got.select("ii", "dti", "ti").distinct().count()
    # what goes on beyond the last tick of a day has its price and no volume
    after = got.join(want.groupBy("ii", "dti").agg(F.max("ti").alias("end"), F.max_by("last", "ti").alias("stays")), ["ii", "dti"]).where("ti > end")
    assert after.count() > 0 and after.where("vol <> 0 or abs(last - stays) > 1e-6").count() == 0
    assert got.groupBy("ii", "dti").agg(F.max("ti").alias("end")).where("end <> 47").count() == 0


def test_universe_day_by_day(spark, store, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(d, i, (d * 7 + i * 3) % 11 > 1, (d * d + i * 5) % 4 == 0 or d < 4) for d in range(40) for i in range(6)]
    days = spark.createDataFrame(rows, "dti int, ii long, univ_all boolean, candidate boolean")
    stream = lambda: live.live_universe(spark.readStream.schema(days.schema).parquet(source), 6, 40.0, 3)
    for a, b in ((0, 13), (13, 14), (14, 40)):
        days.where(f"dti >= {a} and dti < {b}").coalesce(1).write.mode("append").parquet(source)
        run(stream(), out, state)
    got = {(r.dti, r.ii): (r.passed, r.in_univ) for r in spark.read.schema(live.MEMBER).parquet(out).collect()}
    want = {}
    for i in range(6):
        past, last = [], None
        for d in range(40):
            _, _, parent, candidate = rows[d * 6 + i]
            past.append(candidate)
            passed = parent and sum(past[-6:]) / min(len(past), 6) * 100 >= 40
            last = d if passed else last
            want[d, i] = passed, parent and last is not None and d - last <= 3
    assert got == want and {x for p in want.values() for x in p} == {True, False}
