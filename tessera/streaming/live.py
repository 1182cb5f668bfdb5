"""Stateful streams: bars of an open day that carry the last price on, and a universe that members leave late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Seconds of a day.
DAY = 86400
#: What stateful operators with timers keep their state in.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BAR = "ii long, dti int, ti int, last double, high double, low double, vol double, dvol double, cumvol double, cumdvol double"


class LiveBars(StatefulProcessor):
    """Emits each bucket of an instrument's day once the watermark has passed its end, from the first with a tick to the last of the day.

    State per instrument: the open buckets with ticks, and where the day stands.  A timer
    waits for the end of the next bucket, whether or not ticks come for it.
    """

    def __init__(self, seconds: int, last_bucket: int):
        self.seconds, self.last_bucket = seconds, last_bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket long", "at long, id long, last double, high double, low double, vol double, dvol double")
        self.stands = handle.getValueState("stands", "next long, day long, last double, cumvol double, cumdvol double, timer long")

    def ends(self, bucket: int) -> int:
        return (bucket + 1) * self.seconds * 1000

    def wait(self, bucket: int, old: int | None) -> int:
        """Sets the one timer to the end of a bucket."""
        due = self.ends(bucket)
        if old is not None and old != due and old >= 0:
            self.handle.deleteTimer(old)
        if old != due:
            self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            for at, number, price, vol in zip(batch["at"], batch["event_id"], batch["price"], batch["vol"]):
                bucket = int(at) // (self.seconds * 1_000_000)
                new = (int(at), int(number), float(price), float(price), float(price), float(vol), float(price) * float(vol))
                if self.open.containsKey((bucket,)):
                    old = self.open.getValue((bucket,))
                    late = (old[0], old[1]) > new[:2]
                    new = (*((old[0], old[1], old[2]) if late else new[:3]), max(old[3], new[3]), min(old[4], new[4]), old[5] + new[5], old[6] + new[6])
                self.open.updateValue((bucket,), new)
                earliest = bucket if earliest is None else min(earliest, bucket)
        if earliest is not None:
            now = self.stands.get() if self.stands.exists() else None
            if now is None:
                self.stands.update((earliest, -1, None, 0.0, 0.0, self.wait(earliest, None)))
            elif earliest < now[0]:
                self.stands.update((earliest, *now[1:5], self.wait(earliest, now[5])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        bucket, day, last, cumvol, cumdvol, _ = self.stands.get()
        per_day = DAY // self.seconds
        waiting = sorted(k[0] for k, _ in self.open.iterator())
        while bucket is not None and self.ends(bucket) <= due:
            if bucket // per_day != day:
                day, last, cumvol, cumdvol = bucket // per_day, None, 0.0, 0.0
            high = low = None
            vol = dvol = 0.0
            if waiting and waiting[0] == bucket:
                _, _, last, high, low, vol, dvol = self.open.getValue((bucket,))
                self.open.removeKey((waiting.pop(0),))
            cumvol, cumdvol = cumvol + vol, cumdvol + dvol
            out.append((key[0], day, bucket % per_day, last, high, low, vol, dvol, cumvol, cumdvol))
            bucket = bucket + 1 if bucket % per_day < self.last_bucket else waiting[0] if waiting else None
        if bucket is None:
            self.stands.clear()
        else:
            self.handle.registerTimer(self.ends(bucket))
            self.stands.update((bucket, day, last, cumvol, cumdvol, self.ends(bucket)))
        names = [c.split()[0] for c in BAR.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        return iter([frame.astype({c: "float64" for c in names[3:]})])

    def close(self) -> None:
        pass


def live_bars(ticks: DataFrame, minutes: int, last_bucket: int, late: str = "10 minutes") -> DataFrame:
    """Bars (ii, dti, ti, ...) of a stream of ticks (ii, ts, event_id, price, vol): those of market.intraday_bars, and each day goes on to ``last_bucket`` with the last price and no volume.

    dti counts days from 1970, ti buckets of the day (UTC).  Ticks without instrument,
    time or price are left out, as are those later than the watermark.  Needs the state store STORE.
    """
    seen = ticks.where("ii is not null and ts is not null and price is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = seen.select(F.col("ii").cast("long").alias("ii"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("price").cast("double").alias("price"), F.coalesce(F.col("vol").cast("double"), F.lit(0.0)).alias("vol"))
    return rows.groupBy("ii").transformWithStateInPandas(LiveBars(minutes * 60, last_bucket), StructType.fromDDL(BAR), "Append", "EventTime")


MEMBER = "dti int, ii long, passed boolean, in_univ boolean"


class Membership(StatefulProcessor):
    """A member passes by its rate of candidate days, and stays for some days after it last passed.

    State per instrument: how many of the last days it was a candidate on, day by day, and when it last passed.
    """

    def __init__(self, lookback: int, rate: float, sticky: int):
        self.lookback, self.rate, self.sticky = lookback, rate, sticky

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "candidate int")
        self.seen = handle.getValueState("seen", "days long, passed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        days, passed = self.seen.get() if self.seen.exists() else (0, None)
        out = []
        for dti, parent, candidate in pd.concat(list(rows)).sort_values("dti")[["dti", "univ_all", "candidate"]].itertuples(index=False):
            days += 1
            past = [*past, int(candidate)][-self.lookback :]
            good = bool(parent) and sum(past) / min(days, self.lookback) * 100 >= self.rate
            passed = days if good else passed
            out.append((int(dti), key[0], good, bool(parent) and passed is not None and days - passed <= self.sticky))
        self.past.put([(c,) for c in past])
        self.seen.update((days, passed))
        return iter([pd.DataFrame(out, columns=["dti", "ii", "passed", "in_univ"])])

    def close(self) -> None:
        pass


def live_universe(days: DataFrame, lookback: int, rate: float, sticky: int) -> DataFrame:
    """(dti, ii, passed, in_univ) of a stream of days (dti, ii, univ_all, candidate), as market.screened_universe has them.

    An instrument's days come in order, a row each; within one batch they may be mixed.
    """
    rows = days.select(F.col("ii").cast("long").alias("ii"), F.col("dti").cast("int").alias("dti"), F.coalesce("univ_all", F.lit(False)).alias("univ_all"), F.coalesce(F.col("candidate").cast("int"), F.lit(0)).alias("candidate"))
    return rows.groupBy("ii").transformWithStateInPandas(Membership(lookback, rate, sticky), StructType.fromDDL(MEMBER), "Append", "None")
