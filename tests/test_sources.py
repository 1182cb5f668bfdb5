"""Readers and writers of panel files, there and back."""

import gzip

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrow, panel

DAYS = [f"202401{d:02d}" for d in range(1, 31)]


def test_feather_by_date(spark, tmp_path):
    template = str(tmp_path / "{yyyy}" / "w_{mm}{dd}.feather")
    for k, day in enumerate(DAYS):
        if k == 11:
            continue  # one day is missing
        path = tmp_path / day[:4] / f"w_{day[4:]}.feather"
        path.parent.mkdir(exist_ok=True)
        table = pa.table({"sid": [f"s{j}" for j in range(k % 4 + 1)], "weight": pa.array([float(j + k) for j in range(k % 4 + 1)], pa.float32()), "other": [1] * (k % 4 + 1)})
        feather.write_feather(table if k % 2 else table.drop_columns(["weight"]), str(path), compression="zstd" if k % 3 else "uncompressed")
    got = arrow.read_arrow(spark, template, DAYS, "sid string, weight double")
    assert got.rdd.getNumPartitions() == 29
    want = {(f"s{j}", float(j + k) if k % 2 else None, day) for k, day in enumerate(DAYS) if k != 11 for j in range(k % 4 + 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert arrow.read_arrow(spark, template, ["20300101"], "sid string").count() == 0
    instruments = spark.createDataFrame([(5, "s0"), (6, "s1")], "ii long, sid string")
    weights = arrow.index_weights(spark, "file://" + template, DAYS, instruments)
    assert {tuple(r) for r in weights.collect()} == {(d, 5 + int(s[1:]), w) for s, w, d in want if w is not None and s in ("s0", "s1")}


def test_templated_text(spark, tmp_path):
    template = str(tmp_path / "{yyyy}{mm}" / "q{yyyy}{mm}{dd}.csv.gz")
    for k, day in enumerate(DAYS[:5]):
        path = tmp_path / day[:6] / f"q{day}.csv.gz"
        path.parent.mkdir(exist_ok=True)
        if k != 2:
            with gzip.open(path, "wt") as f:
                f.write("sid|close\n" + "".join(f"s{j}|{j + k}.5\n" for j in range(3)))
    got = panel.read_templated(spark, template, DAYS[:5], sep="|")
    assert {tuple(r) for r in got.collect()} == {(f"s{j}", f"{j + k}.5", d) for k, d in enumerate(DAYS[:5]) if k != 2 for j in range(3)}
    with pytest.raises(FileNotFoundError):
        panel.read_templated(spark, template, ["19990101"])
    one = panel.read_delimited(spark, str(tmp_path / "202401" / "q20240101.csv.gz"))
    cells = panel.lenient(one.withColumns({"bad": F.lit("x"), "flag": F.lit("true"), "n": F.lit("7")}), {"close": "double", "bad": "int", "flag": "boolean", "n": "bigint"})
    assert [tuple(r) for r in cells.orderBy("sid").collect()][0] == ("s0", 0.5, 0, True, 7)


def test_calendar_and_listing(spark, tmp_path):
    (tmp_path / "dates").write_text("20240102,x\n20240103\nnone\n20240105,1\n20240103\n")
    calendar = panel.trade_calendar(spark, str(tmp_path / "dates"))
    assert sorted(r.dt for r in calendar.collect()) == [20240102, 20240103, 20240105]
    rows = [(1, 20240101, None), (2, 20240103, 20240105), (3, 20240106, None), (4, 20240102, 20240102), (5, None, None), (6, 19000101, 20240103)]
    instruments = spark.createDataFrame(rows, "ii long, list int, delist int")
    for parts in (1, 2, 64):
        got = {tuple(r) for r in panel.listing(instruments, calendar, parts).collect()}
        assert got == {(20240102, 1), (20240103, 1), (20240105, 1), (20240103, 2), (20240102, 6)}
    plan = panel.listing(instruments, calendar)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert panel.listing(instruments, calendar.limit(0)).count() == 0


def test_positions_and_ranges(spark, tmp_path):
    signal = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (2, 1, -0.5), (2, 9, 1.0)], "dti int, ii long, value double")
    path = str(tmp_path / "pos")
    panel.write_positions(signal, path)
    known = spark.createDataFrame([(1,), (2,)], "ii long")
    assert {tuple(r) for r in panel.read_positions(spark, path, known).collect()} == {(1, 1, 0.5), (2, 1, -0.5)}
    stored = str(tmp_path / "panel")
    panel.write_range(signal, stored)
    panel.write_range(spark.createDataFrame([(2, 1, 7.0)], signal.schema), stored)
    assert {tuple(r) for r in spark.read.parquet(stored).select("dti", "ii", "value").collect()} == {(1, 1, 0.5), (1, 2, None), (2, 1, 7.0)}
