"""Price files to the base panel, and dates as numbers."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.sources import daily


def test_base_from_files(spark, tmp_path):
    days = ["20240102", "20240103", "20240104"]
    head = "sid|name|open|close|high|low|vol|dvol|sector|ind|subind|sho|flo|pclose|adj|active|up|down|exch\n"
    files = {
        "p20240102.txt": head + "000001.SZ|PING|1|2|3|1|10|20|bank|b1||100|50|1.5|1|1|2.2|1.8|SZ\n600000.SH|*ST PU|5|x|6|4|0|0|steel|||200||5|bad|0|||SH\n999999.SH|unknown|1|1|1|1|1|1|a|b|c|1|1|1|1|1|1|1|SH\n",
        "p20240104.txt": head + "000001.SZ|PING|2|2.5|3|2|4|10|tech|b1|z|100|50|2|1|1|3|2|XX\n000300.SH|IDX|1|1|1|1|1|1||||1|1|1|1|1|1|1|SH\n",
        "i20240102.txt": "sid|open|close|high|low|vol|dvol\n000300.SH|10|11|12|9|5|50\n",
        "i20240104.txt": "sid|open|close|high|low|vol|dvol\n000300.SH|11|12|13|9|0|0\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    instruments = spark.createDataFrame([(0, "000001.SZ"), (1, "600000.SH"), (9, "000300.SH")], "ii long, sid string")
    listed = spark.createDataFrame([(int(d), i) for d in days for i in (0, 1)], "dt int, ii long")
    template = str(tmp_path / "{k}{yyyy}{mm}{dd}.txt")
    got = daily.base_from_files(spark, template.replace("{k}", "p"), template.replace("{k}", "i"), days, instruments, listed)
    rows = {(r.dti, r.ii): r for r in got.collect()}
    assert set(rows) == {(d, i) for d in range(3) for i in (0, 1, 9)}
    a, b, c, x = rows[0, 0], rows[0, 1], rows[2, 0], rows[2, 9]
    assert (a.close, a.vwap, a.cap, a.adj, a.st, a.exch, a.halt, a.univ_all, a.cty) == (2.0, 2.0, 150.0, 1.0, 0, 1, False, True, 1)
    assert (b.close, b.vwap, b.adj, b.st, b.halt, b.univ_all, b.sharesfloat, b.limit_up) == (None, 0.0, 1.0, 1, True, False, 0.0, None)
    # groups by first appearance: bank, then steel, then tech; the empty name is 0
    assert (a.sector, b.sector, c.sector, a.industry, b.industry, a.subindustry, c.subindustry) == (1, 2, 3, 1, 0, 0, 1)
    assert c.exch == -1
    gap = rows[1, 0]
    assert (gap.close, gap.vol, gap.sector, gap.st, gap.adj, gap.univ_all) == (None, 0.0, -1, -1, 1.0, True)
    assert (x.close, x.limit_up, x.limit_down, x.adj, x.univ_all, x.sector, x.vwap) == (12.0, 26.0, 0.0, 1.0, True, -1, 0.0) and rows[1, 9].univ_all is False
    closes = spark.createDataFrame([(2, 0, 2.0), (2, 9, 5.0)], "dti int, ii long, pclose double")
    odd = daily.wrong_adjustments(got.where("dti <> 1"), closes).collect()
    assert [(r.ii, r.found) for r in odd] == [(9, 2.2)]
    hidden = daily.in_sample(got, 2).where("dti = 2")
    assert hidden.count() == 3 and hidden.where("close is not null or halt is not null").count() == 0
    assert {tuple(r) for r in daily.empty_columns(got.select("dti", "ii", "close", "vol")).collect()} == {(1, "close")}


def test_date_numbers(spark):
    days = [date(2019, 12, 28) + timedelta(days=k) for k in range(0, 800, 3)]
    df = spark.createDataFrame([(int(d.strftime("%Y%m%d")),) for d in days], "d int")
    d = F.col("d")
    rows = df.select("d", dates.shifted(d, 1).alias("next"), dates.shifted(d, -1).alias("before"), dates.iso_week(d).alias("w"), dates.month_of(d).alias("m")).collect()
    for x, r in zip(days, rows):
        assert r.next == int((x + timedelta(days=1)).strftime("%Y%m%d")) and r.before == int((x - timedelta(days=1)).strftime("%Y%m%d"))
        assert tuple(r.w) == tuple(x.isocalendar())
        assert r.m.first == x.year * 10000 + x.month * 100 + 1 and r.m.last // 100 == r.m.first // 100
    times = spark.createDataFrame([(20240102, 930), (20240102, 93015), (20240102, 0)], "d int, t int")
    got = times.select(dates.combined(F.col("d"), F.col("t")).alias("c")).withColumn("s", dates.split_time(F.col("c"))).collect()
    assert [(r.c, tuple(r.s)) for r in got] == [(202401020930, (20240102, 930)), (20240102093015, (20240102, 93015)), (202401020000, (20240102, 0))]
    assert tuple(times.select(dates.split_time(F.col("d")).alias("s")).first().s) == (20240102, 0)
    assert times.limit(1).select(dates.hours(F.lit(2024022822), F.lit(2024022901)).alias("h")).first().h == [2024022822, 2024022823, 2024022900, 2024022901]
    assert times.limit(1).select(dates.shifted(F.lit(20240231), 1).alias("n")).first().n is None
