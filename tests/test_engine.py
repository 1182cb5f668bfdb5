"""Small worked examples of the panel functions, and what the parser refuses."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chain, pnl
from tessera.plans.compile import evaluate
from tessera.plans.parse import parse


def panel(spark, rows):
    """rows: one list of values per date; g is 0 for the first three instruments, then 1."""
    cells = [(d, i, None if v is None else float(v), 0 if i < 3 else 1, True) for d, row in enumerate(rows) for i, v in enumerate(row)]
    return spark.createDataFrame(cells, "dti int, ii int, x double, g int, univ boolean")


def grid(df, column="value"):
    out = {}
    for r in df.collect():
        out.setdefault(r.dti, {})[r.ii] = None if r[column] is None else round(r[column], 6)
    return [[row[i] for i in sorted(row)] for _, row in sorted(out.items())]


def test_across_a_date(spark):
    p = panel(spark, [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]])
    assert grid(evaluate(p, "(rank x)")) == [[0, 0.25, 0.5, 0.75, 1]] * 2
    assert grid(evaluate(p, "(demean x)")) == [[-2, -1, 0, 1, 2]] * 2
    assert grid(evaluate(p, "(g_demean x g)")) == [[-1, 0, 1, -0.5, 0.5]] * 2
    assert grid(evaluate(p, "(scale x 20)"))[0] == [0, 2, 4, 6, 8]
    assert grid(evaluate(panel(spark, [[3, None, None, None, None]]), "(rank x)")) == [[0.5, None, None, None, None]]
    assert grid(evaluate(panel(spark, [[1, 1, 2, float("inf"), float("nan")]]), "(rank x)")) == [[0.25, 0.25, 1, None, None]]


def test_hedge(spark):
    p = panel(spark, [[0, 1, 2, -3, -4, -5]]).withColumn("value", F.col("x"))
    assert grid(chain.apply_chain(p, "hedge:0,5")) == [[0, 1, 2, 0, 0, -3]]


def test_bounded_by_traded_value(spark):
    rows = [(0, i, x, d) for i, (x, d) in enumerate([(5.0, 0.2), (3.0, 0.35), (2.0, 0.3), (-1.0, 9.0), (None, 1.0)])]
    p = spark.createDataFrame(rows, "dti int, ii int, value double, d double")
    # 0.3 is cut off: the second and third rise by 0.05 together, then the third takes the least of its room and what is left
    assert grid(chain.apply_chain(p, "bounddvol:d,1,1")) == [[0.2, 0.35, 0.35, 0, None]]
    assert grid(chain.apply_chain(p.withColumn("d", F.lit(None).cast("double")), "bounddvol:d,1,1")) == [[0.5, 0.3, 0.2, 0, None]]
    assert chain.apply_chain(p.limit(0), "bounddvol:d,1,1").count() == 0


def test_quota_of_shorts(spark):
    days = [[-4000.0, -1000.0, -50.0, 10.0, None], [-4000.0, -1000.0, -50.0, 10.0, 7.0]]
    rows = [(d, i, v, 10.0 if i != 1 else None, None if i == 2 else 50.0) for d, day in enumerate(days) for i, v in enumerate(day)]
    p = spark.createDataFrame(rows, "dti int, ii int, value double, price double, member double")
    # book of 100000, two percent lent: 1000 by weight, a lot of 100 shares of 10; without a price a short stays
    assert grid(chain.apply_chain(p, "rzrq:price,price,member,100000,0.02,0,4")) == [days[0], [-1000, -1000, 0, 10, 1990]]
    assert chain.apply_chain(p.limit(0), "rzrq:price,price,member,1,1,0,4").count() == 0


def matched(sig, member, factors, steps):
    """Cell by cell: weights led towards the exposures of ``member``."""
    whole = sum(v for v in sig if v and v > 0)
    w = [v / whole if v and v > 0 else None for v in sig]
    forms = []
    for f in factors:
        have = [v for v in f if v is not None]
        mean, rms = sum(have) / len(have), (sum(v * v for v in have) / len(have)) ** 0.5
        z = [None if v is None else (v - mean) / rms for v in f]
        pairs = [(m, v) for m, v in zip(member, z) if m is not None and v is not None]
        forms.append((z, sum(m * v for m, v in pairs) / sum(m for m, _ in pairs)))
    for _ in range(steps):
        moves = [0.0] * len(w)
        for z, t in forms:
            own = [i for i, v in enumerate(w) if v is not None and z[i] is not None]
            total, zs, zz = sum(w[i] for i in own), sum(z[i] for i in own), sum(z[i] ** 2 for i in own)
            lam = (sum(w[i] * z[i] for i in own) / total - t) / (t * zs - zz) / 40
            for i in own:
                moves[i] += (w[i] / total + lam * z[i]) / (1 + lam * zs) - w[i]
        w = [None if v is None or v + m / len(forms) <= 0 else v + m / len(forms) for v, m in zip(w, moves)]
    return [None if v is None else round(v, 6) for v in w]


def test_matched_exposures(spark):
    sig, member = [3.0, 2.0, 4.0, 1.0, -1.0, None, 2.0], [1.0, None, 2.0, 1.0, 3.0, 1.0, 0.5]
    factors = [[0.5, 1.0, 2.0, None, 1.5, 0.2, 3.0], [2.0, 1.0, 1.0, 0.5, None, 4.0, 2.5]]
    rows = [(0, i, *r) for i, r in enumerate(zip(sig, member, *factors))]
    p = spark.createDataFrame(rows, "dti int, ii int, value double, m double, a double, b double")
    assert grid(chain.apply_chain(p, "risk:m,a,b")) == [matched(sig, member, factors, chain.MATCHING)]
    assert grid(chain.apply_chain(p.withColumn("value", F.lit(None).cast("double")), "risk:m,a")) == [[None] * 7]
    assert chain.apply_chain(p.limit(0), "risk:m,a").count() == 0
    with pytest.raises(ValueError):
        chain.apply_chain(p, "risk:m")


def test_gaps(spark):
    short, long = [[1], *[[None]] * 60, [62]], [[1], *[[None]] * 61, [63]]
    assert grid(evaluate(panel(spark, short), "(ts_mean x 62)"))[-1] == [31.5]
    assert grid(evaluate(panel(spark, long), "(ts_mean x 70)"))[-1] == [63]
    assert grid(evaluate(panel(spark, long), "(ts_mean_raw x 70)"))[-1] == [32]
    assert grid(evaluate(panel(spark, short), "(ts_delay x 1)"))[-1] == [61]


def test_decay(spark):
    p = panel(spark, [[1], [2], [None], [4], [8]]).withColumn("value", F.col("x"))
    assert grid(chain.apply_chain(p, "expdecay:0.5")) == [[1], [1.5], [None], [4], [6]]
    assert grid(chain.apply_chain(p, "sexpdecay:0.5")) == [[1], [1.5], [None], [3.125], [5.5625]]
    assert grid(chain.apply_chain(panel(spark, [[6, 2, 1, 1, -3]]).withColumn("value", F.col("x")), "boundsize:0.4")) == [[4, 3, 1.5, 1.5, -3]]


def test_delay_of_profits(spark):
    p = spark.createDataFrame([(0, 1, 10.0, 0.5), (1, 1, 20.0, 0.1), (2, 1, None, -0.2)], "dti int, ii int, value double, ret double")
    assert [round(r.gross, 9) for r in pnl.daily(p).orderBy("dti").collect()] == [0, 1, -4]


def test_parse():
    assert str(parse("(let m (ts_mean x 5)); (rank (sub x m))")) == "(rank (sub x (ts_mean x 5)))"
    for bad in ("", "(rank x", ")", "(rank x) y", "()", "(let a x)"):
        with pytest.raises(ValueError):
            parse(bad)


def test_unknown(spark):
    p = panel(spark, [[1]])
    for bad in ("(nothing x)", "(ts_mean x)", "(rank x 1)", "nofield"):
        with pytest.raises(ValueError):
            evaluate(p, bad)
    with pytest.raises(ValueError):
        chain.apply_chain(p.withColumn("value", F.col("x")), "nothing:1")


def test_only_equal_values_share_a_rank(spark):
    p = panel(spark, [[1, 1 + 1e-7, 2, 2, 3]]).withColumn("value", F.col("x"))
    assert grid(evaluate(p, "(rank x)")) == grid(chain.apply_chain(p, "rank")) == [[0, 0.25, 0.625, 0.625, 1]]
    assert grid(evaluate(p, "(g_rank x g)")) == [[0, 0.5, 1, 0, 1]]
    assert grid(chain.apply_chain(p, "rank|add:-0.5|multiply:8")) == [[-4, -2, 1, 1, 4]]
    assert grid(evaluate(p, "(rank_near x 0.000001)")) == grid(chain.apply_chain(p, "rank:1e-6")) == [[0.125, 0.125, 0.625, 0.625, 1]]
    assert grid(evaluate(p, "(g_rank_near x 0.000001 g)")) == [[0.25, 0.25, 1, 0, 1]]


def test_doubles_round_as_in_the_sql(spark):
    import duckdb

    from tessera.plans.catalog import _shown

    halves = [0.159375, 0.528125, -0.271875, 0.5, 0.000005, 1234567.000015]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in halves], "x double").select(_shown(F.col("x"))).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5) + 0.0", [v]).fetchall()[0][0] for v in halves]
