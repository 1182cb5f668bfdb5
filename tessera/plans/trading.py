"""Registered queries over positions that carry on: trading limits and quotas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import carry, chain
from ..sources.panel import supplier_quotes
from . import catalog as base
from .more import QUOTES

FOUND: dict = {}

#: Of the close before, how far the limits are; what a quota lends of the shares.
REACH, LENT = 0.4, 0.002
#: Factors of the shorts: grid, similarity and step.
GRID = (0.05, 1.05, 0.9, 0.02)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with a signal that falls with the price, limits around the close before, and halts where nothing was traded."""
    before = F.lag("close").over(Window.partitionBy("ii").orderBy("dti"))
    df = supplier_quotes(spark, sf_dir).withColumn("halt", F.coalesce(F.col("vol"), F.lit(0.0)) <= 0)
    df = df.withColumn("limit_up", before * (1 + REACH)).withColumn("limit_down", before * (1 - REACH))
    return df.withColumn("value", (1500 - F.col("close")) / 1000)


LIMITS = f"""{QUOTES}, marks AS (SELECT dti, ii, close, vol, shares, (1500 - close) / 1000 AS s, coalesce(vol, 0) <= 0 AS halt, lag(close) OVER o * {1 + REACH}::DOUBLE AS up, lag(close) OVER o * {1 - REACH}::DOUBLE AS down,
        last_value(close IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS c, dense_rank() OVER (ORDER BY dti) AS k FROM quotes WINDOW o AS (PARTITION BY ii ORDER BY dti))"""


def _limit_sql(locked: str, booksize: float) -> str:
    """The book day by day: each step holds one date of all instruments."""
    scale = f"{booksize / carry.SHOWN!r}::DOUBLE"
    return f"""WITH RECURSIVE {LIMITS}, p AS (SELECT k, dti, ii, s, c, coalesce({locked}, false) AS lock FROM marks),
    r AS (SELECT CAST(0 AS BIGINT) AS k, ii, NULL::DOUBLE AS v, NULL::DOUBLE AS c FROM (SELECT DISTINCT ii FROM p)
        UNION ALL
        SELECT k, ii, CASE WHEN lock THEN h WHEN s > 0 AND pos > 0 THEN s * pos WHEN s < 0 AND neg <> 0 THEN s * neg ELSE s END, c FROM (
            SELECT *, ({carry.SHOWN} - coalesce(sum(h) FILTER (lock AND h > 0) OVER (), 0)) / nullif(sum(s) FILTER (NOT lock AND s > 0) OVER (), 0) AS pos,
                (-{carry.SHOWN} - coalesce(sum(h) FILTER (lock AND h < 0) OVER (), 0)) / nullif(sum(s) FILTER (NOT lock AND s < 0) OVER (), 0) AS neg
            FROM (SELECT p.*, CASE WHEN r.v IS NULL THEN 0 ELSE r.v / r.c END * p.c AS h FROM r JOIN p ON p.ii = r.ii AND p.k = r.k + 1)))
    SELECT p.dti, p.ii, round(round(r.v * {scale} / r.c / 100) * 100 * r.c / {scale}, 2) + 0.0 AS value FROM r JOIN p ON p.k = r.k AND p.ii = r.ii"""


def _weights_sql(locked: str) -> str:
    least, most, similarity, step = GRID
    width, n = most - least, 0
    while width >= step:
        width, n = width / 2, n + 1
    return f"""WITH RECURSIVE {LIMITS}, w AS (SELECT *, shares * {LENT}::DOUBLE AS quota, s / nullif(sum(-s) FILTER (s < 0) OVER (PARTITION BY dti), 0) AS v FROM marks),
    grid AS (SELECT {least}::DOUBLE + n * {width!r}::DOUBLE AS cap FROM (SELECT unnest(range(1, {2**n})) AS n)),
    fits AS (SELECT dti, cap FROM w JOIN grid ON true WHERE v < 0 AND quota > 0 GROUP BY dti, cap HAVING sum(least(cap * -v, quota)) > {similarity} * cap),
    caps AS (SELECT dti, coalesce((SELECT max(cap) FROM fits WHERE fits.dti = w.dti), least({least}, coalesce(sum(quota) FILTER (v < 0 AND quota > 0), 0))) AS cap FROM w GROUP BY dti),
    p AS (SELECT k, dti, ii, coalesce({locked}, false) AS lock, CASE WHEN v < 0 THEN CASE WHEN quota > 0 THEN greatest(v * cap, -quota) ELSE 0 END ELSE v END AS v
        FROM (SELECT w.*, lag(close) OVER o AS c1, lag(up) OVER o AS up1, lag(down) OVER o AS down1, cap FROM w JOIN caps USING (dti) WINDOW o AS (PARTITION BY ii ORDER BY dti))),
    r AS (SELECT CAST(0 AS BIGINT) AS k, ii, NULL::DOUBLE AS v FROM (SELECT DISTINCT ii FROM p)
        UNION ALL
        SELECT k, ii, CASE WHEN lock THEN h WHEN v > 0 AND rest >= 0 THEN v * rest / total ELSE v END FROM (
            SELECT *, -(coalesce(sum(h) FILTER (lock) OVER (), 0) + coalesce(sum(v) FILTER (NOT lock AND v < 0) OVER (), 0)) AS rest, nullif(sum(v) FILTER (NOT lock AND v > 0) OVER (), 0) AS total
            FROM (SELECT p.*, coalesce(r.v, 0) AS h FROM r JOIN p ON p.ii = r.ii AND p.k = r.k + 1)))
    SELECT p.dti, p.ii, round(r.v, {base.PLACES}) + 0.0 AS value FROM r JOIN p ON p.k = r.k AND p.ii = r.ii"""


def _limits(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = signals(spark, sf_dir).withColumn("limit_up_flag", F.col("close") >= F.col("limit_up")).withColumn("limit_down_flag", F.col("close") <= F.col("limit_down"))
        out = chain.apply_chain(df.withColumn("price", F.col("close")), text)
        return out.select("dti", "ii", (F.round("value", 2) + F.lit(0.0)).alias("value"))

    return run


def _weights(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = signals(spark, sf_dir).withColumn("quota", F.col("shares") * LENT)
        shorts = F.sum(F.when(F.col("value") < 0, -F.col("value"))).over(Window.partitionBy("dti"))
        df = df.withColumn("value", F.col("value") / F.when(shorts > 0, shorts))
        out = chain.apply_chain(df, f"{name}:quota," + ",".join(map(str, GRID)))
        return out.select("dti", "ii", (F.round("value", base.PLACES) + F.lit(0.0)).alias("value"))

    return run


FOUND |= {
    "op_limit": (_limits("limit"), _limit_sql("halt OR close >= up OR close <= down", 1e9)),
    "op_limitrd": (_limits("limitrd:50000000"), _limit_sql("halt OR c >= up OR c <= down", 5e7)),
    "op_limitadj": (_limits("limitadj"), _limit_sql("halt OR c >= up OR c <= down", 1e9)),
    "op_adjwt": (_weights("adjwt"), _weights_sql("halt")),
    "op_adjwtlimit": (_weights("adjwtlimit"), _weights_sql("halt OR c1 > up1 * 0.999 OR c1 < down1 * 1.001")),
}


def queries() -> dict:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
