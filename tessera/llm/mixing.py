"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered, prefix_sums
from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: A source with more than this share of the rows is joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE = 0.001


def level(sources: DataFrame, limit: int) -> float:
    """Words a unit of weight gets once no source is above ``limit`` times its size.

    Each round is one aggregation to a single row: sources found above their
    limit are set to it, and what is left is shared again.  The set of capped
    sources only grows, so it ends.
    """
    total, rate, capped = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("source_size") * limit < F.col("weight") * F.lit(rate)
        n, given, free = sources.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("source_size") * limit)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            return rate if free else float(total) * limit
        rate, capped = (total - given) / free, n


def targets(totals: DataFrame, weights: tuple[int, ...], limit: int, made: list[str]) -> DataFrame:
    """(src, whole, target, copies, rest) of sources (src, whole): whole passes over a source, and words of the next one."""
    sources = numbered(totals, "src", made)
    turn = (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")
    sources = cut(sources.select("src", F.col("whole").alias("source_size"), F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight")), made)
    rate = level(sources, limit)
    size, goal = F.col("source_size"), F.least(F.col("weight") * F.lit(rate), F.col("source_size").cast("double") * limit)
    copies = F.when(size > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0).cast("long")
    sources = sources.withColumn("target", goal).withColumn("copies", copies)
    return sources.select("src", size.alias("whole"), "target", "copies", (F.round("target").cast("long") - F.col("copies") * size).alias("rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, part) per row of ``docs`` (doc_id, text, source; others are not read).

    Sources in code-point order, null last, get the weights in turn; targets
    share all words by weight, at most ``limit`` times a source's size each.
    Within a source, rows are sorted by a hash of doc_id and text; prefix sums of their
    words place them, and the source's budget is cut there: ``copies`` whole
    passes, then the first ``part`` words of this row in the last pass.
    Null or blank texts have size 0 and are not taken.  Rows that repeat a
    doc_id are documents of their own; equal rows are interchangeable.  The
    columns ``carry`` of each row come along.  ``docs`` is read twice.

    Rows equal in id and text count together, so the sums are over groups of them, in
    ranges; a source's cut is one place in that order, and only the equal rows at
    that place need numbers of their own.  Rows meet their source by broadcast where it
    holds more than a share HOT_SHARE of the rows.
    """
    made: list[str] = []
    held = {f"_carry_{c}": F.col(c) for c in carry}
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    src = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    rows = docs.select(*(c.alias(n) for n, c in held.items()), "doc_id", size.alias("size"), src.alias("src"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("rank"))
    groups = rows.groupBy("src", "rank", "doc_id", "size").agg(F.count("*").alias("many"))
    words = F.col("size") * F.col("many")
    groups = cut(prefix_sums(groups, "src", words, ["rank", "doc_id", "size"], made, lambda totals: targets(totals, weights, limit, made)), made)
    first = F.min(F.when(F.col("before") + words > F.col("rest"), F.struct("rank", "doc_id", "size", "before", "many")))
    sources = cut(groups.groupBy("src").agg(F.first("whole").alias("source_size"), F.first("target").alias("target"), F.first("copies").alias("copies"), F.first("rest").alias("rest"), F.sum("many").alias("rows"), first.alias("at")), made)
    least = F.lit(HOT_SHARE * (sources.agg(F.sum("rows")).first()[0] or 0))
    hot, cold = F.broadcast(sources.where(F.col("rows") > least)), sources.where(F.col("rows") <= least)
    out = rows.join(hot, "src").unionByName(rows.join(hot, "src", "left_anti").join(cold, "src"))
    place, at = F.struct("rank", "doc_id", "size"), F.struct("at.rank", "at.doc_id", "at.size")
    left = F.col("rest") - F.col("at.before")
    among = place.eqNullSafe(at) & (F.col("at.many") > 1)
    part = F.when(F.col("at").isNull(), 0).when(place.eqNullSafe(at), left).when(place < at, F.col("size")).otherwise(0).cast("long")
    several = prefix_sums(out.where(among), "src", F.col("size"), [*held, "size"], made)
    several = several.withColumn("part", F.greatest(F.lit(0), F.least("size", left - F.col("before")))).drop("before", "whole")
    out = out.where(~F.coalesce(among, F.lit(False))).withColumn("part", part).unionByName(several)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), copies.alias("copies"), "part", *(F.col(n).alias(c) for n, c in zip(held, carry)))
