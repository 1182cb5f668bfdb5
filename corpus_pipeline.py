"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, minhash, mixing, quality
from tessera.llm.queries import VOCABULARY, steady
from tessera.llm.store import drop, noted, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tables that the last stage wrote on its way.
_made: list[str] = []


def stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of the pipeline.  As each stage's result is written before the next begins, the tables that it made on its way go then."""

    @functools.wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, *_made)
        _made.clear()
        with noted(_made):
            return make(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, all columns.  A null or empty text is not kept; rows of one doc_id, and those without, are judged one by one."""
    return quality.kept_rows(docs.select(*COLUMNS))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others have; those of which nothing is left go.

    A null text and rows without doc_id stay as they are; rows equal in id and text lose the same lines.
    """
    out = lines.dedup_lines(docs.select(*COLUMNS)).where("not (n_removed > 0 and text rlike '^\\\\s*$')")
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    Each row goes by its own verdict: rows without doc_id stay, and of rows that repeat one, those whose verdict is ``kept``.
    """
    return minhash.near_duplicates(docs, 5, 80, COLUMNS[1:]).where("kept").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last pass of a source ends inside one document.

    Rows are documents of their own, whether or not they have a doc_id or repeat one.
    """
    plan = mixing.mix(docs, carry=COLUMNS[1:]).where("taken > 0")
    whole = F.col("copies") + (F.col("part") == F.col("size")).cast("long")
    last = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    plan = plan.select(*COLUMNS, whole.alias("whole"), (whole + last.cast("long")).alias("n"), "part")
    rows = plan.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    cut_off = F.col("k") > F.col("whole")
    head = F.array_join(F.slice(F.filter(F.split("text", quality.SPACE), lambda w: w != ""), F.lit(1), F.col("part").cast("int")), " ")
    rows = rows.withColumn("text", F.when(cut_off, head).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(cut_off, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that the mix gives; a null text is an empty one, and every row counts, whatever its doc_id."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: Hashing, learned accuracies and BPE are not SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs, last = steady(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, make in STAGES[:-1]:
        docs, path = written(make(spark, docs, sf_dir))
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
