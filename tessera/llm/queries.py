"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, langid, lines, lm, manifest, minhash, mixing, quality, secrets, toxicity, vectors

#: Vocabulary of the encoding query.
VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady(spark: SparkSession) -> SparkSession:
    """Batches that Python workers get hold at most so many rows, as a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(steady(spark), sf_dir, "documents"), 3, 85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (1, 2, 3), 3)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(steady(spark), sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    out = langid.identify(docs, docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return out.select("doc_id", held, "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(steady(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    # the sample is drawn among the labels, so that only its texts are fetched
    few = labels.where("toxic is not null").where(rest != 2).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(toxicity.SAMPLE)
    out = toxicity.toxicity(docs, docs.select("doc_id", "text").join(few, "doc_id"))
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(steady(spark), sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.link_tools(chat.tool_log(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "kind", "call_id", "tool", "status", "n_results", "order_level", "order_turn", "order_step", "errors", F.sha2("json", 256).alias("json_sha256"))


def op7_sql() -> str:
    return """
    WITH m AS (
        SELECT conv_id, turn, role, text,
            CASE WHEN role IN ('user', 'system') THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'plain' END AS kind,
            CASE WHEN role IN ('user', 'system') THEN conv_id || ':' || turn WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id,
            CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'setup' END AS tool
        FROM conversations),
    calls AS (SELECT conv_id, call_id, turn AS call_turn FROM m WHERE kind = 'call'),
    answers AS (SELECT conv_id, call_id, count(*) AS n FROM m WHERE kind = 'result' GROUP BY ALL),
    depth AS (
        WITH RECURSIVE d AS (
            SELECT conv_id, call_id, call_turn, 0 AS level FROM calls
            UNION
            SELECT c.conv_id, c.call_id, c.call_turn, d.level + 1 FROM d JOIN calls c ON c.conv_id = d.conv_id AND c.call_turn = d.call_turn + 2)
        SELECT conv_id, call_id, max(level) AS level FROM d GROUP BY ALL)
    SELECT m.conv_id, m.turn, m.kind, m.call_id, m.tool,
        CASE WHEN m.kind = 'plain' THEN 'plain' WHEN m.kind = 'result' THEN CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END
             WHEN coalesce(a.n, 0) > 0 THEN 'answered' ELSE 'unanswered' END AS status,
        CASE WHEN c.call_id IS NULL THEN 0 ELSE coalesce(a.n, 0) END AS n_results,
        CAST(coalesce(d.level, 0) AS INTEGER) AS order_level,
        coalesce(c.call_turn, m.turn) AS order_turn,
        CASE WHEN m.kind = 'result' THEN 1 ELSE 0 END AS order_step,
        '' AS errors,
        sha256(CASE WHEN m.kind = 'call' THEN
                '{"arguments":{' || CASE WHEN m.tool = 'ask' THEN '"question":' ELSE '"prompt":' END || to_json(m.text) || ',"turn":' || m.turn || '},"call_id":"' || m.call_id || '","role":"assistant","tool":"' || m.tool || '","turn":' || m.turn || '}'
             ELSE '{"call_id":"' || m.call_id || '","content":' || to_json(m.text) || ',"role":"tool","turn":' || m.turn || '}' END) AS json_sha256
    FROM m LEFT JOIN calls c ON m.conv_id = c.conv_id AND m.call_id = c.call_id
    LEFT JOIN answers a ON m.conv_id = a.conv_id AND m.call_id = a.call_id
    LEFT JOIN depth d ON m.conv_id = d.conv_id AND m.call_id = d.call_id
    """


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(steady(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(steady(spark), sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(steady(spark), sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def queries() -> dict:
    found = (op1_near_vectors, op2_near_documents, op3_mix_sources, op4_language, op5_toxicity, op6_byte_bpe, op7_tool_links, op8_line_dedup, op9_secrets, op10_quality, op11_vector_codes, op12_manifest, op13_lm_score)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_tool_links": op7_sql()}
