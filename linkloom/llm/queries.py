"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, licences, merkle, mixing, pieces, simhash, suffix_tree, tool_calls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(_table(spark, sf_dir, "pages"))
    records = warc.read_records(spark, path)
    differs = F.lit("a payload does not match the digest in its header")
    checked = F.assert_true(F.col("sha1") == F.col("stated"), differs).cast("string")
    return records.select(F.col("record").alias("page_id"), "payload_bytes", F.coalesce(checked, "sha1").alias("payload_digest"), "record_type", "refers_to")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, needs = tool_calls.conversation_calls(_table(spark, sf_dir, "conversations"))
    out = tool_calls.format_calls(calls, results, needs, tool_calls.REPLY)
    return out.select("conv_id", "turn", "call_id", "n_results", "level", "valid", F.array_join("errors", "; ").alias("errors"), "json")


def model_path() -> str:
    """The public piece model that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(_table(spark, sf_dir, "documents"), model_path())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_likeness(_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licences.document_paths(_table(spark, sf_dir, "documents"))
    return licences.scan(files, id_col="doc_id").withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_tool_calls": op5_tool_calls,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_merkle": op8_merkle,
    "op9_licences": op9_licences,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        g AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS holder FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
        FROM g
    """,
    "op5_tool_calls": """
        WITH u AS (SELECT conv_id, turn, text, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM conversations WHERE role = 'user'),
        l AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) AS INTEGER) AS level FROM u),
        r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL)
        SELECT l.conv_id, l.turn, l.conv_id || ':' || l.turn AS call_id, coalesce(n_results, 0) AS n_results, level, length(text) BETWEEN 1 AND 1000 AS valid,
               CASE WHEN length(text) > 1000 THEN '$.prompt: too long' WHEN length(text) = 0 THEN '$.prompt: too short' ELSE '' END AS errors,
               '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || l.turn || '},"id":"' || l.conv_id || ':' || l.turn || '","name":"reply","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json
        FROM l LEFT JOIN r USING (conv_id, turn)
    """,
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY norm))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
