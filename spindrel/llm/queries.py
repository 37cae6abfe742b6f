"""The thin queries over the tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count, redactions

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count(docs, redactions(F.col("text")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counted.select("doc_id", "n_tokens", "n_tokens_after", "n_pieces", "n_encoded_again")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import uniform_shuffle

    rows = uniform_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch
    from .mixing import TARGETS, fit, memberships, rates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = Scratch(spark, "op8").write(memberships(docs, model).drop("text"))
    return rows.withColumn("rate", rates(rows, TARGETS).column())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER (PARTITION BY k ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(k) AS text_sha256
FROM t
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_ann": op3_ann,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_html_extraction": op6_html_extraction,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
}

ORACLE = {
    "op7_exact_dedup": OP7_SQL,
}
