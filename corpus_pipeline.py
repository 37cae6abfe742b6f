"""The corpus pipeline: from raw documents to token ids.

Toxic documents go; of exact copies one stays, of near-duplicates one stays;
documents are drawn at rates that bring domains to their target shares; what is
left is encoded.  Each stage reads what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm import bpe, exact_dedup, mixing, resemblance, toxicity
from spindrel.llm.common import Scratch, cleared, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under the threshold."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    base = docs.withColumn("__toxic", F.pandas_udf(toxicity.scores(machine), "double")("text"))
    return base.where(F.col("__toxic") < toxicity.THRESHOLD).drop("__toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five words, similarity of at least 0.8."""
    return resemblance.near_dedup(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their rates, each once at most."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), most=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the packed ids."""
    import public_tokenizers

    narrow = docs.select("doc_id", "text")
    return bpe.round_trip(narrow, public_tokenizers.path("word_bpe_49k.json"), keep=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with cleared():
            docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


#: The learned stages have no SQL; tests compare the rows with plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE = {}
