"""Corpus preparation in five stages, each one operator over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Defined results: a null or empty text has under twenty words, so the first stage
drops it, and packing meets no null; texts of any length are taken whole; of equal
and of repeated rows the near-duplicate stage keeps one, that with the smallest id
(null ids come last); documents with one id and different texts are different ones;
other columns pass through all stages but the last, whatever their names; an empty
table gives an empty result, and an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import op2_simhash, op3_packing, op4_secrets, op7_decontaminate, op10_quality
from phonolake.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return op10_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths or more of its five-word shingles."""
    return op2_simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return op7_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; n_chars follows the text."""
    clean = op4_secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its sequence and offset."""
    return op3_packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: Packing counts a vocabulary's tokens, which SQL cannot; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "_"))
    return docs
