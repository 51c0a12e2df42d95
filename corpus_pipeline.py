"""A training-data pipeline: quality rules, near copies, repeated passages, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents; n_chars is kept true to the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm import common, decontaminate, jaccard, pieces, quality, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(found: DataFrame, text: str) -> DataFrame:
    """(doc_id, text column, carried) as documents."""
    return found.select("doc_id", F.col(text).alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule are taken out; documents that the base rules or the loss of text reject go, null and empty texts among them.

    Null and shared ids and repeated rows are judged row by row; columns that documents doesn't have are left out; an empty table stays empty.
    """
    return _documents(quality.assess(docs, carry=["lang", "source"]).where("kept"), "cleaned")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of Jaccard links stays: the one of the least id (nulls count as the largest, ties go by the text).

    Rows are told apart by id and text, so rows that share an id, or have none, stay or go each for itself. Texts without words are no
    copies, but of rows equal in id and text one stays. Columns that documents doesn't have are left out; an empty table stays empty.
    """
    return jaccard.representatives(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere are taken out; documents without words, or left without any, go.

    Null and shared ids and repeated rows are taken row by row; columns that documents doesn't have are left out; an empty table stays empty.
    """
    found = repeats.remove_repeats(docs, 35, carry=["lang", "source"])
    return _documents(found.where("n_words > n_removed"), "kept")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none. Each row is judged for itself; columns that documents
    doesn't have are left out; an empty table stays empty."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) by the public piece vocabulary, with an end id; a null or empty text has no other id. A row for each row."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL can't express the line rules, the walks and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, "pipeline")
    return docs
