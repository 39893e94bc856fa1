"""The corpus pipeline: quality rules, near-duplicates, secrets, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

All stages: other columns, whatever their names, are left out; null columns stay null; an empty table gives an empty one; no
stage cuts a text, however long. What each does with null, empty and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitebrief.llm import minhash, mixing, pieces, quality, secret_scan
from sitebrief.llm.common import documents, written
from sitebrief.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts with them; repeated rows pass or go together."""
    return quality.keep_good(docs.select(COLUMNS))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id.

    Rows of one id are one document and stay together; rows without an id, and texts without words, all stay.
    """
    ship_package(spark)
    return minhash.keep_one(docs.select(COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, repeated ones alike, null and empty texts as they are."""
    ship_package(spark)
    return secret_scan.redact(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words are never taken, equal rows are drawn alike."""
    return mixing.mix(docs.select(COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row; null and empty texts have no ids."""
    ship_package(spark)
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# Guess costs and piece encoding cannot be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
