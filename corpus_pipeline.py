"""The corpus pipeline: documents through language ID, exact dedup, SimHash near-dedup and best-fit packing.

Each stage takes (spark, docs, sf_dir), calls one operator with production parameters on every row that the stage before
kept, and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, langid, packing, simhash
from ledgerlens.llm.common import discard, materialise_table, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with more than a narrow margin stay."""
    ship(spark)
    return langid.keep_identified(docs).select(COLUMNS)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs).select(COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, 3 bits) the row with the smallest doc_id stays."""
    ship(spark)
    return simhash.keep_representatives(docs, shingle=3, distance=3).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact_deduplication), ("simhash_near_dedup", near_deduplication), ("best_fit_packing", best_fit_packing)]

#: Compression, fingerprints and packing can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            kept = materialise_table(kept)
            discard(docs)  # of the stage before
        docs = kept
    return docs
