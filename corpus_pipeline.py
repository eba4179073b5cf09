"""The corpus pipeline: raw documents in, packed training sequences out.

Each stage reads what the one before wrote. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finsieve.llm import exact_dedup, near_dedup, packing, quality_model, substring_dedup
from finsieve.llm.common import store, table
from finsieve.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3)."""
    return quality_model.keep_good(docs, table(configure(spark), sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs, exact_dedup.new_index(configure(spark)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id."""
    configure(spark)
    return near_dedup.keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier."""
    configure(spark)
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    configure(spark)
    return packing.pack_documents(docs, packing.tokenizer_path()).drop("row_key")


STAGES = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("substrings", substrings),
    ("pack", pack),
]

#: A trained classifier and a tokenizer decide: SQL can't say it; tests replay it instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
