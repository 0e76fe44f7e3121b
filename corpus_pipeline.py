"""From raw documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's documents.  Nulls, empty and very long
texts, repeated rows, empty tables and extra columns have the results that the
operators in ``tabulon/llm`` state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm.common import held_out, written
from tabulon.llm.exact_dedup import drop_copies
from tabulon.llm.mixing import mixed
from tabulon.llm.near_dup import drop_near_duplicates
from tabulon.llm.packing import pack
from tabulon.llm.toxicity import drop_toxic
from tabulon.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; learned from the same labelled
    rows as the scoring query."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 0))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, one stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its sources takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be."""
    return pack(docs).drop("row")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup),
          ("mixing sources to target weights", mixing), ("best-fit packing", packing)]

#: a trained classifier and a tokenizer have no SQL form; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
