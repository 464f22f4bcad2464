"""A training corpus from the documents table: quality, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. Stages accept nulls in any column, repeated rows, extra columns and empty
tables as the operators they call do; the duplicate stages decide by row, so repeated
and null ids neither lose other texts nor keep copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import checkpointed
from skein.llm.exact_dedup import drop_exact_duplicates
from skein.llm.packing import pack
from skein.llm.pii import redact
from skein.llm.quality import fit, keep_good
from skein.llm.registry import vocabulary
from skein.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; it learns from labels of documents that aren't held out."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the longest original with the smallest id; one row of each group."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more over five-word shingles, the document with the smallest id; one row of each group."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by kinds, and n_chars that of the new text."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids; each is a sequence of its own."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), max_tokens=2048, end_id=1)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; every stage's rows are checkpointed as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL says what the classifier and the tokenizer do; tests compare with brute force.
ORACLE_SQL = None
