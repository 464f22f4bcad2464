"""Queries of the training-data operators with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, held_out


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.sentencepiece_bpe import round_trip_digests

    return round_trip_digests(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.pii import find_digests

    return find_digests(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.packing import pack_digests

    return pack_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), max_tokens=2048, end_id=1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import GOOD, fit, score

    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.fingerprints import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.toxicity import fit, score

    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), radius=4, shingle=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_html_text": op8_html_text,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
}
