"""Packing by power-of-two decomposition.

A document's ids, with an end id, are cut into full sequences and, for the rest, one
piece for each bit of its length, largest first. A piece is a sequence of its own, so
no sequence crosses documents, and every length is a power of two, so none is padded.
Equal lengths share a bucket (the length's exponent); a batch drawn from one bucket
is rectangular. write_buckets() gathers equal lengths in a folder of their own.
Sequence ids hold the bucket in their lowest BUCKET_BITS bits; the rest numbers rows by
partition and place, so it depends on how the input is split.

All of it is one narrow pass: no shuffle, and no row waits for another document.

Inputs: a null text counts as empty and gives the end id alone; repeated rows are
packed each on their own; an empty table gives an empty table; extra columns are
ignored; long texts are encoded whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.byte_bpe import byte_pieces
from skein.llm.common import bounded_batches, id_and_text
from skein.llm.sentencepiece_bpe import _slices

BUCKET_BITS = 5


def binary_lengths(n: int, most: int) -> list[int]:
    """n as full sequences of most (a power of two) and one power of two for each bit of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1) or max_tokens.bit_length() > 1 << BUCKET_BITS:
        raise ValueError("max_tokens must be a power of two of at most 32 bits")
    bounded_batches(df.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(batches):
        bpe = byte_pieces(tokenizer_path)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _slices(texts):
                rows: list[tuple] = []
                for doc_id, text in zip(doc_ids[i:j], texts[i:j], strict=True):
                    ids = bpe.encode(text).tobytes() + end
                    n, at = len(ids) // 4, 0
                    for length in binary_lengths(n, max_tokens):
                        rows.append((doc_id, at, length, ids[4 * at : 4 * (at + length)], n))
                        at += length
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    pieces = id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    bucket = (F.length(F.bin("length")) - 1).cast("long")
    return pieces.withColumn("bucket", bucket).withColumn("sequence_id", F.monotonically_increasing_id() * (1 << BUCKET_BITS) + F.col("bucket")).withColumn("offset", F.lit(0).cast("long"))


def pack_digests(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """pack() with a checksum in place of the ids."""
    return pack(df, tokenizer_path, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def write_buckets(pieces: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write pack()'s rows with a folder for each bucket, so that equal lengths lie together; every task writes its own files, without a shuffle."""
    pieces.write.mode(mode).partitionBy("bucket").parquet(path)
