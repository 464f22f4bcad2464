"""Exact deduplication by content-defined chunk recipes.

A text, without white space, is cut where a rolling hash of its own bytes says so,
hence equal texts have equal chunks. Every chunk gets an identifier, a digest that is
then verified: the distinct (identifier, content) pairs are gathered, and if one
identifier stands for two contents the digests are widened until none does. A
document becomes its recipe, the ordered list of its chunks' verified identifiers,
and documents are equal exactly when their recipes are. A chunk's content moves once
for each task that has it, however many documents share it; later steps move only
recipes, 16 bytes for about 4 KB of text.

Results for special inputs: a null text counts as empty, and all empty texts are
equal. A null doc_id ranks after every other. Of equal texts the row with the most
code points stays, then the smallest doc_id; rows that repeat the staying row's
doc_id and length can't be told apart from it and are marked kept as well; the filter
drop_exact_duplicates() numbers the rows and keeps exactly one of each group. An empty
table gives an empty table. Extra columns are ignored. Long texts are cut whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WHITE, bounded_batches, checkpointed, id_and_text, keyed, without

WHITE_BYTES = WHITE.encode()
#: Chunk sizes in bytes: no cut before LEAST, a forced one at MOST, and about MEAN on top of LEAST between.
LEAST, MEAN, MOST = 1024, 4096, 16384
WINDOW = 32
assert LEAST >= WINDOW  # so that a cut depends on the document's own bytes only
#: One random 32-bit number for each byte value.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes that end at each place, by doubling."""
    h = GEAR[data]
    k = 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return h


def cut_points(data: bytes, mean: int = MEAN) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    mask = np.uint32((mean - 1) << (32 - mean.bit_length() + 1) & 0xFFFFFFFF)
    out: list[int] = []
    block, at = 1 << 22, 0
    hits: list[np.ndarray] = []
    while at < n:  # bounded memory for very long texts
        low = max(0, at - WINDOW + 1)
        h = rolling_hash(np.frombuffer(data, np.uint8, min(n, at + block) - low, low))[at - low :]
        hits.append(np.flatnonzero((h & mask) == 0) + at + 1)
        at += block
    last = 0
    for end in [*np.concatenate(hits).tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n and end > last:
            out.append(end)
            last = end
    return out


def chunks_of(text: bytes) -> list[bytes]:
    ends = cut_points(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def recipes(docs: DataFrame, width: int = 16) -> DataFrame:
    """doc_id, n (code points of the original text), digest (SHA-256 of the text without white space), recipe, and row if docs has it."""
    extra = docs.columns[2:]

    def run(batches):
        for b in batches:
            n, digest, recipe = [], [], []
            for t in b.column(1):
                raw = t.as_py()
                text = raw.encode().translate(None, WHITE_BYTES)
                n.append(len(raw))
                digest.append(hashlib.sha256(text).digest())
                recipe.append(b"".join(_identifier(c, width) for c in chunks_of(text)))
            own = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(recipe, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *own, *b.columns[2:]], ["doc_id", "n", "digest", "recipe", *extra])

    return docs.mapInArrow(run, ", ".join(["doc_id long, n long, digest binary, recipe binary", *(f"{c} long" for c in extra)]))


def distinct_chunks(docs: DataFrame, width: int = 16) -> DataFrame:
    """The distinct pairs id, content of all chunks."""

    def run(batches):
        for b in batches:
            found = dict.fromkeys(c for t in b.column(1) for c in chunks_of(t.as_py().encode().translate(None, WHITE_BYTES)))
            yield pa.RecordBatch.from_arrays([pa.array([_identifier(c, width) for c in found], pa.binary()), pa.array(list(found), pa.binary())], ["id", "content"])

    return docs.mapInArrow(run, "id binary, content binary").distinct()


def verified(docs: DataFrame, width: int = 16) -> bool:
    """Whether every identifier of this width stands for one content."""
    return distinct_chunks(docs, width).groupBy("id").count().filter("count > 1").isEmpty()


def _verified_recipes(docs: DataFrame, width: int) -> DataFrame:
    """recipes() with identifiers wide enough that each stands for one content, checkpointed."""
    bounded_batches(docs.sparkSession)
    while not verified(docs, width):
        if width == 64:
            raise ValueError("two different chunks have the same 512-bit digest")
        width = min(64, 2 * width)
    return checkpointed(recipes(docs, width))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _verified_recipes(id_and_text(df, id_col, text_col), width)
    best = F.max(F.struct(F.col("n"), (-F.col("doc_id")).alias("order"), F.col("doc_id"))).alias("best")
    groups = rows.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
    # The key is written anew on either side, so both are dealt out for the join itself and
    # adaptive execution can split the rows of a recipe that very many documents share.
    key = F.concat(F.lit(b"\x01"), F.col("recipe")).alias("key")
    left = rows.select("doc_id", "n", "digest", key)
    right = groups.select(key, F.col("best.doc_id").alias("keep_id"), F.col("best.n").alias("keep_n"), "group_size")
    return left.join(right, "key").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame:
    """df's rows, all columns, with one row of each group of equal texts.

    That is the row with the most code points, then the smallest id (null last); of rows
    that repeat both, the first by row number.
    """
    numbered, key = keyed(df)
    rows = _verified_recipes(id_and_text(numbered, id_col, text_col, key), width)
    best = F.max(F.struct(F.col("n"), (-F.col("doc_id")).alias("order"), (-F.col("row")).alias("first"), F.col("row"))).alias("best")
    kept = rows.groupBy("recipe").agg(best).select(F.col("best.row").alias("keep"))
    return without(numbered, key, rows.join(kept, F.col("row") == F.col("keep"), "left_anti").select("row")).drop(key)
