"""Token counts from per-document pre-token frequencies.

1. The corpus's distinct pre-tokens: every task hands on its own distinct ones with
   their frequencies, and these are added up by pre-token.
2. The tokens of every distinct pre-token are counted, once, wherever in the corpus and
   how often it occurs. That table (piece, times, n) is checkpointed.
3. Every document becomes its pre-token frequencies. They are joined to the table, and a
   document's total is the sum of frequency times count; no ids of a document are made.

The join has two halves, together the whole. The most frequent pre-tokens, up to
HEAD of at most HEAD_CHARS bytes each (so the size is bounded), are broadcast and joined
where the documents are read. What a document has beyond the head goes through a
shuffled join by pre-token; none of these is frequent, so no key is hot. Where the
head holds every pre-token there is no such rest, and documents are not shuffled.

Inputs: a null text counts as empty and has 0 tokens; repeated rows each give a row;
an empty table gives an empty table; extra columns are ignored; long texts are
counted whole, in slices that end where no token can cross. Special tokens written in
a text count as one each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.byte_bpe import byte_pieces
from skein.llm.common import bounded_batches, checkpointed, id_and_text
from skein.llm.sentencepiece_bpe import _slices

#: Characters of a text that are split into pre-tokens at a time.
SLICE = 1 << 20
EDGE = re.compile(r"\S(?=\s)")
#: Pre-tokens that are broadcast with their counts, and how long they may be.
HEAD, HEAD_CHARS = 200_000, 32
#: Distinct pre-tokens, or characters of texts, after which a task hands on what it holds.
HELD, HELD_CHARS = 300_000, 1 << 26
#: Rows of pre-tokens in one Arrow batch.
PART = 50_000


def text_slices(text: str, size: int = SLICE) -> list[str]:
    """Cut a long text between a word and the white space after it."""
    out, at = [], 0
    while len(text) - at > size:
        edge = EDGE.search(text, at + size - 1)
        if not edge:
            break
        out.append(text[at : edge.end()])
        at = edge.end()
    out.append(text[at:])
    return out


def frequencies(bpe, text: str) -> tuple[Counter[str], int]:
    """How often the text has each pre-token, and how many special tokens it has."""
    times, special = Counter(), 0
    for part, token in bpe.parts(text):
        if token is not None:
            special += 1
        else:
            for piece in text_slices(part):
                times.update(bpe.pieces(piece))
    return times, special


def count_batch(bpe, texts: list[str]) -> np.ndarray:
    """Tokens of each of a few texts, without a cluster: counted once per distinct pre-token, joined and summed."""
    tables = [frequencies(bpe, t) for t in texts]
    count = {p: len(bpe.merged(p)) for p in set().union(*(times for times, _ in tables))}
    return np.array([special + sum(count[p] * k for p, k in times.items()) for times, special in tables], dtype=np.int64)


def distinct_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """piece, times: the corpus's pre-tokens (as UTF-8) and how often they occur."""

    def run(batches):
        bpe = byte_pieces(tokenizer_path)
        held: Counter[str] = Counter()

        def handed_on():
            yield pa.RecordBatch.from_arrays([pa.array([p.encode() for p in held], pa.binary()), pa.array(held.values(), pa.int64())], ["piece", "times"])
            held.clear()

        chars = 0
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                held.update(frequencies(bpe, text)[0])
                chars += len(text)
                if len(held) > HELD or chars > HELD_CHARS:
                    yield from handed_on()
                    chars = 0
        if held:
            yield from handed_on()

    return docs.select("text").mapInArrow(run, "piece binary, times long").groupBy("piece").agg(F.sum("times").alias("times"))


def piece_counts(pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """piece, times, n: the tokens of each distinct pre-token."""

    def run(batches):
        bpe = byte_pieces(tokenizer_path)
        for b in batches:
            n = [len(bpe.merged(p.decode())) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], ["piece", "times", "n"])

    return pieces.mapInArrow(run, "piece binary, times long, n long")


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = id_and_text(df, id_col, text_col)
    table = checkpointed(piece_counts(distinct_pieces(docs, tokenizer_path), tokenizer_path))
    # How many pre-tokens there are of each magnitude says from which on they fit in the head,
    # so no task sorts them. At most `head` of HEAD_CHARS bytes reach the driver and the workers.
    size = F.when(F.octet_length("piece") <= HEAD_CHARS, F.floor(F.log2("times") * 8)).otherwise(-1)
    sizes = {r["size"]: r["count"] for r in table.groupBy(size.alias("size")).count().collect()}
    least = min((k for k in sizes if k >= 0 and sum(n for j, n in sizes.items() if j >= k) <= head), default=1 << 20)
    top = table.filter(size >= least).select("piece", "n").toArrow()
    known = spark.sparkContext.broadcast(dict(zip((p.decode() for p in top.column("piece").to_pylist()), top.column("n").to_pylist(), strict=True)))
    whole = sum(sizes.values()) == top.num_rows  # the head is all there is
    names = ["doc_id", "n_bytes", "n", "k", "piece", "row"]

    def run(batches):
        """A row of each document with the tokens of its head pre-tokens, and a row for each pre-token beyond."""
        bpe, count = byte_pieces(tokenizer_path), known.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                total, of, piece, k = [], [], [], []
                for d, t in enumerate(texts[i:j]):
                    times, n = frequencies(bpe, t)
                    for p, m in times.items():
                        if (one := count.get(p)) is not None:
                            n += one * m
                        else:
                            of.append(d)
                            piece.append(p.encode())
                            k.append(m)
                    total.append(n)
                own, size = b.slice(i, j - i), pa.array([len(t.encode()) for t in texts[i:j]], pa.int64())
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), size, pa.array(total, pa.int64()), none, pa.nulls(j - i, pa.binary()), own.column(2)], names)
                for c in range(0, len(of), PART):
                    at = pa.array(of[c : c + PART], pa.int64())
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(k[c : c + PART], pa.int64()), pa.array(piece[c : c + PART], pa.binary()), own.column(2).take(at)], names)

    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, n_bytes long, n long, k long, piece binary, row long")
    if not whole:
        far = table.select(F.col("piece").alias("known"), F.col("n").alias("each"))
        # A document's own row meets no pre-token; its number instead of one keeps these rows spread.
        rows = rows.join(far, F.coalesce("piece", F.encode(F.concat(F.lit("\uffff"), F.col("row")), "utf-8")) == F.col("known"), "left")
        rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce(F.col("n"), F.col("k") * F.col("each"))).alias("n"))
    return rows.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
