"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that the text contracts name: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"

#: Rows and bytes in one Arrow batch. They bound what a Python worker holds at once.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; smaller limits stay."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        try:
            now_n = int(now) if now is not None else 0
        except ValueError:  # a size such as "64m" was set by hand
            continue
        if now_n <= 0 or now_n > most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df's rows as a table in shared_folder(), read again.

    A checkpoint keeps the optimiser's estimate of its size. Joins multiply estimates, so
    a loop of many joins would carry numbers whose digits double with every join; a table
    has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set up if it isn't yet.

    It is what the session names in spark.checkpoint.dir. Only where that is
    unset and all runs in one process, as in tests, a temporary folder is used; on a
    cluster it would be another folder on every machine, and is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not one_process(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc.getCheckpointDir()


def one_process(master: str) -> bool:
    """Whether executors are threads of the driver: local or local[...], not local-cluster."""
    return master == "local" or master.startswith("local[")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, and row if asked for; a null text is empty."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
        *([df[row_col].alias("row")] if row_col else []),
    )


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row, and the name of that column.

    Ids may repeat or be null; a decision about one row needs a name of its own. The rows
    are checkpointed with their numbers, so that every later step sees the same ones.
    """
    key = "__row"
    while any(c.lower() == key for c in df.columns):
        key += "_"
    return checkpointed(df.withColumn(key, F.monotonically_increasing_id())), key


#: Ids of dropped rows (8 bytes each) that may be broadcast; more meet the documents in a shuffle.
FEW_IDS = 2_000_000


def without(df: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """df's rows whose id is not in the one-column frame dropped; rows with a null id stay.

    The ids are counted first. Up to FEW_IDS of them are broadcast, so the documents
    don't move; beyond, ids and documents are shuffled.
    """
    gone = _sized(dropped.toDF("__gone"))
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti")


def among(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """df's rows whose id is in the one-column frame wanted, by the same means as without()."""
    these = _sized(wanted.toDF("__these"))
    return df.join(these, df[id_col] == these["__these"], "left_semi")


def _sized(ids: DataFrame) -> DataFrame:
    """A checkpointed frame of ids, marked for a broadcast if there are at most FEW_IDS."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def train_row(id_col: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text is not divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(id_col: Column) -> Column:
    """The rows kept for measuring; a null id, which has no remainder, is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded training sample, and how many training labels of each class (0 and 1) there are.

    docs has doc_id and text. Labels of held-out rows, nulls, values other than 0 and 1,
    and ids with contradictory labels are not used. Of each class the per_class ids with
    the lowest hashes are taken, so the sample depends on the ids alone; the few rows
    left are broadcast to the documents. Texts of any length are taken whole. The sample
    (doc_id, text, label, half) is checkpointed; half splits it in two by another hash.
    """
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    own = own.filter(F.col("label").isin(0, 1) & train_row(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    parts = [own.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * per_class rows of two numbers
    rows = docs.join(chosen, "doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    return checkpointed(rows.select("doc_id", "text", "label", half.alias("half"))), sizes
