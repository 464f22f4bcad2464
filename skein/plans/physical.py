"""Small tools for the physical side: fresh join keys and cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rekeyed(column: str | Column) -> Column:
    """The same long key as another expression.

    A side that was aggregated by a key is already dealt out by it, and a join on the
    key would reuse that; adaptive execution can then not split the other side's rows
    of a very frequent key. With the key written anew both sides are dealt out for the
    join itself. Keys of edges are never null; saying so here keeps null filters out of
    one of two otherwise equal plans, so that these share their shuffles.
    """
    key = (F.col(column) if isinstance(column, str) else column).bitwiseXOR(F.lit(0x2545F4914F6CDD1D))
    return F.coalesce(key, F.lit(0).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and executors are threads of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="skein-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parallelism(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
