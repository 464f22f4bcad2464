"""Synthetic skewed graphs by recursive quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.prepare import canonical_edges


def rmat_pairs(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 42, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """src, dst: edge_factor * 2**scale pairs of ids below 2**scale, with repeats and loops.

    Every bit comes from a hash of (edge, level, seed), so the pairs don't depend on
    partitioning.
    """
    rows = spark.range(edge_factor << scale)
    src = dst = F.lit(0).cast("long")
    for level in range(scale):
        # 53 bits of the hash as a number from 0 to 1
        u = F.shiftrightunsigned(F.xxhash64("id", F.lit(level), F.lit(seed)), 11) / F.lit(float(1 << 53))
        src = src * 2 + F.when(u < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when((u < a) | (u >= a + b) & (u < a + b + c), 0).otherwise(1)
    return rows.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def rmat_graph(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 42) -> DataFrame:
    """EDGE of an RMAT graph."""
    return canonical_edges(rmat_pairs(spark, scale, edge_factor, seed))
