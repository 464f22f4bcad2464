"""What a graph looks like: totals, bounds, blocks and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.grid import block_of


def graph_info(edges: DataFrame) -> DataFrame:
    """GRAPH_INFO, one row. Each vertex becomes one row with a flag first, so the final count is additive."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o")))).alias("x"))
    per_vertex = ends.groupBy(F.col("x.v").alias("v")).agg(F.sum("x.o").alias("out"))
    return per_vertex.agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.coalesce(F.sum("out"), F.lit(0)).cast("long").alias("n_edges"),
        F.count(F.when(F.col("out") > 0, 1)).alias("n_nonempty_rows"),
    )


def cell_bounds(edges: DataFrame) -> DataFrame:
    """min_row, max_row, min_col, max_col: answered from Parquet statistics where the source has them."""
    return edges.agg(F.min("src").alias("min_row"), F.max("src").alias("max_row"), F.min("dst").alias("min_col"), F.max("dst").alias("max_col"))


def with_blocks(edges: DataFrame, bits: int) -> DataFrame:
    """Edges with the grid block (block_row, block_col) of 2**bits ids a side that they lie in."""
    return edges.withColumns({"block_row": block_of("src", bits), "block_col": block_of("dst", bits)})


def block_stats(edges: DataFrame, bits: int) -> DataFrame:
    """One row per non-empty block: edges, non-empty rows, and bounds. Rows are counted by (block, src) first."""
    rows = with_blocks(edges, bits).groupBy("block_row", "block_col", "src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    return rows.groupBy("block_row", "block_col").agg(
        F.sum("n").cast("long").alias("n_edges"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("src").alias("min_row"),
        F.max("src").alias("max_row"),
        F.min("lo").alias("min_col"),
        F.max("hi").alias("max_col"),
    )


def block(edges: DataFrame, bits: int, row: int, col: int) -> DataFrame:
    """The edges of one block, as id ranges that a file source can prune by."""
    side = 1 << bits
    return edges.filter(F.col("src").between(row * side, (row + 1) * side - 1) & F.col("dst").between(col * side, (col + 1) * side - 1))


def partition_stats(edges: DataFrame) -> DataFrame:
    """One row per non-empty partition of the frame: edges and bounds."""
    return edges.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_edges"), F.min("src").alias("min_row"), F.max("src").alias("max_row"))
