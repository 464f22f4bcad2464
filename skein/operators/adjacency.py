"""Adjacency lists, degrees, and compressed-row offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.physical import cut_lineage, parallelism


def adjacency(edges: DataFrame) -> DataFrame:
    """ADJ: one row per source, neighbours ascending.

    A list is as long as its source's out-degree; orient a skewed graph by degree first,
    which bounds lists by sqrt(2 E), or use adjacency_parts().
    """
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def adjacency_parts(edges: DataFrame, part_size: int = 4096) -> DataFrame:
    """src, part, nbrs: lists cut by ranges of part_size neighbour ids, so no list is longer than that."""
    part = F.floor(F.col("dst") / F.lit(part_size)).cast("long")
    return edges.groupBy("src", part.alias("part")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def to_edges(adj: DataFrame) -> DataFrame:
    """EDGE rows of an adjacency frame; empty lists give none."""
    return adj.select("src", F.explode("nbrs").alias("dst"))


def nonempty(adj: DataFrame) -> DataFrame:
    return adj.filter(F.size("nbrs") > 0)


def list_length(nbrs: str | Column = "nbrs") -> Column:
    return F.coalesce(F.greatest(F.size(nbrs), F.lit(0)), F.lit(0)).cast("long")  # a null list is empty


def neighbour(nbrs: str | Column, i: int | Column) -> Column:
    """The neighbour at 0-based place i, or null beyond the list's end."""
    nbrs = F.col(nbrs) if isinstance(nbrs, str) else nbrs
    return F.get(nbrs, F.lit(i) if isinstance(i, int) else i)


def adj_sizes(edges: DataFrame) -> DataFrame:
    """src, deg of every source."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))


def degrees(edges: DataFrame) -> DataFrame:
    """DEGREES of every endpoint, by one aggregation of tagged ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.v").alias("v")).agg(F.sum(F.col("x.o").cast("long")).alias("out_deg"), F.sum(F.lit(1).cast("long") - F.col("x.o")).alias("in_deg"))


def degree_within(edges: DataFrame, low: int, high: int) -> DataFrame:
    """v, deg (out-degree) of every id from low to high + 1, zeros included: the dense degree array."""
    ids = edges.sparkSession.range(low, high + 2).select(F.col("id").alias("v"))
    deg = adj_sizes(edges.filter(F.col("src").between(low, high)))
    return ids.join(deg, ids["v"] == deg["src"], "left").select("v", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))


def exclusive_prefix_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with column out: the sum of value over all rows with a smaller order (distinct, a long).

    Rows are dealt out by ranges of order. Running sums are made inside each range, and
    the ranges' totals, one row each, are summed up and broadcast; no task sees all rows.
    """
    n = parallelism(df)
    placed = cut_lineage(df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    # One row per range, so at most n rows.
    totals = placed.groupBy("__part").agg(F.sum(value).cast("long").alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).cast("long").alias("__before"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    return run.join(F.broadcast(totals), "__part").withColumn(out, F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """CSR_OFFSETS of the sources that have edges."""
    return exclusive_prefix_sum(adj_sizes(edges).withColumnRenamed("src", "v"), "v", "deg", "off").select("v", "deg", "off")


def csr_offsets_dense(edges: DataFrame) -> DataFrame:
    """CSR_OFFSETS of every id from the smallest source to one past the largest: degrees, scan, zero fill in one."""
    bounds = edges.agg(F.min("src").alias("lo"), F.max("src").alias("hi")).head()
    if bounds["lo"] is None:
        return csr_offsets(edges)
    return exclusive_prefix_sum(degree_within(edges, bounds["lo"], bounds["hi"]), "v", "deg", "off").select("v", "deg", "off")
