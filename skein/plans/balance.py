"""Dealing rows out by estimated work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.adjacency import adj_sizes, exclusive_prefix_sum
from skein.plans.physical import rekeyed


def edge_work(edges: DataFrame) -> DataFrame:
    """src, dst, work: wedges that an edge expands to, and one for itself."""
    deg = adj_sizes(edges).select(rekeyed("src").alias("k"), "deg")
    return edges.join(deg, rekeyed("dst") == F.col("k"), "left").select("src", "dst", (F.coalesce("deg", F.lit(0).cast("long")) + 1).alias("work"))


def source_work(edges: DataFrame) -> DataFrame:
    """v, work: wedges that each source's row expands to, and its edges."""
    return edge_work(edges).groupBy(F.col("src").alias("v")).agg(F.sum("work").cast("long").alias("work"))


def work_split(edges: DataFrame, parts: int) -> DataFrame:
    """part, low, high, work: ranges of sources with about equal work, in id order.

    A source goes where the work before it lies among the equal shares of the total.
    """
    run = exclusive_prefix_sum(source_work(edges), "v", "work", "before")
    total = run.agg(F.max(F.col("before") + F.col("work"))).head()[0] or 1
    # In whole numbers: a decimal quotient is rounded to six places, up to the next part just below a share's end.
    part = F.expr(f"(cast(before as decimal(28,0)) * cast({int(parts)} as decimal(10,0))) div {int(total)}").cast("int")
    return run.groupBy(part.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("work").cast("long").alias("work"))


def dealt_by_work(edges: DataFrame, parts: int) -> DataFrame:
    """Edges over so many partitions of about equal work, a hub's edges included: single edges are dealt, heavy ones first spread."""
    work = edge_work(edges)
    total = work.agg(F.sum("work")).head()[0] or 0
    share = max(1, total // max(1, parts * 8))
    # An edge heavier than a share is alone in its slot; light ones share slots at random by hash.
    slot = F.when(F.col("work") >= share, F.xxhash64("src", "dst")).otherwise(F.pmod(F.xxhash64("src", "dst"), F.lit(parts * 8)))
    return work.select("src", "dst", slot.alias("slot")).repartition(parts, "slot").select("src", "dst")


def split_range(low: int, high: int, stride: int = 1) -> tuple[range, range]:
    """The rows low, low + stride, ... below high in two halves; the first keeps the odd one."""
    left = len(range(low, high, stride))
    mid = low + (left + 1) // 2 * stride
    return range(low, mid, stride), range(mid, high, stride)
