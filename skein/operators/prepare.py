"""From any pairs of ids to canonical edges.

Self-loops go, each undirected edge stays once, and vertices without edges vanish as
vertices are the union of endpoints. Rows with a null id are no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.model import Orientation, as_edges
from skein.plans.physical import rekeyed


def is_self_loop(src: str = "src", dst: str = "dst") -> Column:
    return F.col(src) == F.col(dst)


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(~is_self_loop())


def canonical_edges(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """EDGE: distinct, src > dst. One shuffle, with duplicates removed before it too."""
    e = as_edges(pairs, src, dst).filter(F.col("src") != F.col("dst"))
    return e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def total_degrees(edges: DataFrame) -> DataFrame:
    """v, deg: edges that touch v."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))


def oriented_by_degree(edges: DataFrame) -> DataFrame:
    """src, dst, dst_deg: every edge from its end of lower (degree, id) to the higher.

    No vertex then has more than sqrt(2 E) out-edges, however skewed the graph: a hub's
    edges point at it. The joins meet hubs as frequent keys; adaptive execution splits them.
    """
    deg = total_degrees(edges)
    one = deg.select(rekeyed("v").alias("k1"), F.col("deg").alias("d1"))
    two = deg.select(rekeyed("v").alias("k2"), F.col("deg").alias("d2"))
    e = edges.join(one.hint("merge"), rekeyed("src") == F.col("k1")).join(two.hint("merge"), rekeyed("dst") == F.col("k2"))
    low, high = F.struct("d1", "src"), F.struct(F.col("d2").alias("d1"), F.col("dst").alias("src"))
    forward = low < high
    return e.select(
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        F.greatest("d1", "d2").alias("dst_deg"),
    )


def oriented(edges: DataFrame, by: Orientation | str = Orientation.ID) -> DataFrame:
    """Edges of canonical ones in the orientation asked for."""
    return edges.select("src", "dst") if Orientation(by) is Orientation.ID else oriented_by_degree(edges).select("src", "dst")


def relabelled(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical edges with ids replaced by mapping (old, new); edges whose ends aren't mapped are dropped by the inner joins."""
    s = mapping.select(rekeyed("old").alias("k1"), F.col("new").alias("n1"))
    d = mapping.select(rekeyed("old").alias("k2"), F.col("new").alias("n2"))
    e = edges.join(s, rekeyed("src") == F.col("k1")).join(d, rekeyed("dst") == F.col("k2"))
    return canonical_edges(e, "n1", "n2")


def in_range(df: DataFrame, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows with low <= column <= high; on a file source the bounds reach the scan."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if high is not None:
        df = df.filter(F.col(column) <= high)
    return df


def ordered(edges: DataFrame) -> DataFrame:
    """Edges in order of src, then dst."""
    return edges.orderBy("src", "dst")
