"""Triangle listing and counting as interchangeable plans.

All plans take canonical edges and give the same rows (a > b > c); see Strategy. Joins
of edges or lists ask for a sort-merge join, as size estimates of derived graphs are far
too low for a broadcast to be safe; adaptive execution splits frequent keys, but not
those of wedges, which are dealt by number. None materialises more than its own plan
needs: JOIN and SEMI make every wedge a row, INTERSECT keeps wedges inside arrays, ARROW
inside numpy arrays of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.bits import bitmap_bucket, get_bit_two_level, set_bits, set_upper_bits
from skein.model import GraphTooLarge, Orientation, QueryOptions, Strategy
from skein.operators.adjacency import adj_sizes, adjacency
from skein.operators.prepare import oriented, oriented_by_degree
from skein.plans.cells import Cells
from skein.plans.physical import cut_lineage, parallelism, rekeyed

#: Edges of a graph whose wedges may be shuffled; beyond, JOIN, SEMI, INTERSECT and counting go by cells.
FEW_EDGES = 50_000
#: Edges of a graph that ARROW may broadcast (16 bytes each).
ARROW_EDGES = 20_000_000
#: Wedges that an ARROW task expands at once.
ARROW_WEDGES = 1 << 20


def wedges(edges: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """a, b, c for every path a -> b -> c: the equi-join of edges with themselves (or with far) at the middle."""
    far = edges if far is None else far
    # By number: adaptive execution would coalesce edges of few bytes into about a task a core, some of which
    # make their 10^9 rows when the others are done.
    n = max(parallelism(edges), 4 * edges.sparkSession.sparkContext.defaultParallelism)
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).repartition(n, "b")
    two = far.select(F.col("src").alias("b"), F.col("dst").alias("c")).repartition(n, "b")
    return one.join(two.hint("merge"), "b").select("a", "b", "c")


def wedge_count(edges: DataFrame) -> DataFrame:
    """n: wedges, as the sum of products of in- and out-degrees, without making one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o")))).alias("x"))
    deg = ends.groupBy("x.v").agg(F.sum(F.col("x.o").cast("long")).alias("o"), F.sum(F.lit(1).cast("long") - F.col("x.o")).alias("i"))
    return deg.agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0)).cast("long").alias("n"))


def closed(wedge: DataFrame, edges: DataFrame) -> DataFrame:
    """Wedges whose ends are joined by an edge: a left-semi join."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    return wedge.join(e.hint("merge"), ["a", "c"], "left_semi").select("a", "b", "c")


def _lists(edges: DataFrame, orientation: Orientation, partitions: int | None = None) -> DataFrame:
    """src, nbrs: neighbours in rank order, by id ascending, or by (degree, id)."""
    # A partition's edges are few bytes but expand to many rows: they are dealt out by number,
    # which adaptive execution doesn't coalesce by size.
    n = partitions or parallelism(edges)
    if orientation is Orientation.ID:
        return adjacency(edges.repartition(n, "src"))
    ranked = oriented_by_degree(edges).repartition(n, "src")
    return ranked.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst_deg", "dst"))).alias("l")).select("src", F.col("l.dst").alias("nbrs"))


def _common(adj: DataFrame, orientation: Orientation, part: Column | None = None) -> DataFrame:
    """x, y, common: for every edge that may have any, the vertices that close triangles with it; part: a condition on src.

    A source's list is in rank order, so the third vertex of a triangle over the list's
    p-th entry lies before it (by id, larger first) or behind it (by degree, lower
    first), and only that part of the list travels with the edge.
    """
    own = adj if part is None else adj.filter(part)
    rows = own.select("src", "nbrs", F.posexplode("nbrs").alias("p", "y"))
    if orientation is Orientation.ID:
        rows = rows.filter("p > 0").select(F.col("src").alias("x"), "y", F.slice("nbrs", F.lit(1), F.col("p")).alias("rest"))
    else:
        rows = rows.filter(F.col("p") + 1 < F.size("nbrs"))
        rows = rows.select(F.col("src").alias("x"), "y", F.slice("nbrs", F.col("p") + 2, F.size("nbrs") - F.col("p") - 1).alias("rest"))
    other = adj.select(rekeyed("src").alias("k"), F.col("nbrs").alias("far")).hint("merge")
    return rows.join(other, rekeyed("y") == F.col("k")).select("x", "y", F.array_intersect("rest", "far").alias("common"))


def _sorted_triple(x: Column, y: Column, z: Column) -> list[Column]:
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    return [top.alias("a"), x.bitwiseXOR(y).bitwiseXOR(z).bitwiseXOR(top).bitwiseXOR(low).alias("b"), low.alias("c")]


def _by_intersection(adj: DataFrame, orientation: Orientation, part: Column | None = None) -> DataFrame:
    # explode() would add a filter on the array's size, and with it a second intersection.
    rows = _common(adj, orientation, part).select("x", "y", F.explode_outer("common").alias("z")).filter("z IS NOT NULL")
    if orientation is Orientation.ID:
        return rows.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))
    return rows.select(*_sorted_triple(F.col("x"), F.col("y"), F.col("z")))


def _compressed(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets and neighbours (as places in ids) of a graph of at most ARROW_EDGES edges."""
    table = edges.select("src", "dst").limit(ARROW_EDGES + 1).toArrow()
    if table.num_rows > ARROW_EDGES:
        raise GraphTooLarge(f"the arrow strategy is for at most {ARROW_EDGES} edges")
    src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
    ids = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.lexsort((d, s))
    offsets = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(np.bincount(s, minlength=len(ids)), out=offsets[1:])
    return ids, offsets, d[order]


def expand_edges(ids: np.ndarray, offsets: np.ndarray, nbrs: np.ndarray, src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triangles over the given edges, in steps of about ARROW_WEDGES wedges."""
    n = np.int64(len(ids))
    keys = np.repeat(np.arange(n), np.diff(offsets)) * n + nbrs  # ascending
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    size = offsets[b + 1] - offsets[b]
    step = np.cumsum(size) // ARROW_WEDGES
    for k in np.unique(step):
        at = np.flatnonzero((step == k) & (size > 0))
        if not len(at):
            continue
        m = size[at]
        edge = np.repeat(at, m)
        c = nbrs[np.repeat(offsets[b[at]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())]
        key = a[edge] * n + c
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        yield ids[a[edge[hit]]], ids[b[edge[hit]]], ids[c[hit]]


def best_orientation(edges: DataFrame) -> Orientation:
    """By degree where some list would be far longer than degree order allows, else by id. One aggregation."""
    got = adj_sizes(edges).agg(F.max("deg").alias("most"), F.sum("deg").alias("n")).head()
    if got["most"] is None:
        return Orientation.ID
    return Orientation.DEGREE if got["most"] > 64 + 2 * (2 * got["n"]) ** 0.5 else Orientation.ID


def decided(edges: DataFrame, orientation: Orientation | None) -> tuple[DataFrame, Orientation]:
    """Edges and their orientation. Where it has to be found out, edges are derived once and checkpointed for both uses."""
    if orientation is None:
        edges = edges if edges.is_cached else cut_lineage(edges.select("src", "dst"))
        orientation = best_orientation(edges)
    return edges, orientation


def planned(edges: DataFrame, options: QueryOptions = QueryOptions()) -> Callable[[Column | None], DataFrame]:
    """What lists the triangles of canonical edges by the plan asked for: all of them, or those found from the sources that a condition on src picks.

    What all parts share (orientation, lists, the broadcast graph) is made once; with
    batches it is checkpointed, so that no batch derives it again.
    """
    o = options
    strategy = Strategy.INTERSECT if o.strategy is Strategy.AUTO else o.strategy
    if strategy is Strategy.CELLS or (strategy is not Strategy.ARROW and o.batches == 1):
        cells = Cells(edges, o.partitions, o.balance)
        if strategy is Strategy.CELLS or cells.n_edges > FEW_EDGES:
            return lambda part=None: _of_sources(cells.triangles(), part)
        edges = cells.edges()
    held = cut_lineage if o.batches > 1 else lambda df: df
    if strategy is Strategy.INTERSECT:
        edges, orientation = decided(edges, o.orientation)
        adj = held(_lists(edges, orientation, o.partitions))
        return lambda part=None: _by_intersection(adj, orientation, part)
    if strategy is Strategy.ARROW:
        shared = edges.sparkSession.sparkContext.broadcast(_compressed(edges))
        if o.balance:
            from skein.plans.balance import dealt_by_work

            edges = dealt_by_work(edges, o.partitions or parallelism(edges))
        edges = held(edges)
        return lambda part=None: _by_arrow(edges if part is None else edges.filter(part), shared)
    if o.orientation is Orientation.DEGREE:
        edges = oriented(edges, Orientation.DEGREE)
    edges = held(edges)

    def by_wedges(part: Column | None = None) -> DataFrame:
        wedge = wedges(edges if part is None else edges.filter(part), edges)
        if strategy is Strategy.SEMI:
            rows = closed(wedge, edges)
        else:
            rows = wedge.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("c")).hint("merge"), ["a", "c"]).select("a", "b", "c")
        return rows.select(*_sorted_triple(F.col("a"), F.col("b"), F.col("c"))) if o.orientation is Orientation.DEGREE else rows

    return by_wedges


def _of_sources(triangles: DataFrame, part: Column | None) -> DataFrame:
    """Triangles whose a, the larger end of their edges, fits a condition on src."""
    return triangles if part is None else triangles.withColumnRenamed("a", "src").filter(part).withColumnRenamed("src", "a")


def _by_arrow(edges: DataFrame, shared) -> DataFrame:
    def run(batches):
        ids, offsets, nbrs = shared.value
        for batch in batches:
            if batch.num_rows:
                for found in expand_edges(ids, offsets, nbrs, batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "c"])

    return edges.select("src", "dst").mapInArrow(run, "a long, b long, c long")


def list_triangles(edges: DataFrame, options: QueryOptions | Strategy | str = Strategy.AUTO) -> DataFrame:
    """TRIANGLE rows of canonical edges, by the plan asked for."""
    o = options if isinstance(options, QueryOptions) else QueryOptions(strategy=Strategy(options))
    return planned(edges, replace(o, batches=1))(None)


def count_triangles(edges: DataFrame, orientation: Orientation | None = None) -> DataFrame:
    """n: the number of triangles, without making a row for each."""
    cells = Cells(edges)
    if cells.n_edges > FEW_EDGES:
        return cells.count()
    edges, orientation = decided(cells.edges(), orientation)
    common = _common(_lists(edges, orientation), orientation)
    return common.agg(F.coalesce(F.sum(F.size("common").cast("long")), F.lit(0)).cast("long").alias("n"))


def held(edges: DataFrame) -> DataFrame:
    """The edges, packed and checkpointed, so that several uses derive them once."""
    return Cells(edges).edges()


def closed_wedges(edges: DataFrame) -> DataFrame:
    """Wedges whose ends are joined by an edge, which are the triangles."""
    return list_triangles(edges, Strategy.SEMI)


def triangles_in_range(edges: DataFrame, a_low: int, a_high: int, c_low: int, c_high: int) -> DataFrame:
    """TRIANGLE rows with a and c in closed ranges; rows and lists are cut before they meet."""
    from skein.operators.adjacency import adjacency as lists

    first = edges.filter(F.col("src").between(a_low, a_high))
    last = edges.filter(F.col("dst").between(c_low, c_high))
    ends = lists(last.filter(F.col("src").between(a_low, a_high)))  # what may close a triangle of a
    mid = lists(last)
    rows = first.join(ends.select(rekeyed("src").alias("k1"), F.col("nbrs").alias("near")), rekeyed("src") == F.col("k1"))
    rows = rows.join(mid.select(rekeyed("src").alias("k2"), F.col("nbrs").alias("far")), rekeyed("dst") == F.col("k2"))
    return rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode_outer(F.array_intersect("near", "far")).alias("c")).filter("c IS NOT NULL")


def edge_intersection(edges: DataFrame) -> DataFrame:
    """a, b, n_common for every edge: common out-neighbours of its ends, zeros included."""
    adj = adjacency(edges.repartition(parallelism(edges), "src"))
    pairs = adj.select("src", "nbrs", F.explode("nbrs").alias("dst"))
    other = adj.select(rekeyed("src").alias("k"), F.col("nbrs").alias("far")).hint("merge")
    n = F.coalesce(F.size(F.array_intersect("nbrs", "far")).cast("long"), F.lit(0).cast("long"))
    rows = pairs.join(other, rekeyed("dst") == F.col("k"), "left")
    return rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.when(F.col("far").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_common"))


def bitmap_support(edges: DataFrame) -> DataFrame:
    """The same by two-level bitmaps: each source's neighbours as bitmaps, wedges tested bit by bit, most rejected by the upper level.

    Beyond FEW_EDGES edges by cells, whose words are bitmaps of 64 places each.
    """
    cells = Cells(edges)
    if cells.n_edges > FEW_EDGES:
        return cells.support()
    edges = cells.edges()
    maps = edges.groupBy(F.col("src").alias("ms"), bitmap_bucket("dst").alias("mb")).agg(set_bits("dst").alias("bitmap"), set_upper_bits("dst").alias("upper"))
    w = wedges(edges).withColumn("bucket", bitmap_bucket("c"))
    hits = w.join(maps.hint("merge"), (F.col("a") == F.col("ms")) & (F.col("bucket") == F.col("mb"))).filter(get_bit_two_level("upper", "bitmap", "c"))
    counts = hits.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0).cast("long")).alias("n_common"))
