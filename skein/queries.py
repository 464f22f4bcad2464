"""Named queries of the graph engine, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import bits, grid
from skein.model import AttributeScope, Graph, Orientation, QueryOptions, Strategy
from skein.operators import adjacency as adj
from skein.operators import cliques
from skein.operators import metadata as meta
from skein.operators import prepare, sinks
from skein.operators import triangles as tri
from skein.plans import balance
from skein.plans.kernel import aggregate, run_kernel
from skein.plans.physical import shared_folder
from skein.sources import blocks
from skein.sources import edges as edge_sources
from skein.sources.edges import DERIVED, part_graph

Query = Callable[[SparkSession, str], DataFrame]


def _options(strategy: Strategy, orientation: Orientation | None = None, **more) -> QueryOptions:
    return QueryOptions(strategy=strategy, orientation=orientation, **more)


def _on_part(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(part_graph(spark, sf_dir))


def _listing(graph: str, options: QueryOptions) -> Query:
    return lambda spark, sf_dir: tri.list_triangles(DERIVED[graph](spark, sf_dir), options)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triangle of parts that were ordered together."""
    return tri.list_triangles(part_graph(spark, sf_dir), _options(Strategy.INTERSECT))


def _raw_part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions, self-pairs and repeats: what canonical_edges() is for."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one, two = li.select("l_orderkey", F.col("l_partkey").alias("src")), li.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return one.join(two, "l_orderkey").select("src", "dst")


def _verified(edges: DataFrame) -> DataFrame:
    edges = tri.held(edges)
    return sinks.verified(edges, tri.list_triangles(edges, _options(Strategy.SEMI)))


def _batches_union(edges: DataFrame) -> DataFrame:
    out = None
    for part in sinks.triangle_batches(edges, QueryOptions(batches=4)):
        out = part if out is None else out.union(part)
    return out


def _block_round_trip(edges: DataFrame) -> DataFrame:
    return blocks.from_blocks(blocks.to_blocks(edges, bits=8), bits=8)


def _relabelled(edges: DataFrame) -> DataFrame:
    """Dense ids in order of the old ones, from 0."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("old")).distinct().withColumn("one", F.lit(1).cast("long"))
    return prepare.relabelled(edges, adj.exclusive_prefix_sum(ids, "old", "one", "new"))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph's edges in four batches."""
    from skein.streaming.incremental import TriangleStream

    stream = TriangleStream(spark, f"{shared_folder(spark)}/triangle-stream-{uuid.uuid4().hex}")
    edges = part_graph(spark, sf_dir)
    for k in range(4):
        stream.add(edges.filter(F.pmod(F.col("src") + F.col("dst"), F.lit(4)) == k), k)
    return stream.triangles()


def _kernel_shared(edges: DataFrame) -> DataFrame:
    """A user kernel with read-only shared data: edges whose source is among the hundred smallest sources, with its place there."""
    import numpy as np
    import pyarrow as pa

    least = edges.select("src").distinct().orderBy("src").limit(100).toArrow()  # at most 100 numbers

    def kernel(batch, shared):
        ids = shared.column("src").to_numpy()
        src = batch.column(0).to_numpy()
        at = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
        hit = pa.array(ids[at] == src)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit), pa.array(at.astype(np.int64)).filter(hit)], ["src", "dst", "place"])

    return run_kernel(edges, kernel, "src long, dst long, place long", least)


def _sums(acc, batch):
    import pyarrow.compute as pc

    return [acc[0] + batch.num_rows, acc[1] + (pc.sum(batch.column("dst")).as_py() or 0), max(acc[2], pc.max(batch.column("dst")).as_py() or 0)]


def _add(x, y):
    return [x[0] + y[0], x[1] + y[1], max(x[2], y[2])]


def _three(df: DataFrame, *names: str) -> DataFrame:
    """Rows, sum and largest dst of a user aggregate of three numbers."""
    return df.select(*names, *[F.col("value")[k].cast("long").alias(n) for k, n in enumerate(("n", "total", "most"))])


def _kernel_by_key(edges: DataFrame) -> DataFrame:
    return _three(aggregate(edges, AttributeScope.KEY, lambda: [0, 0, 0], _sums, _add, key="src"), "key").withColumnRenamed("key", "src")


def _kernel_global(edges: DataFrame) -> DataFrame:
    return _three(aggregate(edges, AttributeScope.GLOBAL, lambda: [0, 0, 0], _sums, _add))


def _kernel_by_partition(edges: DataFrame) -> DataFrame:
    """Partial results of each partition, added up, as how rows are split is Spark's choice."""
    parts = aggregate(edges, AttributeScope.PARTITION, lambda: 0.0, lambda acc, b: acc + b.num_rows, lambda x, y: x + y)
    return parts.agg(F.sum("value").cast("long").alias("n"))


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _through(write, read) -> Query:
    """The supplier graph's edges after they were written and read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, "edges")
        write(DERIVED["supp"](spark, sf_dir), path)
        return read(spark, path).edges

    return query


def _through_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    DERIVED["supp"](spark, sf_dir).createOrReplaceTempView("skein_edges")
    return edge_sources.from_table(spark, "skein_edges").edges


def _through_block_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "blocks").removeprefix("file://")
    blocks.write_block_files(DERIVED["supp"](spark, sf_dir), path, bits=6)
    return spark.read.format("sparse_block").option("bits", 6).load(path)


def _parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "triangles")
    sinks.write_parquet(tri.list_triangles(DERIVED["supp"](spark, sf_dir), Strategy.AUTO), path)
    return spark.read.parquet(path)


def _report(options: list[str], sink: bool) -> Query:
    """What a run reports: triangles by batch, and whether they were verified; with sink, also the rows that it wrote."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, "run") if sink else None
        got = sinks.run(DERIVED["nation"](spark, sf_dir), QueryOptions.parse(options), path)
        wrote = spark.read.parquet(path).count() if path else 0
        rows = [(k, n, got.n_triangles, bool(got.ok), got.seconds > 0, wrote) for k, n in enumerate(got.batches)]
        return spark.createDataFrame(rows, "batch int, n long, n_triangles long, ok boolean, timed boolean, n_written long")

    return query


def _cached(edges: DataFrame) -> DataFrame:
    """Opened, described while it is held, closed."""
    graph = Graph(edges, "part").cached()
    held = graph.is_cached()
    row = graph.info().head()
    graph.close()
    return edges.sparkSession.createDataFrame([(*row, held, graph.is_cached())], "n_vertices long, n_edges long, n_nonempty_rows long, held boolean, closed_held boolean")


def _grid_order(edges: DataFrame) -> DataFrame:
    """Non-empty blocks in the order of a column-wise walk over the grid."""
    cells = meta.block_stats(edges, 8)
    side = cells.agg(F.max(F.greatest("block_row", "block_col")) + 1).head()[0]
    return cells.select("block_row", "block_col", "n_edges", grid.column_major("block_row", "block_col", int(side or 1)).alias("place")).orderBy("place")


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ids cut in halves, as work is split."""
    rows = [(n, step, *(x for part in balance.split_range(0, n, step) for x in (part.start, part.stop, len(part)))) for n in (0, 1, 7, 100, 1001) for step in (1, 3)]
    return spark.createDataFrame(rows, "n long, step long, low1 long, high1 long, n1 long, low2 long, high2 long, n2 long")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(*[F.lit(x).cast("long").alias(n) for n, x in (("kib", bits.KIB), ("mib", bits.MIB), ("gib", bits.GIB), ("tib", bits.TIB))])


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    lower, upper = bits.bitmap_level_sizes("k")
    return rows.select(
        "k",
        bits.is_power_of_two("k").alias("is_pow2"),
        bits.log2_floor("k").alias("log2"),
        bits.next_power_of_two("k").alias("roundup2"),
        bits.round_up("k", 12).alias("up12"),
        bits.round_up(-F.col("k"), 12).alias("up12_neg"),
        bits.padding_size("k", 12).alias("pad12"),
        grid.pack_block(F.col("k") % 97, F.col("k") % 89).alias("packed"),
        grid.packed_row(grid.pack_block(F.col("k") % 97, F.col("k") % 89)).alias("prow"),
        grid.packed_col(grid.pack_block(F.col("k") % 97, F.col("k") % 89)).alias("pcol"),
        grid.column_major(F.col("k") % 97, F.col("k") % 89, 97).alias("cell"),
        grid.range_width(F.col("k") % 89, "k").alias("width"),
        grid.dim_size(F.col("k") % 97, F.col("k") % 89, 3).alias("volume"),
        grid.block_of("k", 6).alias("block"),
        grid.local_id("k", 6).alias("local"),
        grid.global_id(grid.block_of("k", 6), grid.local_id("k", 6), 6).alias("back"),
        grid.offset("k", 7).alias("biased"),
        lower.alias("bitmap_low"),
        upper.alias("bitmap_high"),
    )


def _kernel(edges: DataFrame) -> DataFrame:
    """A user kernel: each edge with the sum of its ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def kernel(batch, shared):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.add(batch.column(0), batch.column(1))], ["src", "dst", "ends"])

    return run_kernel(edges, kernel, "src long, dst long, ends long")


def _kernel_aggregate(edges: DataFrame) -> DataFrame:
    """A user aggregate for each source modulo 16: its number of edges."""
    rows = edges.select((F.col("src") % 16).alias("k"))
    got = aggregate(rows, AttributeScope.KEY, lambda: 0.0, lambda acc, b: acc + b.num_rows, lambda x, y: x + y, key="k")
    return got.select(F.col("key").cast("long").alias("k"), F.col("value").cast("long").alias("n"))


QUERIES: dict[str, Query] = {
    **{f"edges_{name}": make for name, make in DERIVED.items()},
    "canonical_edges": lambda s, d: prepare.canonical_edges(_raw_part_pairs(s, d)),
    "edges_relabelled": _on_part(_relabelled),
    "edges_sorted": _on_part(prepare.ordered),
    "graph_info": _on_part(meta.graph_info),
    "cell_bounds": _on_part(meta.cell_bounds),
    "block_stats": _on_part(lambda e: meta.block_stats(e, 8)),
    "block_lookup": _on_part(lambda e: meta.block(e, 8, 3, 2)),
    "block_files": _on_part(lambda e: blocks.described(blocks.to_blocks(e, bits=8))),
    "block_round_trip": _on_part(_block_round_trip),
    "degrees": _on_part(adj.degrees),
    "adj_sizes": _on_part(adj.adj_sizes),
    "adjacency_to_edges": _on_part(lambda e: adj.to_edges(adj.nonempty(adj.adjacency(e)))),
    "adjacency_second": _on_part(lambda e: adj.adjacency(e).select("src", adj.neighbour("nbrs", 1).alias("second"), adj.list_length().alias("n"))),
    "adjacency_parts": _on_part(lambda e: adj.adjacency_parts(e, 64).select("src", "part", F.size("nbrs").cast("long").alias("n"))),
    "csr_offsets": _on_part(adj.csr_offsets),
    "csr_offsets_dense": _on_part(adj.csr_offsets_dense),
    "degree_orientation": _on_part(lambda e: prepare.oriented(e, Orientation.DEGREE)),
    "row_range": _on_part(lambda e: prepare.in_range(prepare.in_range(e, "src", 500, 900), "dst", None, 400)),
    "wedges_count": _on_part(tri.wedge_count),
    "wedges_list": lambda s, d: tri.wedges(DERIVED["supp"](s, d)),
    "closed_wedges": lambda s, d: tri.closed_wedges(DERIVED["supp"](s, d)),
    "edge_intersection": _on_part(tri.edge_intersection),
    "bitmap_support": _on_part(tri.bitmap_support),
    "triangles_list": flagship,
    "triangles_list_join": _listing("part", _options(Strategy.JOIN)),
    "triangles_list_semi": _listing("part", _options(Strategy.SEMI)),
    "triangles_list_arrow": _listing("part", _options(Strategy.CELLS)),
    "triangles_list_arrow_balanced": _listing("part", _options(Strategy.CELLS, balance=True)),
    "triangles_list_by_degree": _listing("part", _options(Strategy.INTERSECT, Orientation.DEGREE)),
    "triangles_list_supp": _listing("supp", _options(Strategy.INTERSECT)),
    "triangles_list_nation": _listing("nation", _options(Strategy.INTERSECT)),
    "triangles_list_user": _listing("user", _options(Strategy.INTERSECT)),
    "triangles_auto": _listing("part", QueryOptions()),
    "triangles_batches": _on_part(_batches_union),
    "triangles_batch_counts": _on_part(lambda e: sinks.batch_counts(e, 4)),
    "triangles_count": _on_part(tri.count_triangles),
    "triangles_count_supp": lambda s, d: tri.count_triangles(DERIVED["supp"](s, d)),
    "triangles_count_user": lambda s, d: cliques.count_triangles_of_groups(edge_sources.user_groups(s, d), "user_id", "hour", "event_type"),
    "triangles_range": _on_part(lambda e: tri.triangles_in_range(e, 500, 1200, 100, 700)),
    "triangles_verify": _on_part(_verified),
    "triangles_incremental": _incremental,
    "work_split": _on_part(lambda e: balance.work_split(e, 8)),
    "edge_work": _on_part(balance.edge_work),
    "kernel_udtf": _on_part(_kernel),
    "kernel_udaf": _on_part(_kernel_aggregate),
    "kernel_shared": _on_part(_kernel_shared),
    "kernel_by_key": _on_part(_kernel_by_key),
    "kernel_global": _on_part(_kernel_global),
    "kernel_by_partition": _on_part(_kernel_by_partition),
    "edges_through_parquet": _through(sinks.write_parquet, edge_sources.from_parquet),
    "edges_through_ranges": _through(lambda e, path: edge_sources.saved(Graph(e), path), edge_sources.from_parquet),
    "edges_through_csv": _through(lambda e, path: e.write.csv(path), edge_sources.from_csv),
    "edges_through_text": _through(lambda e, path: e.select(F.concat_ws(" ", "dst", "src")).write.text(path), edge_sources.from_text),
    "edges_through_table": _through_table,
    "edges_through_block_files": _through_block_source,
    "graph_cached": _on_part(_cached),
    "grid_order": _on_part(_grid_order),
    "partition_stats": _on_part(lambda e: meta.partition_stats(e).agg(F.sum("n_edges").alias("n_edges"), F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"))),
    "triangles_written": _parquet_sink,
    "triangles_by_options": _listing("supp", QueryOptions.parse(["strategy=semi", "orientation=degree", "partitions=5", "balance=y"])),
    "triangles_count_by_degree": _on_part(lambda e: tri.count_triangles(e, Orientation.DEGREE)),
    "run_in_batches": _report(["batches=3", "verify=y", "orientation=id"], True),
    "run_in_batches_by_semi_join": _report(["batches=3", "strategy=semi"], True),
    "run_without_output": _report(["keep_output=n"], False),
    "split_ranges": _halves,
    "size_constants": _sizes,
    "scalar_functions": _scalars,
}

_E = {
    "part": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey > b.l_partkey",
    "supp": "SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey > b.l_suppkey",
    "nation": "SELECT DISTINCT CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS src, CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey",
    "user": "SELECT DISTINCT greatest(a.user_id, b.user_id) AS src, least(a.user_id, b.user_id) AS dst FROM events a JOIN events b ON date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND a.event_type = b.event_type AND a.user_id <> b.user_id",
}


def _sql(body: str, graph: str = "part") -> str:
    return f"WITH e AS MATERIALIZED ({_E[graph]}) {body}"


_TRIANGLES = "SELECT e1.src AS a, e1.dst AS b, e2.dst AS c FROM e e1 JOIN e e2 ON e1.dst = e2.src JOIN e e3 ON e3.src = e1.src AND e3.dst = e2.dst"
_INTERSECTION = f"SELECT e.src AS a, e.dst AS b, coalesce(n, 0) AS n_common FROM e LEFT JOIN (SELECT a, b, count(*) AS n FROM ({_TRIANGLES}) GROUP BY a, b) t ON t.a = e.src AND t.b = e.dst"
_WORK = "w AS (SELECT e.src, e.dst, coalesce(d.n, 0) + 1 AS work FROM e LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) d ON d.src = e.dst)"

ORACLE_SQL: dict[str, str] = {
    **{f"edges_{g}": _sql("SELECT src, dst FROM e", g) for g in _E},
    "canonical_edges": _sql("SELECT src, dst FROM e"),
    "edges_relabelled": _sql("SELECT s.n AS src, d.n AS dst FROM e JOIN m s ON e.src = s.v JOIN m d ON e.dst = d.v").replace(") SELECT s.n", "), m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM (SELECT src AS v FROM e UNION SELECT dst FROM e)) SELECT s.n"),
    "edges_sorted": _sql("SELECT src, dst FROM e ORDER BY src, dst"),
    "graph_info": _sql("SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_vertices, count(*) AS n_edges, count(DISTINCT src) AS n_nonempty_rows FROM e"),
    "cell_bounds": _sql("SELECT min(src) AS min_row, max(src) AS max_row, min(dst) AS min_col, max(dst) AS max_col FROM e"),
    "block_stats": _sql("SELECT src >> 8 AS block_row, dst >> 8 AS block_col, count(*) AS n_edges, count(DISTINCT src) AS n_rows, min(src) AS min_row, max(src) AS max_row, min(dst) AS min_col, max(dst) AS max_col FROM e GROUP BY 1, 2"),
    "block_lookup": _sql("SELECT src, dst FROM e WHERE src >> 8 = 3 AND dst >> 8 = 2"),
    "block_files": _sql("SELECT src >> 8 AS block_row, dst >> 8 AS block_col, count(DISTINCT src) AS n_rows, count(*) AS n_edges, 36 + 8 * count(DISTINCT src) + 4 * count(*) AS n_bytes FROM e GROUP BY 1, 2"),
    "block_round_trip": _sql("SELECT src, dst FROM e"),
    "degrees": _sql("SELECT v, CAST(sum(o) AS BIGINT) AS out_deg, CAST(sum(i) AS BIGINT) AS in_deg FROM (SELECT src AS v, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY v"),
    "adj_sizes": _sql("SELECT src, count(*) AS deg FROM e GROUP BY src"),
    "adjacency_to_edges": _sql("SELECT src, dst FROM e"),
    "adjacency_second": _sql("SELECT src, list_sort(list(dst))[2] AS second, count(*) AS n FROM e GROUP BY src"),
    "adjacency_parts": _sql("SELECT src, CAST(floor(dst / 64) AS BIGINT) AS part, count(*) AS n FROM e GROUP BY 1, 2"),
    "csr_offsets": _sql("SELECT src AS v, deg, coalesce(CAST(sum(deg) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off FROM (SELECT src, count(*) AS deg FROM e GROUP BY src)"),
    "csr_offsets_dense": _sql("SELECT v, deg, coalesce(CAST(sum(deg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off FROM (SELECT v, coalesce(n, 0) AS deg FROM (SELECT unnest(range((SELECT min(src) FROM e), (SELECT max(src) + 2 FROM e))) AS v) LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) ON src = v)"),
    "degree_orientation": _sql("SELECT CASE WHEN (p.n, p.v) < (q.n, q.v) THEN p.v ELSE q.v END AS src, CASE WHEN (p.n, p.v) < (q.n, q.v) THEN q.v ELSE p.v END AS dst FROM e JOIN d p ON e.src = p.v JOIN d q ON e.dst = q.v").replace(") SELECT CASE", "), d AS (SELECT v, count(*) AS n FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY v) SELECT CASE", 1),
    "row_range": _sql("SELECT src, dst FROM e WHERE src BETWEEN 500 AND 900 AND dst <= 400"),
    "wedges_count": _sql("SELECT count(*) AS n FROM e e1 JOIN e e2 ON e1.dst = e2.src"),
    "wedges_list": _sql("SELECT e1.src AS a, e1.dst AS b, e2.dst AS c FROM e e1 JOIN e e2 ON e1.dst = e2.src", "supp"),
    "closed_wedges": _sql(_TRIANGLES, "supp"),
    "edge_intersection": _sql(_INTERSECTION),
    "bitmap_support": _sql(_INTERSECTION),
    **{f"triangles_{x}": _sql(_TRIANGLES) for x in ("list", "list_join", "list_semi", "list_arrow", "list_arrow_balanced", "list_by_degree", "auto", "batches")},
    **{f"triangles_list_{g}": _sql(_TRIANGLES, g) for g in ("supp", "nation", "user")},
    "triangles_batch_counts": _sql(f"SELECT CAST(a % 4 AS INTEGER) AS batch, count(*) AS n_triangles FROM ({_TRIANGLES}) GROUP BY 1"),
    "triangles_count": _sql(f"SELECT count(*) AS n FROM ({_TRIANGLES})"),
    "triangles_count_supp": _sql(f"SELECT count(*) AS n FROM ({_TRIANGLES})", "supp"),
    "triangles_count_user": _sql(f"SELECT count(*) AS n FROM ({_TRIANGLES})", "user"),
    "triangles_range": _sql("SELECT e1.src AS a, e1.dst AS b, e2.dst AS c FROM (SELECT * FROM e WHERE src BETWEEN 500 AND 1200) e1 JOIN (SELECT * FROM e WHERE dst BETWEEN 100 AND 700) e2 ON e1.dst = e2.src JOIN (SELECT * FROM e WHERE src BETWEEN 500 AND 1200 AND dst BETWEEN 100 AND 700) e3 ON e3.src = e1.src AND e3.dst = e2.dst"),
    "triangles_verify": _sql(f"SELECT count(*) AS n_listed, count(*) AS n_counted, true AS ok FROM ({_TRIANGLES})"),
    "triangles_incremental": _sql(_TRIANGLES),
    "work_split": _sql(
        f"SELECT CAST(floor(before * 8 / total) AS INTEGER) AS part, min(v) AS low, max(v) AS high, CAST(sum(work) AS BIGINT) AS work FROM (SELECT src AS v, work, coalesce(sum(work) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(work) OVER () AS total FROM (SELECT src, sum(work) AS work FROM w GROUP BY src)) GROUP BY 1"
    ).replace(") SELECT CAST(floor", f"), {_WORK} SELECT CAST(floor", 1),
    "edge_work": _sql("SELECT src, dst, work FROM w").replace(") SELECT src, dst, work", f"), {_WORK} SELECT src, dst, work", 1),
    "kernel_udtf": _sql("SELECT src, dst, src + dst AS ends FROM e"),
    "kernel_shared": _sql("SELECT src, dst, place FROM e JOIN (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place FROM (SELECT DISTINCT src AS s FROM e ORDER BY s LIMIT 100)) ON src = s"),
    "kernel_by_key": _sql("SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS total, max(dst) AS most FROM e GROUP BY src"),
    "kernel_global": _sql("SELECT count(*) AS n, CAST(sum(dst) AS BIGINT) AS total, max(dst) AS most FROM e"),
    "kernel_by_partition": _sql("SELECT count(*) AS n FROM e"),
    **{f"edges_through_{x}": _sql("SELECT src, dst FROM e", "supp") for x in ("parquet", "ranges", "csv", "text", "table", "block_files")},
    "graph_cached": _sql("SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_vertices, count(*) AS n_edges, count(DISTINCT src) AS n_nonempty_rows, true AS held, false AS closed_held FROM e"),
    "grid_order": _sql("SELECT block_row, block_col, n_edges, block_col * (SELECT max(src >> 8) + 1 FROM e) + block_row AS place FROM (SELECT src >> 8 AS block_row, dst >> 8 AS block_col, count(*) AS n_edges FROM e GROUP BY 1, 2) ORDER BY place"),
    "partition_stats": _sql("SELECT count(*) AS n_edges, min(src) AS min_row, max(src) AS max_row FROM e"),
    "triangles_written": _sql(_TRIANGLES, "supp"),
    "triangles_by_options": _sql(_TRIANGLES, "supp"),
    "triangles_count_by_degree": _sql(f"SELECT count(*) AS n FROM ({_TRIANGLES})"),
    "run_in_batches": _sql(f"SELECT CAST(a % 3 AS INTEGER) AS batch, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_triangles, true AS ok, true AS timed, CAST(sum(count(*)) OVER () AS BIGINT) AS n_written FROM ({_TRIANGLES}) GROUP BY 1", "nation"),
    "run_in_batches_by_semi_join": _sql(f"SELECT CAST(a % 3 AS INTEGER) AS batch, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_triangles, false AS ok, true AS timed, CAST(sum(count(*)) OVER () AS BIGINT) AS n_written FROM ({_TRIANGLES}) GROUP BY 1", "nation"),
    "run_without_output": _sql(f"SELECT CAST(0 AS INTEGER) AS batch, count(*) AS n, count(*) AS n_triangles, false AS ok, true AS timed, CAST(0 AS BIGINT) AS n_written FROM ({_TRIANGLES})", "nation"),
    "split_ranges": """
        SELECT n, step, CAST(0 AS BIGINT) AS low1, h * step AS high1, h AS n1, h * step AS low2, n AS high2, r - h AS n2
        FROM (SELECT n, step, r, (r + 1) // 2 AS h FROM (SELECT n, step, (n + step - 1) // step AS r FROM (SELECT CAST(unnest([0, 1, 7, 100, 1001]) AS BIGINT) AS n) CROSS JOIN (SELECT CAST(unnest([1, 3]) AS BIGINT) AS step)))
    """,
    "size_constants": "SELECT CAST(1024 AS BIGINT) AS kib, CAST(1048576 AS BIGINT) AS mib, CAST(1073741824 AS BIGINT) AS gib, CAST(1099511627776 AS BIGINT) AS tib",
    "kernel_udaf": _sql("SELECT src % 16 AS k, count(*) AS n FROM e GROUP BY 1"),
    "scalar_functions": """
        SELECT o_orderkey AS k, o_orderkey > 0 AND (o_orderkey & (o_orderkey - 1)) = 0 AS is_pow2,
               CASE WHEN o_orderkey > 0 THEN CAST(length(bin(o_orderkey)) - 1 AS BIGINT) END AS log2,
               CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << CAST(length(bin(o_orderkey - 1)) AS BIGINT) END AS roundup2,
               CAST(ceil(o_orderkey / 12) AS BIGINT) * 12 AS up12, -CAST(floor(o_orderkey / 12) AS BIGINT) * 12 AS up12_neg,
               CAST(ceil(o_orderkey / 12) AS BIGINT) * 12 - o_orderkey AS pad12,
               ((o_orderkey % 89) << 32) | (o_orderkey % 97) AS packed, o_orderkey % 97 AS prow, o_orderkey % 89 AS pcol,
               (o_orderkey % 89) * 97 + o_orderkey % 97 AS cell, o_orderkey - o_orderkey % 89 + 1 AS width,
               (o_orderkey % 97) * (o_orderkey % 89) * 3 AS volume, o_orderkey >> 6 AS block, o_orderkey & 63 AS local, o_orderkey AS back, o_orderkey - 7 AS biased,
               CAST(ceil(ceil(o_orderkey / 8) / 4) AS BIGINT) * 4 AS bitmap_low,
               CAST(ceil(ceil(CAST(ceil(ceil(o_orderkey / 8) / 4) AS BIGINT) * 4 / 128) / 4) AS BIGINT) * 4 AS bitmap_high
        FROM orders
    """,
}
