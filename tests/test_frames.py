"""Preparation, adjacency, offsets, metadata, functions, balancing, kernels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions import bits, grid
from skein.model import ADJ, EDGE, AttributeScope, Graph
from skein.operators import adjacency, metadata, prepare
from skein.plans import balance
from skein.plans.kernel import aggregate, run_kernel
from skein.sources import edges as sources
from skein.sources.rmat import rmat_graph, rmat_pairs


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_canonical_edges(spark):
    raw = frame(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (None, 1), (0, 5)])
    assert rows(prepare.canonical_edges(raw)) == [(2, 1), (5, 0)]
    assert rows(prepare.without_self_loops(raw.dropna())) == [(0, 5), (1, 2), (1, 2), (2, 1)]
    wide = raw.withColumns({"SRC2": F.lit(1), "k": F.lit("x")})
    assert prepare.canonical_edges(wide).columns == ["src", "dst"]


def test_ids_beyond_long_are_refused(spark):
    big = spark.createDataFrame([("18446744073709551615", "1")], "src string, dst string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CAST_OVERFLOW"):
        prepare.canonical_edges(big).collect()


def test_adjacency_round_trip(spark):
    e = rmat_graph(spark, 7)
    adj = adjacency.adjacency(e)
    assert [f.name for f in adj.schema] == ADJ.fieldNames()
    assert rows(adjacency.to_edges(adj)) == rows(e)
    for r in adj.collect():
        assert r["nbrs"] == sorted(set(r["nbrs"]))
    parts = adjacency.adjacency_parts(e, 16)
    assert parts.agg(F.max(F.size("nbrs"))).head()[0] <= 16
    assert rows(adjacency.to_edges(parts)) == rows(e)
    assert sum(r["n"] for r in adj.select(adjacency.list_length().alias("n")).collect()) == e.count()
    lost = spark.createDataFrame([(1, None), (2, [])], "src long, nbrs array<long>")
    assert [r[0] for r in lost.select(adjacency.list_length()).collect()] == [0, 0]
    assert adjacency.nonempty(lost).count() == 0


def test_offsets(spark):
    e = rmat_graph(spark, 7).persist()
    got = rows(adjacency.csr_offsets(e))
    at = 0
    for _, deg, off in got:
        assert off == at
        at += deg
    assert at == e.count()
    dense = rows(adjacency.csr_offsets_dense(e))
    ids = [v for v, _, _ in dense]
    assert ids == list(range(ids[0], ids[-1] + 1)) and dense[-1][1:] == (0, at)
    assert [r for r in dense if r[1]] == got
    assert rows(adjacency.csr_offsets_dense(e.limit(0))) == []
    e.unpersist()


def test_prefix_sum_takes_any_partitioning(spark):
    df = spark.createDataFrame([(int(k), int(k % 7)) for k in np.random.default_rng(1).permutation(500)], "k long, x long").repartition(9)
    got = rows(adjacency.exclusive_prefix_sum(df, "k", "x", "s"))
    assert [s for _, _, s in got] == [sum(j % 7 for j in range(k)) for k in range(500)]


def test_metadata(spark):
    e = prepare.canonical_edges(frame(spark, [(0, 1), (300, 2), (300, 299), (5, 1)]))
    assert tuple(metadata.graph_info(e).head()) == (6, 4, 3)
    assert tuple(metadata.cell_bounds(e).head()) == (1, 300, 0, 299)
    stats = {(r["block_row"], r["block_col"]): r["n_edges"] for r in metadata.block_stats(e, 8).collect()}
    assert stats == {(0, 0): 2, (1, 0): 1, (1, 1): 1}
    assert rows(metadata.block(e, 8, 1, 0)) == [(300, 2)]
    assert metadata.partition_stats(e).agg(F.sum("n_edges")).head()[0] == 4
    assert tuple(metadata.graph_info(e.limit(0)).head()) == (0, 0, 0)


def test_range_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    sources.saved(Graph(rmat_graph(spark, 8)), path)
    plan = prepare.in_range(spark.read.parquet(path), "src", 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(src,10)" in plan and "LessThanOrEqual(src,20)" in plan
    graph = sources.from_parquet(spark, path)
    assert rows(graph.edges) == rows(rmat_graph(spark, 8))
    cached = graph.cached()
    assert cached.is_cached()
    cached.close()
    assert not cached.is_cached()


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# nodes\n1\t2\n2 1\n\n 3   4 \n")
    (tmp_path / "e.csv").write_text("1,2\n4,3\n")
    assert rows(sources.from_text(spark, str(tmp_path / "e.txt")).edges) == [(2, 1), (4, 3)]
    assert rows(sources.from_csv(spark, str(tmp_path / "e.csv")).edges) == [(2, 1), (4, 3)]
    frame(spark, [(1, 2)]).createOrReplaceTempView("pairs_of_ids")
    g = sources.from_table(spark, "pairs_of_ids")
    assert g.edges.dtypes == [("src", "bigint"), ("dst", "bigint")] and EDGE.fieldNames() == g.edges.columns
    assert tuple(g.info().head()) == (2, 1, 1)


def test_rmat_depends_on_nothing_but_its_parameters(spark):
    one = rmat_pairs(spark, 6)
    assert rows(one.repartition(3)) == rows(rmat_pairs(spark, 6)) and one.count() == 16 << 6
    assert rows(rmat_pairs(spark, 6, seed=1)) != rows(one)
    deg = rmat_graph(spark, 10).groupBy("src").count().agg(F.max("count"), F.avg("count")).head()
    assert deg[0] > 5 * deg[1]  # skewed


def test_scalar_functions(spark):
    v = [0, 1, 2, 3, 4, 5, 127, 128, 129, (1 << 40) - 1, 1 << 40, (1 << 62)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    got = df.select(bits.is_power_of_two("v"), bits.log2_floor("v"), bits.next_power_of_two("v"), bits.round_up("v", 8), bits.round_up(-F.col("v"), 8), bits.padding_size("v", 8)).collect()
    for x, r in zip(v, got, strict=True):
        assert r[0] == (x > 0 and x & (x - 1) == 0)
        assert r[1] == (x.bit_length() - 1 if x else None)
        assert r[2] == (1 if x <= 1 else 1 << (x - 1).bit_length())
        assert r[3] == -(-x // 8) * 8 and r[4] == -(x // 8) * 8 and r[5] == r[3] - x
    pair = spark.createDataFrame([(3, 9), (2**32 - 1, 0), (0, 2**31 - 1)], "r long, c long")
    p = grid.pack_block("r", "c")
    assert [(x[0], x[1]) for x in pair.select(grid.packed_row(p), grid.packed_col(p)).collect()] == [(3, 9), (2**32 - 1, 0), (0, 2**31 - 1)]
    assert (bits.KIB, bits.MIB, bits.GIB, bits.TIB) == (1024, 1024**2, 1024**3, 1024**4)
    assert tuple(pair.limit(1).select(grid.dim_size("r", "c"), grid.range_width("r", "c"), grid.column_major("r", "c", 10), grid.offset("c", "r")).head()) == (27, 7, 93, 6)


def test_bitmaps(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 65535, 65536]
    df = spark.createDataFrame([(x,) for x in ids], "v long")
    maps = df.groupBy(bits.bitmap_bucket("v").alias("b")).agg(bits.set_bits("v").alias("m"))
    probe = spark.createDataFrame([(x,) for x in [*ids, 2, 9, 32766, 65534, 65537]], "v long").withColumn("b", bits.bitmap_bucket("v"))
    hit = {r["v"] for r in probe.join(maps, "b").filter(bits.get_bit("m", "v")).collect()}
    assert hit == set(ids)
    low, high = spark.range(1).select(*bits.bitmap_level_sizes(1000)).head()
    assert (low, high) == (128, 4)


def test_work_is_split_evenly(spark):
    e = rmat_graph(spark, 9, 8).persist()
    parts = sorted(balance.work_split(e, 4).collect())
    total = sum(r["work"] for r in parts)
    heaviest = balance.source_work(e).agg(F.max("work")).head()[0]
    assert all(r["work"] <= total / 4 + heaviest for r in parts)
    assert all(x["high"] < y["low"] for x, y in zip(parts, parts[1:], strict=False))
    assert rows(balance.dealt_by_work(e, 5)) == rows(e)
    e.unpersist()
    for low, high, stride in ((0, 10, 1), (3, 40, 7), (5, 5, 2), (0, 1, 4)):
        one, two = balance.split_range(low, high, stride)
        assert [*one, *two] == list(range(low, high, stride)) and 0 <= len(one) - len(two) <= 1


def test_kernel_and_aggregates(spark):
    e = frame(spark, [(k % 3, k) for k in range(100)]).repartition(4)
    shared = pa.table({"w": [10]})

    def kernel(batch, table):
        n = table.column("w")[0].as_py()
        for _ in range(2):
            yield pa.RecordBatch.from_arrays([pa.array([x * n for x in batch.column(1).to_pylist()], pa.int64())], ["y"])

    assert sorted(r["y"] for r in run_kernel(e, kernel, "y long", shared).collect()) == sorted([10 * k for k in range(100)] * 2)
    args = (lambda: 0.0, lambda acc, b: acc + b.num_rows, lambda x, y: x + y)
    assert aggregate(e, AttributeScope.GLOBAL, *args).head()["value"] == 100
    assert {r["key"]: r["value"] for r in aggregate(e, AttributeScope.KEY, *args, key="src").collect()} == {0: 34, 1: 33, 2: 33}
    assert sum(r["value"] for r in aggregate(e, AttributeScope.PARTITION, *args).collect()) == 100
    assert aggregate(e, AttributeScope.NONE, *args).count() == 0


def test_work_is_split_in_whole_numbers(spark):
    """The third source begins one unit of work before the middle of 6 * 10 ** 9: it is in the first part."""
    from unittest.mock import patch

    work = spark.createDataFrame([(0, 2 * 10**9), (1, 10**9 - 1), (2, 1), (3, 3 * 10**9)], "v long, work long")
    with patch.object(balance, "source_work", lambda edges: work):
        got = sorted(map(tuple, balance.work_split(work, 2).collect()))
    assert got == [(0, 0, 2, 3 * 10**9), (1, 3, 3, 3 * 10**9)]
