"""The command line, batches by every plan, user aggregates, bitmaps, shared folders."""

import time
from collections import Counter
from types import SimpleNamespace

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from skein.__main__ import main, parsed
from skein.functions import bits
from skein.model import AttributeScope, GraphError, Orientation, QueryOptions, Strategy
from skein.operators import sinks, triangles
from skein.plans.kernel import aggregate
from skein.plans.physical import shared_folder
from skein.sources import blocks
from skein.sources.rmat import rmat_graph


@pytest.fixture(scope="module")
def graph(spark):
    e = rmat_graph(spark, 8).persist()
    yield e
    e.unpersist()


@pytest.fixture(scope="module")
def listed(graph):
    return Counter(map(tuple, triangles.list_triangles(graph, Strategy.SEMI).collect()))


@pytest.mark.parametrize("suffix", ["graph", "parquet", "csv", "txt"])
def test_command_line(spark, graph, listed, tmp_path, capsys, suffix):
    path = str(tmp_path / f"small.{suffix}")
    if suffix == "graph":
        blocks.write_block_files(graph, path, bits=20)
    elif suffix == "parquet":
        graph.write.parquet(path)
    elif suffix == "csv":
        graph.write.csv(path)
    else:
        graph.select(F.concat_ws(" ", "src", "dst")).write.text(path)
    out = str(tmp_path / "triangles")
    report = main(["small", str(tmp_path), "10000", "1000000", "12", "n", "n", "n", "y", f"out={out}", "batches=2"], spark)
    said = capsys.readouterr().out
    assert report.n_triangles == sum(listed.values()) and report.ok
    assert f"# of edges: {graph.count()}" in said and f"# of triangles: {report.n_triangles}" in said and "Verified: y" in said
    assert Counter(map(tuple, spark.read.parquet(out).collect())) == listed
    assert main(["small", str(tmp_path), "1", "1", "1", "y", "y", "y", "n", f"out={out}2"], spark).n_triangles == report.n_triangles
    assert not (tmp_path / "triangles2").exists()


def test_command_line_refuses(spark, tmp_path):
    for words in ([], ["a", "b", "x", "1", "1", "n", "n", "n", "n"], ["a", "b", "1", "1", "1", "n", "maybe", "n", "n"], ["a", "b", "1", "1", "1", "n", "n", "n", "n", "colour=red"]):
        with pytest.raises(GraphError):
            parsed(words)
    with pytest.raises(GraphError, match="no graph"):
        main(["none", str(tmp_path), "1", "1", "1", "n", "n", "n", "n"], spark)


PLANS = [QueryOptions(strategy=s, orientation=o, batches=3) for s in (Strategy.INTERSECT, Strategy.JOIN, Strategy.SEMI) for o in (Orientation.ID, Orientation.DEGREE)]


@pytest.mark.parametrize("options", [*PLANS, QueryOptions(strategy=Strategy.ARROW, batches=3, balance=True), QueryOptions(batches=3)])
def test_batches_by_every_plan(graph, listed, options):
    parts = [Counter(map(tuple, p.collect())) for p in sinks.triangle_batches(graph, options)]
    assert len(parts) == 3 and sum(parts, Counter()) == listed
    if options.orientation is Orientation.ID:
        assert all({a % 3 for a, _, _ in p} == {k} for k, p in enumerate(parts))


def test_aggregates_of_several_numbers_by_typed_keys(spark):
    rows = [(None if k % 7 == 0 else f"k{k % 5}", k) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, x long").repartition(5)
    update = lambda acc, b: [acc[0] + b.num_rows, max(acc[1], pc.max(b.column("x")).as_py())]
    got = aggregate(df, AttributeScope.KEY, lambda: [0, -1], update, lambda a, b: [a[0] + b[0], max(a[1], b[1])], key="name")
    assert dict(got.dtypes) == {"key": "string", "value": "array<double>"}
    want = {n: [sum(m == n for m, _ in rows), max(x for m, x in rows if m == n)] for n in {m for m, _ in rows}}
    assert {r["key"]: r["value"] for r in got.collect()} == want
    assert aggregate(df.limit(0), AttributeScope.KEY, lambda: 0.0, lambda a, b: a, lambda a, b: a, key="name").count() == 0


def test_aggregates_take_linear_time_over_keys(spark, monkeypatch):
    monkeypatch.setattr("skein.plans.kernel.MOST_KEYS", 5_000)
    df = spark.range(60_000).select((F.col("id") % 30_000).alias("k"))
    began = time.perf_counter()
    got = aggregate(df, AttributeScope.KEY, lambda: 0.0, lambda acc, b: acc + b.num_rows, lambda x, y: x + y, key="k")
    assert got.filter("value = 2").count() == 30_000 and time.perf_counter() - began < 60


def test_two_level_bitmaps(spark):
    ids = [0, 1, 127, 128, 5000, 32767, 32768, 65535, 70000]
    df = spark.createDataFrame([(x,) for x in ids], "v long")
    maps = df.groupBy(bits.bitmap_bucket("v").alias("b")).agg(bits.set_bits("v").alias("m"), bits.set_upper_bits("v").alias("u"))
    probe = spark.createDataFrame([(x,) for x in [*ids, 2, 126, 129, 4999, 5001, 32766, 32769, 69999]], "v long").withColumn("b", bits.bitmap_bucket("v"))
    assert {r["v"] for r in probe.join(maps, "b").filter(bits.get_bit_two_level("u", "m", "v")).collect()} == set(ids)


def test_no_machine_local_folder_on_a_cluster():
    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local-cluster[2,1,900]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(spark)


def test_no_join_of_edges_is_a_static_broadcast(graph):
    for options in [*PLANS, QueryOptions()]:
        plan = triangles.list_triangles(graph, options)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
