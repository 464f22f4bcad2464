"""Triangle plans on hand graphs, random graphs and skewed graphs."""

from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.model import GraphError, GraphTooLarge, Orientation, QueryOptions, Strategy
from skein.operators import sinks, triangles
from skein.operators.prepare import canonical_edges
from skein.sources.rmat import rmat_graph

BIG = 1 << 40
K = lambda n, ids=None: [((ids or range(n))[i], (ids or range(n))[j]) for i, j in combinations(range(n), 2)]
HAND = {
    "empty": ([], 0),
    "edge": ([(1, 0)], 0),
    "path": ([(0, 1), (1, 2), (2, 3)], 0),
    "star": ([(0, k) for k in range(1, 6)], 0),
    "k3": (K(3), 1),
    "k4": (K(4), 4),
    "k5": (K(5), 10),
    "k10": (K(10), 120),
    "bowtie": ([(1, 0), (2, 0), (2, 1), (3, 2), (4, 2), (4, 3)], 2),
    "c4": ([(0, 1), (1, 2), (2, 3), (3, 0)], 0),
    "c4 with chord": ([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)], 2),
    "k33": ([(a, b) for a in range(3) for b in range(3, 6)], 0),
    "dirty k3": (K(3) + [(b, a) for a, b in K(3)] + K(3) + [(1, 1)], 1),
    "sparse ids": (K(3, [7, 2**31 + 5, BIG]), 1),
    "ids 0 and 1": (K(3, [0, 1, 2]), 1),
    "null ends": (K(3) + [(None, 1), (2, None)], 1),
}
PLANS = [QueryOptions(strategy=s, orientation=o) for s in (Strategy.JOIN, Strategy.SEMI, Strategy.INTERSECT) for o in Orientation] + [QueryOptions(strategy=Strategy.ARROW), QueryOptions()]


def edges(spark, pairs):
    return canonical_edges(spark.createDataFrame(pairs, "src long, dst long"))


def brute(pairs):
    e = {(max(p), min(p)) for p in pairs if None not in p and p[0] != p[1]}
    v = sorted({x for p in e for x in p}, reverse=True)
    return sorted((a, b, c) for a, b, c in combinations(v, 3) if {(a, b), (a, c), (b, c)} <= e)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", HAND)
def test_hand_graphs(spark, name):
    pairs, n = HAND[name]
    e = edges(spark, pairs).persist()
    assert len(brute(pairs)) == n
    for plan in PLANS:
        assert rows(triangles.list_triangles(e, plan)) == brute(pairs), plan
    for o in Orientation:
        assert triangles.count_triangles(e, o).head()["n"] == n
    e.unpersist()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=60), st.permutations(range(13)))
def test_random_graphs(spark, pairs, names):
    e = edges(spark, pairs).persist()
    want = brute(pairs)
    assert rows(triangles.list_triangles(e, QueryOptions(strategy=Strategy.INTERSECT, orientation=Orientation.DEGREE))) == want
    assert rows(triangles.list_triangles(e, Strategy.SEMI)) == want
    renamed = edges(spark, [(names[a], names[b]) for a, b in pairs])
    assert triangles.count_triangles(renamed).head()["n"] == len(want)
    e.unpersist()


def test_skewed_graph(spark):
    e = rmat_graph(spark, 9).persist()
    assert triangles.best_orientation(e) in Orientation
    by = [rows(triangles.list_triangles(e, p)) for p in PLANS]
    assert all(x == by[0] for x in by) and len(by[0]) == len(set(by[0])) > 1000
    assert all(a > b > c for a, b, c in by[0])
    balanced = QueryOptions(strategy=Strategy.ARROW, balance=True, partitions=3)
    assert rows(triangles.list_triangles(e, balanced)) == by[0]
    assert rows(triangles.list_triangles(e, QueryOptions(strategy=Strategy.INTERSECT, partitions=7))) == by[0]
    support = rows(triangles.edge_intersection(e))
    assert support == rows(triangles.bitmap_support(e))
    assert sum(n for _, _, n in support) == len(by[0])
    e.unpersist()


def test_hub_is_oriented_by_degree(spark):
    star = [(1000, k) for k in range(900)] + [(k, k + 1) for k in range(0, 900, 2)]
    e = edges(spark, star)
    assert triangles.best_orientation(e) is Orientation.DEGREE
    assert triangles.list_triangles(e).count() == 450


def test_degree_orientation_bounds_lists(spark):
    from skein.operators.adjacency import adj_sizes
    from skein.operators.prepare import oriented

    e = rmat_graph(spark, 9).persist()
    most = adj_sizes(oriented(e, "degree")).agg({"deg": "max"}).head()[0]
    assert most <= (2 * e.count()) ** 0.5 + 1
    e.unpersist()


def test_bitmaps_over_several_buckets(spark):
    ids = [0, 1, 32767, 32768, 65536, 70000, 100000]
    e = edges(spark, K(len(ids), ids))
    assert rows(triangles.bitmap_support(e)) == rows(triangles.edge_intersection(e))


def test_arrow_refuses_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(triangles, "ARROW_EDGES", 5)
    with pytest.raises(GraphTooLarge):
        triangles.list_triangles(edges(spark, K(4)), Strategy.ARROW)


def test_run_writes_observes_and_verifies(spark, tmp_path):
    e = edges(spark, K(10)).persist()
    path = str(tmp_path / "t")
    report = sinks.run(e, QueryOptions(batches=3, verify=True), path)
    assert report.n_triangles == 120 == sum(report.batches) and report.ok
    assert rows(spark.read.parquet(path)) == brute(K(10))
    assert sinks.run(e, QueryOptions(keep_output=False), str(tmp_path / "none")).n_triangles == 120
    assert not (tmp_path / "none").exists()
    assert [r["n_triangles"] for r in sinks.batch_counts(e, 3).orderBy("batch").collect()] == report.batches
    assert sinks.printed(triangles.list_triangles(e), 2) == ["1: [2, 1, 0]", "2: [3, 1, 0]"]
    e.unpersist()


def test_verification_fails_on_missing_rows(spark):
    e = edges(spark, K(5))
    row = sinks.verified(e, triangles.list_triangles(e).limit(3)).head()
    assert (row["n_listed"], row["n_counted"], row["ok"]) == (3, 10, False)


def test_options_parse():
    o = QueryOptions.parse(["strategy=semi", "orientation=degree", "batches=4", "balance=y", "keep_output=n"])
    assert o == QueryOptions(Strategy.SEMI, Orientation.DEGREE, 4, None, True, False)
    for word in ("strategy=x", "verify=maybe", "other=1", "batches"):
        with pytest.raises(GraphError):
            QueryOptions.parse([word])


def test_plans_have_no_cross_join(spark):
    e = edges(spark, K(5))
    for plan in PLANS:
        text = triangles.list_triangles(e, plan)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_wedges_are_dealt_over_more_tasks_than_cores(spark):
    e = edges(spark, K(12))
    wedge = triangles.wedges(e)
    assert sorted(map(tuple, wedge.collect())) == sorted((a, b, c) for a in range(12) for b in range(a) for c in range(b))
    assert wedge.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
