"""Triangles by cells: no shuffle of wedges."""

import numpy as np
import pytest

from skein.model import TRIANGLE, QueryOptions, Strategy
from skein.operators import triangles
from skein.plans import cells
from skein.sources.rmat import rmat_graph


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_packed_edges_come_back():
    r = np.random.default_rng(1)
    for ids in (1, 200, 1 << 20, 1 << 62):
        src, dst = np.unique(r.integers(-ids, ids, (500, 2)), axis=0).T
        n = r.integers(0, 70_000, len(src))
        got = cells.unpack(cells.pack(src[::-1], dst[::-1], n[::-1]), 1)
        assert [x.tolist() for x in got] == [src.tolist(), dst.tolist(), n.tolist()]


@pytest.mark.parametrize("number", [1, 2, 5])
@pytest.mark.parametrize("step", [7, 1 << 20])
def test_cells_equal_the_other_plans(spark, monkeypatch, number, step):
    e = rmat_graph(spark, 8).persist()
    want = rows(triangles.list_triangles(e, Strategy.SEMI))
    support = rows(triangles.edge_intersection(e))
    monkeypatch.setattr(triangles, "FEW_EDGES", 0)
    monkeypatch.setattr(cells, "n_colours", lambda *a: number)
    if step == 7:  # loops of the driver only; workers import their own module
        ids = np.arange(40) * 3
        src, dst = np.nonzero(np.tril(np.random.default_rng(2).random((40, 40)) < 0.3, -1))
        monkeypatch.setattr(cells, "STEP", step)
        monkeypatch.setattr(cells, "PLACES", 3)
        n = sum(int(np.bitwise_count(bits).sum()) for _, _, bits in cells.meetings(src, dst, None, ids, 0))
        adj = np.zeros((40, 40), dtype=int)
        adj[src, dst] = 1
        assert n == int((adj @ adj * adj).sum()) > 0
        return
    assert rows(triangles.list_triangles(e, Strategy.CELLS)) == want
    assert rows(triangles.list_triangles(e, QueryOptions(strategy=Strategy.JOIN, partitions=3, balance=True))) == want
    assert triangles.count_triangles(e).head()["n"] == len(want)
    assert rows(triangles.bitmap_support(e)) == support
    e.unpersist()


def test_larger_graphs_shuffle_no_wedges(spark, monkeypatch):
    e = rmat_graph(spark, 8)
    monkeypatch.setattr(triangles, "FEW_EDGES", 10)
    for strategy in (Strategy.JOIN, Strategy.SEMI, Strategy.INTERSECT, Strategy.AUTO):
        plan = triangles.list_triangles(e, strategy)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") == 2
    plan = triangles.count_triangles(e)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "Join" not in triangles.bitmap_support(e)._jdf.queryExecution().executedPlan().toString()


def test_no_limit_on_the_queries_by_arrow(spark, sf, monkeypatch):
    from skein.queries import QUERIES

    monkeypatch.setattr(triangles, "ARROW_EDGES", 5)
    for name in ("triangles_list_arrow", "triangles_list_arrow_balanced"):
        assert QUERIES[name](spark, sf).count() == 125_968


def test_rows_of_larger_graphs_are_never_null(spark, monkeypatch):
    """Nullable columns cost a check of every value, and a level of every value in Parquet."""
    e = rmat_graph(spark, 8).persist()
    want = rows(triangles.list_triangles(e, Strategy.SEMI))
    monkeypatch.setattr(triangles, "FEW_EDGES", 0)
    got = triangles.list_triangles(e)
    assert got.schema == TRIANGLE and rows(got) == want
    e.unpersist()
