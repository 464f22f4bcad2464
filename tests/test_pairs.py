"""Graphs of pairs that share a group, by sorted groups or by cells of two colours."""

import numpy as np
import pytest

from skein.sources import edges


def brute(rows):
    groups = {}
    for g, v in rows:
        if g is not None and v is not None:
            groups.setdefault(g, set()).add(v)
    return sorted({(x, y) for vs in groups.values() for x in vs for y in vs if x > y})


@pytest.mark.parametrize(("members", "steps", "flags"), [(1 << 21, 1 << 22, 1 << 26), (40, 50, 64), (40, 7, 0), (300, 1 << 22, 1)])
def test_pairs_by_cells_equal_brute_force(spark, monkeypatch, members, steps, flags):
    for name, x in (("CELL_MEMBERS", members), ("STEP_PAIRS", steps), ("FLAGS", flags)):
        monkeypatch.setattr(edges, name, x)
    r = np.random.default_rng(4)
    ids = [-(1 << 62), -1, 0, 1 << 62, *range(5, 60)]
    rows = [(int(g), ids[v]) for g, v in zip(r.integers(0, 12, 400), r.integers(0, len(ids), 400), strict=True)]
    rows += [(99, v) for v in ids[:40]] + [(100, 3), (101, None), (None, 4), (None, 5), (102, 7), (102, 7)]
    df = spark.createDataFrame(rows, "g long, v long")
    assert sorted(map(tuple, edges._pairs_by_cells(df, "v", "g").collect())) == brute(rows)


def test_pairs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g long, v long")
    assert edges._pairs_by_cells(df, "v", "g").collect() == []


def test_user_pairs_are_not_shuffled(spark, sf, monkeypatch):
    monkeypatch.setattr(edges, "CELL_MEMBERS", 500)
    plan = edges.user_graph(spark, str(sf))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" in plan
    assert "hashpartitioning(src" not in plan


@pytest.mark.parametrize(("steps", "repeats", "batch"), [(1 << 22, 1 << 18, 10_000), (7, 1 << 18, 3), (50, 10, 1), (1 << 22, 100, 50)])
def test_pairs_equal_brute_force(spark, monkeypatch, steps, repeats, batch):
    r = np.random.default_rng(5)
    ids = [-(1 << 62), -1, 0, 1 << 62, *range(5, 60)]
    rows = [(int(g), ids[v]) for g, v in zip(r.integers(0, 30, 500), r.integers(0, len(ids), 500), strict=True)]
    rows += [(99, v) for v in ids[:40]] + [(100, 3), (101, None), (None, 4), (None, 5), (102, 7), (102, 7), (1 << 62, 1), (1 << 62, 2)]
    monkeypatch.setattr(edges, "STEP_PAIRS", steps)
    monkeypatch.setattr(edges, "REPEAT_PAIRS", repeats)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "g long, v long")
        assert sorted(map(tuple, edges._pairs(df, "v", "g").collect())) == brute(rows)
        two = df.selectExpr("cast(g as string) AS g", "timestamp_micros(g % 3) AS t", "v")
        want = brute([(g is not None and (g, g - 3 * int(g / 3)), v) for g, v in rows if g is not None])
        assert sorted(map(tuple, edges._pairs(two, "v", "g", "t").collect())) == want
        assert edges._pairs(df.limit(0), "v", "g").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_travel_once(spark, sf):
    plan = edges.supplier_graph(spark, str(sf))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # members by their group, pairs to be made distinct


def test_repeats_go_while_they_are_many(monkeypatch):
    monkeypatch.setattr(edges, "REPEAT_PAIRS", 100)
    one = edges.pa.RecordBatch.from_pydict({"src": [5, 5, 6, 7] * 30, "dst": [1, 1, 1, 2] * 30})
    got = list(edges._fewer_repeats(iter([one] * 3)))
    assert [b.num_rows for b in got] == [3, 3, 3]
    other = edges.pa.RecordBatch.from_pydict({"src": list(range(200, 320)), "dst": [1] * 120})
    assert sum(b.num_rows for b in edges._fewer_repeats(iter([other, one, one]))) == 360
