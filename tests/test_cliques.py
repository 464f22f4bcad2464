"""Triangles of graphs that are given by groups."""

from itertools import combinations

import numpy as np
import pytest

from skein.operators import cliques


def brute(rows):
    """Triangles of the graph of members that share a group."""
    members: dict = {}
    for v, *g in rows:
        if v is not None and None not in g:
            members.setdefault(tuple(g), set()).add(v)
    edges = {pair for m in members.values() for pair in combinations(sorted(m), 2)}
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    return sum(len(after[a] & after.get(b, set())) for a, b in edges)


def table(seed, users, groups, members, copies):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(users)) - 9, f"g{r.integers(groups)}", int(r.integers(2))) for _ in range(members)]
    rows = [(v + k * 1000 * (v % 2), g, h) for k in range(copies) for v, g, h in rows]  # copies of the odd ones only
    return [*rows, (None, "g0", 0), (3, None, 0), (3, "g0", None), (70_000, "alone", 0)]


@pytest.mark.parametrize("number", [1, 2, 4])
@pytest.mark.parametrize("copies", [1, 3])
def test_counts_of_groups_equal_brute_force(spark, monkeypatch, number, copies):
    rows = table(number, 90, 12, 400, copies)
    df = spark.createDataFrame(rows, "v int, g string, h int")
    got = cliques.Classes(df, "v", "g", "h")
    assert got.dense() and (got.n < got.n_vertices) == (copies > 1)
    monkeypatch.setattr(cliques, "COLOUR", -(-got.n // number))
    assert got.count().head()["n"] == brute(rows) > 0


@pytest.mark.parametrize("side", [8, 1024])
@pytest.mark.parametrize("kind", [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 2)])
def test_cells_of_every_kind(monkeypatch, kind, side):
    monkeypatch.setattr(cliques, "SIDE", side)
    monkeypatch.setattr(cliques, "RECTANGLE", 12)
    monkeypatch.setattr(cliques, "STEP", 50)
    r = np.random.default_rng(3)
    n, w = 45, np.r_[1 << 23, 1 << 23, r.integers(1, 4, 43)]  # beyond what singles count exactly
    member = np.array([(g, v) for g in range(30) for v in np.flatnonzero(r.random(n) < 0.02 * (g % 9))])
    share = np.zeros((30, n), dtype=int)
    share[member[:, 0], member[:, 1]] = 1
    adj = (share.T @ share > 0) & ~np.eye(n, dtype=bool)
    colour = np.arange(n) % 3
    of = [int(x) for x in w]
    want = sum(of[a] * of[b] * of[c] for a, b, c in combinations(range(n), 3) if adj[a, b] and adj[b, c] and adj[a, c] and sorted(colour[[a, b, c]]) == list(kind))
    choose = lambda x, k: x * (x - 1) // 2 if k == 2 else x * (x - 1) * (x - 2) // 6
    if kind in ((0, 0, 0), (0, 0, 1)):
        ends = [kind[0], kind[2]]
        want += sum(choose(of[a], 2) * of[b] + of[a] * choose(of[b], 2) for a, b in combinations(range(n), 2) if adj[a, b] and sorted(colour[[a, b]]) == ends)
    if kind == (0, 0, 0):
        want += sum(choose(of[a], 3) for a in range(n) if colour[a] == 0 and share[:, a].any())
    g, v = member.T
    held = {c: [[g[colour[v] == c], v[colour[v] == c], w[v[colour[v] == c]]]] for c in set(kind)}
    assert cliques._count_cell(kind, held) == want


def test_sparse_and_empty_tables(spark):
    rows = [(v, v // 3) for v in range(600)] + [(v, -v) for v in range(0, 600, 5)]
    df = spark.createDataFrame(rows, "v long, g long")
    few = cliques.Classes(df, "v", "g")
    assert not few.dense() and cliques.count_triangles_of_groups(df, "v", "g").head()["n"] == 200 == few.count().head()["n"]
    assert cliques.count_triangles_of_groups(df.limit(0), "v", "g").head()["n"] == 0


def test_the_user_count_ships_no_edges(spark, sf):
    from skein.queries import QUERIES

    plan = QUERIES["triangles_count_user"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "src" not in plan
