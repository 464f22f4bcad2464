"""Edges from files and tables, and graphs derived from relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph, as_edges
from skein.operators.prepare import canonical_edges
from skein.plans.physical import parallelism

#: Members that a cell of _pairs_by_cells() has on average, and those of a group that one list holds.
CELL_MEMBERS, LIST_MEMBERS = 2_000_000, 1_000_000
#: Pairs that a step of a cell makes, and flags of pairs that it holds.
STEP_PAIRS, FLAGS = 1 << 22, 1 << 26
#: Pairs that _pairs() looks through for repeats at once.
REPEAT_PAIRS = 1 << 18


def from_parquet(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> Graph:
    return Graph(canonical_edges(spark.read.parquet(path), src, dst), path)


def from_csv(spark: SparkSession, path: str, header: bool = False, sep: str = ",") -> Graph:
    """Two columns of ids, under an explicit schema."""
    rows = spark.read.schema("src long, dst long").csv(path, header=header, sep=sep)
    return Graph(canonical_edges(rows), path)


def from_text(spark: SparkSession, path: str) -> Graph:
    """Lines of two ids with white space between; empty lines and lines that begin with # are skipped."""
    line = F.trim(F.col("value"))
    words = F.split(line, r"\s+")
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(words[0].cast("long").alias("src"), words[1].cast("long").alias("dst"))
    return Graph(canonical_edges(rows), path)


def from_table(spark: SparkSession, name: str, src: str = "src", dst: str = "dst") -> Graph:
    return Graph(canonical_edges(spark.table(name), src, dst), name)


def saved(graph: Graph, path: str, files: int = 8, mode: str = "errorifexists") -> None:
    """Write edges in ranges of src, so that later row range filters prune files and row groups."""
    graph.edges.repartitionByRange(files, "src", "dst").sortWithinPartitions("src", "dst").write.mode(mode).parquet(path)


def _pairs(rows: DataFrame, vertex: str, *group: str) -> DataFrame:
    """EDGE between distinct vertices that share all group columns (ids, times or texts).

    Members travel once, to the task that has their group, and are sorted there; all pairs
    of a group are the definition of such a graph. Pairs are made distinct where they are
    dealt to: hashing them before as well costs more than it saves, unless many are repeats.
    """
    once = rows.select(*group, F.col(vertex).cast("long").alias("v")).dropna()
    # By number: adaptive execution would coalesce members of few bytes that make many pairs.
    n = parallelism(rows)
    dealt = once.repartition(n, *group).sortWithinPartitions(*group, "v")
    got = dealt.mapInArrow(lambda batches: _fewer_repeats(_group_pairs(batches)), "src long, dst long")
    pairs = got.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("src", "dst")])  # ids are never null
    return pairs.repartition(n, "src", "dst").distinct()


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst: the pairs inside each group of sorted rows, whose last column is the member; a group may go on over batches."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        groups, v = b.columns[:-1], b.column(b.num_columns - 1).to_numpy()
        new = np.zeros(len(v), dtype=bool)
        for c in groups:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        new[0] = key != [c[0] for c in groups]
        key = [c[-1] for c in groups]
        heads = np.flatnonzero(new)
        if len(heads):
            before = sum(map(len, held))
            closed = np.concatenate([*held, v[: heads[-1]]])
            yield from _sorted_pairs(closed, np.unique(np.r_[0, before + heads[:-1]]))
            held, v = [], v[heads[-1] :]
        held.append(v)
    if held:
        yield from _sorted_pairs(np.concatenate(held), np.zeros(1, dtype=np.int64))


def _sorted_pairs(v: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """src, dst: each member with the lesser ones of its group; groups begin at heads and are sorted, with repeats."""
    if not len(v):
        return
    keep = np.r_[True, v[1:] != v[:-1]]
    keep[heads] = True
    v, heads = v[keep], np.cumsum(keep)[heads] - 1
    first = np.repeat(heads, np.diff(np.r_[heads, len(v)]))
    n = np.arange(len(v)) - first
    work = np.r_[0, np.cumsum(n)]
    lo = 0
    while lo < len(v):
        hi = max(int(np.searchsorted(work, work[lo] + STEP_PAIRS, side="right")) - 1, lo + 1)
        m = n[lo:hi]
        src = np.repeat(v[lo:hi], m)
        dst = v[np.repeat(first[lo:hi] - (np.cumsum(m) - m), m) + np.arange(len(src))]
        for i in range(0, len(src), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(src[i : i + (1 << 16)]), pa.array(dst[i : i + (1 << 16)])], ["src", "dst"])
        lo = hi


def _fewer_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same pairs with fewer repeats: distinct in every REPEAT_PAIRS or so, until that leaves more than half of them."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= REPEAT_PAIRS:
            fewer = _distinct_pairs(held)
            yield fewer
            if 2 * fewer.num_rows > sum(x.num_rows for x in held):
                yield from batches
                return
            held = []
    yield from held


def _distinct_pairs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    src, dst = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
    (s, own), (d, other) = (np.unique(x, return_inverse=True) for x in (src, dst))
    a, b = np.divmod(np.unique(own * len(d) + other), len(d))
    return pa.RecordBatch.from_arrays([pa.array(s[a]), pa.array(d[b])], ["src", "dst"])


def _pairs_by_cells(rows: DataFrame, vertex: str, *group: str) -> DataFrame:
    """The rows of _pairs(), for large groups: members travel, pairs don't.

    Vertices are dealt into colours by a hash. A cell is two colours, or one twice, and
    gets of every group the lists of members of its colours, so each pair of vertices lies
    in one cell, which makes it distinct; a member travels once for each colour. The
    number of colours follows from the numbers of members and of the largest group.
    """
    once = rows.select(*group, F.col(vertex).cast("long").alias("v")).dropna()
    sizes = once.groupBy(*group).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).head()
    n, most = sizes["n"] or 0, sizes["most"] or 0
    parts = parallelism(rows)
    number = max(1, -(-2 * n // CELL_MEMBERS), -(-most // LIST_MEMBERS))
    while number * (number + 1) // 2 < min(parts, n // 20_000):
        number += 1
    colour = F.pmod(F.xxhash64("v"), F.lit(number)).cast("int")
    lists = once.groupBy(*group, colour.alias("c")).agg(F.array_sort(F.collect_set("v")).alias("vs"))
    x, y = lists.alias("x"), lists.alias("y")  # one plan, so its shuffle is made once
    same = [F.col(f"x.{g}") == F.col(f"y.{g}") for g in group]
    cell = F.col("x.c").cast("long") * number + F.col("y.c")
    met = x.join(y.hint("merge"), [*same, F.col("x.c") <= F.col("y.c")])
    # Of one colour a cell gets the list once.
    met = met.select(cell.alias("cell"), F.col("x.vs").alias("us"), F.when(F.col("x.c") < F.col("y.c"), F.col("y.vs")).alias("vs"))
    dealt = met.repartition(min(max(parts, 1), number * (number + 1) // 2), "cell").sortWithinPartitions("cell")

    def run(batches):
        at, held = None, []
        for b in batches:
            cells = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != at:
                    if held:
                        yield from _cell_pairs(held)
                    at, held = cells[lo], []
                held.append((b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)))
        if held:
            yield from _cell_pairs(held)

    got = dealt.mapInArrow(run, "src long, dst long")
    return got.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("src", "dst")])  # ids are never null


def _cell_pairs(held: list[tuple[pa.ListArray, pa.ListArray]]) -> Iterator[pa.RecordBatch]:
    """src, dst: the distinct pairs between the first and the second list of each row, or inside the first if there is no second."""
    us, vs = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
    alone = held[0][1].null_count > 0  # so for a whole cell
    if alone:
        vs = us
    ids, own = np.unique(us.flatten().to_numpy(), return_inverse=True)
    far, other = np.unique(vs.flatten().to_numpy(), return_inverse=True)
    m = vs.value_lengths().to_numpy().astype(np.int64)
    first = np.cumsum(m) - m
    row = np.repeat(np.arange(len(m)), us.value_lengths().to_numpy())
    order = np.argsort(own, kind="stable")
    own, row = own[order], row[order]
    width, flags = len(far), np.zeros(0, dtype=bool)
    starts = np.searchsorted(own, np.arange(len(ids) + 1))
    work = np.r_[0, np.cumsum(m[row])]
    base = 0
    while base < len(ids):
        # So many of the first that they have about one step's pairs, one of them at least. Pairs are
        # flagged where that is no more than FLAGS and 32 flags a pair, else sorted.
        stop = int(np.searchsorted(work[starts], work[starts[base]] + STEP_PAIRS, side="right")) - 1
        stop = min(max(stop, base + 1), len(ids))
        fits = max(1, FLAGS // width)
        if stop - base > fits and int(work[starts[base + fits]] - work[starts[base]]) * 32 >= fits * width:
            stop = base + fits
        size, pairs, keys = (stop - base) * width, int(work[starts[stop]] - work[starts[base]]), []
        seen = size <= min(FLAGS, 32 * pairs)
        if seen and len(flags) < size:
            flags = np.zeros(size, dtype=bool)
        lo, end = int(starts[base]), int(starts[stop])
        while lo < end:
            hi = min(max(int(np.searchsorted(work, work[lo] + STEP_PAIRS, side="right")) - 1, lo + 1), end)
            n = m[row[lo:hi]]
            places = np.repeat(first[row[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.repeat((own[lo:hi] - base) * width, n) + other[places]
            if seen:
                flags[key] = True
            else:
                keys.append(np.unique(key))
            lo = hi
        if seen:
            hit = np.flatnonzero(flags[:size])
            flags[hit] = False
        else:
            hit = np.unique(np.concatenate(keys))
        a, b = np.divmod(hit, width)
        a, b = ids[a + base], far[b]
        ok = a > b if alone else a != b
        a, b = a[ok], b[ok]
        a, b = np.maximum(a, b), np.minimum(a, b)
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["src", "dst"])
        base = stop


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together."""
    return _pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_partkey", "l_orderkey")


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the same order."""
    return _pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_orderkey")


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a customer and of a supplier of their order. Pairs are made distinct after each join, so little is shuffled."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    buyers = read("orders", "o_orderkey", "o_custkey").join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = read("lineitem", "l_orderkey", "l_suppkey").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select("c_nationkey", "l_suppkey").distinct()
    both = sold.join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return canonical_edges(both, "c_nationkey", "s_nationkey")


def user_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hour: users are grouped by hour and event_type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("hour", F.date_trunc("hour", "ts"))


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an event of the same type in the same hour."""
    return _pairs_by_cells(user_groups(spark, sf_dir), "user_id", "hour", "event_type")


DERIVED = {"part": part_graph, "supp": supplier_graph, "nation": nation_graph, "user": user_graph}


def raw_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges as they are, not made canonical."""
    return as_edges(df, src, dst)
