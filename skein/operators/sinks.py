"""Where results go, and checks of them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.model import GraphError, QueryOptions
from skein.operators.triangles import count_triangles, list_triangles, planned


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_nowhere(df: DataFrame) -> None:
    """Compute every row and write none."""
    df.write.format("noop").mode("overwrite").save()


def verified(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """n_listed, n_counted, ok: rows of a listing against the count query."""
    listed = triangles.agg(F.count(F.lit(1)).alias("n_listed")).select("n_listed", F.lit(0).cast("long").alias("n_counted"))
    counted = count_triangles(edges).select(F.lit(0).cast("long").alias("n_listed"), F.col("n").alias("n_counted"))
    both = listed.union(counted).agg(F.sum("n_listed").alias("n_listed"), F.sum("n_counted").alias("n_counted"))  # of two rows
    return both.select("n_listed", "n_counted", (F.col("n_listed") == F.col("n_counted")).alias("ok"))


def printed(triangles: DataFrame, most: int = 20) -> list[str]:
    """The first rows in order, numbered, as [a, b, c]."""
    rows = triangles.orderBy("a", "b", "c").limit(most).collect()
    return [f"{k}: [{r['a']}, {r['b']}, {r['c']}]" for k, r in enumerate(rows, 1)]


def triangle_batches(edges: DataFrame, options: QueryOptions) -> Iterator[DataFrame]:
    """Disjoint parts of the triangle listing, one at a time: output of bounded size.

    A part has the triangles found from the sources whose id leaves its number as the
    remainder by options.batches, by the plan that options ask for; what the parts share
    is made once.
    """
    plan = planned(edges, options)
    for k in range(options.batches):
        yield plan(F.pmod(F.col("src"), F.lit(options.batches)) == k)


def batch_counts(edges: DataFrame, batches: int) -> DataFrame:
    """BATCH: triangles of every batch, empty ones included."""
    ids = edges.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch"))
    n = list_triangles(edges, QueryOptions()).groupBy(F.pmod(F.col("a"), F.lit(batches)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(n, ids["batch"] == n["k"], "left").select("batch", F.coalesce("n", F.lit(0).cast("long")).alias("n_triangles"))


@dataclass(frozen=True)
class Report:
    """What a run did."""

    n_triangles: int
    seconds: float
    batches: list[int]
    ok: bool | None


def run(edges: DataFrame, options: QueryOptions = QueryOptions(), path: str | None = None) -> Report:
    """List triangles into path (Parquet), in batches if asked for; without path or keep_output, into nowhere.

    The number of rows is observed while they are written, so nothing is computed twice;
    with verify it must equal the count query's.
    """
    began, counts = time.perf_counter(), []
    parts = [list_triangles(edges, options)] if options.batches == 1 else triangle_batches(edges, options)
    for k, part in enumerate(parts):
        seen = Observation(f"batch {k}")
        part = part.observe(seen, F.count(F.lit(1)).alias("n"))
        if path and options.keep_output:
            write_parquet(part, path, "append" if k else "overwrite")
        else:
            write_nowhere(part)
        counts.append(int(seen.get["n"]))
    ok = None
    if options.verify:
        ok = count_triangles(edges).head()["n"] == sum(counts)
        if not ok:
            raise GraphError("listed and counted triangles differ")
    return Report(sum(counts), time.perf_counter() - began, counts, ok)
