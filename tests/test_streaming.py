"""Triangles of a growing graph."""

from skein.operators.triangles import list_triangles
from skein.sources.rmat import rmat_graph, rmat_pairs
from skein.streaming.incremental import TriangleStream


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_add_up(spark, tmp_path):
    stream = TriangleStream(spark, str(tmp_path / "s"))
    assert rows(stream.triangles()) == [] == rows(stream.edges())
    raw = rmat_pairs(spark, 6, 6)
    for k in range(3):
        stream.add(raw.filter(f"(src + dst) % 3 = {k}"), k)
    whole = rmat_graph(spark, 6, 6)
    assert rows(stream.edges()) == rows(whole)
    assert rows(stream.triangles()) == rows(list_triangles(whole))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    stream = TriangleStream(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([(1, 0), (2, 1)], "src long, dst long")
    second = spark.createDataFrame([(0, 2), (1, 0), (3, 3)], "src long, dst long")
    stream.add(first, 0)
    stream.add(second, 1)
    once = rows(stream.triangles()), rows(stream.edges())
    stream.add(second, 1)
    assert (rows(stream.triangles()), rows(stream.edges())) == once == ([(2, 1, 0)], [(1, 0), (2, 0), (2, 1)])


def test_follows_a_file_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    raw = rmat_pairs(spark, 5, 6)
    raw.repartition(3).write.parquet(source)
    stream = TriangleStream(spark, str(tmp_path / "s"))
    files = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(source)
    stream.start(files).awaitTermination(120)
    assert rows(stream.triangles()) == rows(list_triangles(rmat_graph(spark, 5, 6)))
