"""python -m skein NAME FOLDER MEMORY_MB CHUNKS CHUNK_SIZE BALANCE DOUBLE_BUFFER ONLY_KERNEL VERIFY [key=value ...]

Lists the triangles of the graph NAME in FOLDER and prints what it is and what was
found. The graph is FOLDER/NAME.graph (a block file, or a folder of them), NAME.parquet,
NAME.csv or NAME.txt, whichever is there. BALANCE, ONLY_KERNEL and VERIFY are y or n:
deal edges out by work; compute every row but write none; compare with the count query.
MEMORY_MB, CHUNKS, CHUNK_SIZE and DOUBLE_BUFFER size output buffers of an engine that
has them; here rows stream through Spark, and they are read and checked but change
nothing. key=value words set further options (skein.model.QueryOptions) and out=FOLDER
where triangles go as Parquet; without it they are computed and not kept.
"""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from skein.model import Graph, GraphError, QueryOptions
from skein.operators import sinks
from skein.operators.metadata import graph_info
from skein.sources import blocks, edges

USAGE = __doc__


def open_graph(spark: SparkSession, folder: str, name: str) -> Graph:
    """The graph of that name, by the first of the known files that is there."""
    base = f"{folder.rstrip('/')}/{name}"
    readers = {
        ".graph": lambda p: Graph(blocks.read_block_files(spark, p), name),
        ".parquet": lambda p: edges.from_parquet(spark, p),
        ".csv": lambda p: edges.from_csv(spark, p),
        ".txt": lambda p: edges.from_text(spark, p),
    }
    for suffix, read in readers.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(base + suffix)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return Graph(read(base + suffix).edges, name)
    raise GraphError(f"no graph {base} with one of {', '.join(readers)}")


def parsed(words: list[str]) -> tuple[str, str, QueryOptions, str | None]:
    """Name, folder, options and output folder of a command line."""
    if len(words) < 9:
        raise GraphError(USAGE)
    name, folder, *sizes = words[:5]
    balance, double, only_kernel, verify = words[5:9]
    if not all(x.isdigit() for x in sizes):
        raise GraphError("MEMORY_MB, CHUNKS and CHUNK_SIZE are numbers")
    out = None
    rest = []
    for word in words[9:]:
        if word.startswith("out="):
            out = word[4:]
        else:
            rest.append(word)
    flags = QueryOptions.parse([f"balance={balance}", f"verify={verify}", *rest])
    only = QueryOptions.parse([f"keep_output={only_kernel}", f"balance={double}"]).keep_output
    return name, folder, replace(flags, keep_output=not only and flags.keep_output), out


def main(words: list[str], spark: SparkSession | None = None) -> sinks.Report:
    name, folder, options, out = parsed(words)
    spark = spark or SparkSession.builder.appName(f"triangles of {name}").getOrCreate()
    graph = open_graph(spark, folder, name).cached()
    try:
        info = graph_info(graph.edges).head()
        print(f"Name: {name}\n# of vertices: {info['n_vertices']}\n# of edges: {info['n_edges']}")
        report = sinks.run(graph.edges, options, out)
        print(f"# of triangles: {report.n_triangles}\nElapsed: {report.seconds:.3f} s" + ("\nVerified: y" if report.ok else ""))
        return report
    finally:
        graph.close()


if __name__ == "__main__":
    try:
        main(sys.argv[1:])
    except GraphError as e:
        sys.exit(str(e))
