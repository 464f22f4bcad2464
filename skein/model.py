"""Schemas, options and errors of the graph engine."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, null) for name, kind, null in fields])


#: One row per undirected edge, src > dst (or the orientation asked for), distinct.
EDGE = _schema(("src", LongType(), False), ("dst", LongType(), False))
#: One row per vertex with out-edges; neighbours distinct and ascending.
ADJ = _schema(("src", LongType(), False), ("nbrs", ArrayType(LongType(), False), False))
DEGREES = _schema(("v", LongType(), False), ("out_deg", LongType(), False), ("in_deg", LongType(), False))
CSR_OFFSETS = _schema(("v", LongType(), False), ("deg", LongType(), False), ("off", LongType(), False))
#: a > b > c.
TRIANGLE = _schema(("a", LongType(), False), ("b", LongType(), False), ("c", LongType(), False))
GRAPH_INFO = _schema(("n_vertices", LongType(), False), ("n_edges", LongType(), False), ("n_nonempty_rows", LongType(), False))
#: A sparse block in the binary layout of skein.sources.blocks.
BLOCK = _schema(("block_row", LongType(), False), ("block_col", LongType(), False), ("n_rows", LongType(), False), ("n_edges", LongType(), False), ("data", BinaryType(), False))
BLOCK_EDGE = _schema(("block_row", LongType(), False), ("block_col", LongType(), False), ("u", LongType(), False), ("v", LongType(), False))
BATCH = _schema(("batch", IntegerType(), False), ("n_triangles", LongType(), False))


class Strategy(str, Enum):
    """Interchangeable plans for triangle listing; all give the same rows."""

    AUTO = "auto"
    JOIN = "join"  # two equi-joins
    SEMI = "semi"  # wedge join, then left-semi join
    INTERSECT = "intersect"  # intersection of neighbour lists
    ARROW = "arrow"  # broadcast compressed rows, Arrow kernel; only for graphs of a checked size
    CELLS = "cells"  # Arrow kernel over cells of three vertex colours; what the first three become on larger graphs


class Orientation(str, Enum):
    ID = "id"  # from the larger id to the smaller
    DEGREE = "degree"  # from the vertex of lower (degree, id) to the higher: short lists on skewed graphs


class AttributeScope(str, Enum):
    """Over what a user aggregate runs."""

    NONE = "none"
    KEY = "key"
    PARTITION = "partition"
    GLOBAL = "global"


class GraphError(Exception):
    """Input that the engine refuses."""


class GraphFormatError(GraphError):
    """A binary block that breaks its layout."""


class GraphTooLarge(GraphError):
    """An option that is only for graphs of a bounded size."""


@dataclass(frozen=True)
class QueryOptions:
    """Options of a triangle query. None of them changes the rows of a result."""

    strategy: Strategy = Strategy.AUTO
    orientation: Orientation | None = None  # None: by the graph's largest out-degree
    batches: int = 1  # bounded output: the query runs in so many disjoint parts
    partitions: int | None = None  # shuffle partitions of the heavy step
    balance: bool = False  # deal edges out by estimated work instead of by key
    keep_output: bool = True  # False: compute every row, but write it nowhere
    verify: bool = False

    @classmethod
    def parse(cls, args: list[str]) -> QueryOptions:
        """key=value words; booleans are y or n."""
        kinds = {"strategy": Strategy, "orientation": Orientation, "batches": int, "partitions": int, "balance": _yes, "keep_output": _yes, "verify": _yes}
        out = {}
        for word in args:
            key, eq, value = word.partition("=")
            if not eq or key not in kinds:
                raise GraphError(f"not an option: {word}")
            try:
                out[key] = kinds[key](value)
            except ValueError as e:
                raise GraphError(f"{key}: {value}") from e
        return cls(**out)


def _yes(value: str) -> bool:
    if value not in ("y", "n"):
        raise ValueError(value)
    return value == "y"


@dataclass(frozen=True)
class Graph:
    """A named graph: canonical edges (EDGE, larger id first) and where they came from."""

    edges: DataFrame
    name: str = "graph"

    def info(self) -> DataFrame:
        from skein.operators.metadata import graph_info

        return graph_info(self.edges)

    def cached(self) -> Graph:
        return Graph(self.edges.persist(), self.name)

    def close(self) -> None:
        self.edges.unpersist()

    def is_cached(self) -> bool:
        return self.edges.is_cached


def as_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The two id columns as longs; ids from 2**63 on don't fit and are refused when evaluated (ANSI cast)."""
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
