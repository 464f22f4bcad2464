"""Triangles by cells: every edge travels a few times, no wedge travels at all.

Vertices are dealt into colours by a hash. A cell is a multiset of three colours and gets
the edges between any two of them, so every triangle lies in exactly one cell, that of
its corners' colours, and an edge in as many cells as there are colours. The number of
colours follows from the number of edges, so that a cell has about CELL_EDGES of them.

Edges travel packed: sorted, as differences in the narrowest integers, compressed. In a
cell each vertex's smaller neighbours are words of 64 places; for every edge (a, b) the
words of b meet those of a, and a bit left is a triangle (a, b, c). Steps are of bounded
length (STEP words of b, PLACES words of a, ROWS rows of output).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import TRIANGLE
from skein.plans.physical import cut_lineage, parallelism

#: Edges that a cell has on average.
CELL_EDGES = 3_000_000
#: Edges that one packed row holds at most.
PACKED_EDGES = 1 << 20
STEP, PLACES, ROWS = 1 << 20, 1 << 22, 1 << 18
SCHEMA = "n long, data binary"


# -- packing


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of at least 0 in the narrowest type, its size in front."""
    most = int(x.max()) if len(x) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def pack(src: np.ndarray, dst: np.ndarray, *more: np.ndarray) -> bytes:
    """Edges (longs) and further columns of numbers of at least 0, by src, then dst."""
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
    step = np.diff(dst, prepend=dst[:1])
    head = dst[first]
    step[first] = 0
    columns = [np.diff(src[first].view(np.uint64), prepend=np.uint64(0)), np.diff(np.r_[first, len(src)]).view(np.uint64), head.view(np.uint64), step.view(np.uint64)]
    parts = [_narrow(c) for c in columns] + [_narrow(m[order].astype(np.uint64)) for m in more]
    body = b"".join(parts)
    return np.array([len(src), len(first), len(body)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes, more: int = 0) -> list[np.ndarray]:
    """src, dst and the further columns of pack()."""
    n, rows, size = (int(x) for x in np.frombuffer(data, "<i8", 3))
    body = pa.decompress(data[24:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    at, out = 0, []
    for count in (rows, rows, rows, n, *[n] * more):
        width = body[at]
        out.append(np.frombuffer(body, f"<u{width}", count, at + 1).astype(np.uint64))
        at += 1 + width * count
    gap, length, head, step = out[:4]
    length = length.astype(np.int64)
    src = np.repeat(np.cumsum(gap, dtype=np.uint64).view(np.int64), length)
    run = np.cumsum(step, dtype=np.uint64)
    first = np.cumsum(length) - length
    dst = (run + np.repeat(head - run[first], length)).view(np.int64) if n else np.zeros(0, np.int64)
    return [src, dst, *(m.astype(np.int64) for m in out[4:])]


def packed(edges: DataFrame) -> DataFrame:
    """n, data: the edges, checkpointed; each in one row of at most PACKED_EDGES."""

    def run(batches):
        held, n = [], 0

        def done():
            s, d = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int64()), pa.array([pack(s, d)], pa.binary())], ["n", "data"])

        for b in batches:
            for at in range(0, b.num_rows, PACKED_EDGES):
                part = b.slice(at, PACKED_EDGES)
                if n + part.num_rows > PACKED_EDGES:
                    yield done()
                    held, n = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                n += part.num_rows
        if n:
            yield done()

    return cut_lineage(edges.select("src", "dst").mapInArrow(run, SCHEMA))


def unpacked(rows: DataFrame) -> DataFrame:
    """src, dst: the edges of packed()."""

    def run(batches):
        for b in batches:
            for x in b.column(1):
                src, dst = unpack(x.as_py())
                for i in range(0, len(src), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(src[i : i + (1 << 16)]), pa.array(dst[i : i + (1 << 16)])], ["src", "dst"])

    got = rows.mapInArrow(run, "src long, dst long")
    return got.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("src", "dst")])  # ids are never null


# -- cells


def colours(ids: np.ndarray, number: int) -> np.ndarray:
    x = ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(number)).astype(np.int64)


def n_colours(edges: int, parts: int, cell: int) -> int:
    """So many that a cell's share of the edges is about `cell`, and that all of so many parts get cells if there are edges enough."""
    n = max(1, int(np.ceil((6 * edges / cell) ** 0.5)))
    while n * (n + 1) * (n + 2) // 6 < min(parts, edges // 20_000):
        n += 1
    return n


def cells_of(number: int) -> list[tuple[int, int, int]]:
    return list(combinations_with_replacement(range(number), 3))


def in_cells(rows: DataFrame, number: int, parts: int) -> DataFrame:
    """cell, n, data: packed edges between the colours of each cell, dealt out by cell."""
    at: dict[tuple[int, int], list[int]] = {}
    for k, (i, j, l) in enumerate(cells_of(number)):
        for pair in {(i, j), (j, l), (i, l)}:
            # Of a cell with a colour twice and another, all three pairs count but that of the other with itself.
            at.setdefault(pair, []).append(k)

    def run(batches):
        for b in batches:
            for x in b.column(1):
                src, dst = unpack(x.as_py())
                s, d = colours(src, number), colours(dst, number)
                pair = np.minimum(s, d) * number + np.maximum(s, d)
                order = np.argsort(pair, kind="stable")
                pair, src, dst = pair[order], src[order], dst[order]
                cut = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(pair)], strict=True):
                    to = at[divmod(int(pair[i]), number)]
                    data = pack(src[i:j], dst[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([j - i] * len(to), pa.int64()), pa.array([data] * len(to), pa.binary())], ["cell", "n", "data"])

    spread = rows.mapInArrow(run, f"cell long, {SCHEMA}")
    return spread.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell")


def meetings(src: np.ndarray, dst: np.ndarray, colour: np.ndarray | None, ids: np.ndarray, single: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """edge, block, bits: for edges (places in ids, by src, dst) the words of both ends' neighbours, where they meet.

    colour: of each place, if the cell has one colour twice and `single` once; then only
    triangles with exactly one corner of that colour count.
    """
    blocks = (len(ids) + 63) // 64
    block = dst >> 6
    new = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (block[1:] != block[:-1])])
    word = np.bitwise_or.reduceat(np.uint64(1) << (dst & 63).astype(np.uint64), new)
    owner, at = src[new], block[new]
    first = np.searchsorted(owner, np.arange(len(ids) + 1))  # each place's words
    only = None
    if colour is not None:
        lone = np.zeros(blocks * 64, dtype=bool)
        lone[: len(ids)] = colour == single
        only = np.packbits(lone, bitorder="little").view(np.uint64)
    size = first[dst + 1] - first[dst]
    use = np.flatnonzero(size > 0)  # edges in order of src
    rows = max(1, PLACES // blocks)
    table = np.zeros(rows * blocks, dtype=np.uint64)
    low = 0
    edge_src = src[use]
    while low < len(use):
        base = int(edge_src[low])
        high = int(np.searchsorted(edge_src, base + rows))
        own = slice(int(first[base]), int(first[min(base + rows, len(ids))]))
        places = (owner[own] - base) * blocks + at[own]
        table[places] = word[own]
        ends = np.cumsum(size[use[low:high]])
        step = 0
        while step < high - low:
            done = int(ends[step - 1]) if step else 0
            stop = max(step + 1, int(np.searchsorted(ends, done + STEP, side="right")))
            e = use[low + step : low + stop]
            m = size[e]
            edge = np.repeat(e, m)
            w = np.repeat(first[dst[e]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            bits = table[(src[edge] - base) * blocks + at[w]] & word[w]
            hit = np.flatnonzero(bits)
            edge, w, bits = edge[hit], at[w[hit]], bits[hit]
            if only is not None:
                both = (colour[src[edge]] != single) & (colour[dst[edge]] != single)
                bits = np.where(both, bits & only[w], bits & ~only[w])
                hit = np.flatnonzero(bits)
                edge, w, bits = edge[hit], w[hit], bits[hit]
            if len(edge):
                yield edge, w, bits
            step = stop
        table[places] = 0
        low = high


def _cell_edges(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """cell, src, dst of each cell in turn."""
    at, held = None, []
    for b in batches:
        for cell, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if cell != at:
                if held:
                    yield at, *(np.concatenate([h[k] for h in held]) for k in (0, 1))
                at, held = cell, []
            held.append(unpack(x.as_py()))
    if held:
        yield at, *(np.concatenate([h[k] for h in held]) for k in (0, 1))


def _met(batches, number: int) -> Iterator[tuple]:
    """For each cell: cell, ids, src, dst (places), and its meetings()."""
    kinds = cells_of(number)
    for cell, src, dst in _cell_edges(batches):
        ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
        src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order = np.argsort(src * len(ids) + dst)
        src, dst = src[order], dst[order]
        i, j, k = kinds[cell]
        twice = i != k and (i == j or j == k)
        single = k if i == j else i
        yield cell, ids, src, dst, meetings(src, dst, colours(ids, number) if twice else None, ids, single)


class Cells:
    """A graph's edges, packed and counted; its triangles are listed or counted by cells."""

    def __init__(self, edges: DataFrame, partitions: int | None = None, balance: bool = False):
        self.rows = packed(edges)
        self.n_edges = int(self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0])
        parts = partitions or parallelism(edges)
        self.number = n_colours(self.n_edges, 4 * parts if balance else parts, CELL_EDGES)  # balanced: smaller cells, several a part
        self.parts = max(1, min(len(cells_of(self.number)), 20_000) if partitions is None else partitions)

    def edges(self) -> DataFrame:
        return unpacked(self.rows)

    def _dealt(self) -> DataFrame:
        return in_cells(self.rows, self.number, self.parts)

    def triangles(self) -> DataFrame:
        """a, b, c."""
        number = self.number

        def run(batches):
            for _, ids, src, dst, met in _met(batches, number):
                for edge, w, bits in met:
                    n = np.bitwise_count(bits).astype(np.int64)
                    upto = np.cumsum(n)
                    a, b, c = ids[src[edge]], ids[dst[edge]], w * 64
                    i = 0
                    while i < len(edge):
                        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + ROWS, side="right")))
                        bit = np.flatnonzero(np.unpackbits(bits[i:j].view(np.uint8), bitorder="little"))
                        bit += np.repeat(c[i:j] - np.arange(0, 64 * (j - i), 64), n[i:j])  # the place: a word's first, and where the bit is in it
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a[i:j], n[i:j])), pa.array(np.repeat(b[i:j], n[i:j])), pa.array(ids[bit])], ["a", "b", "c"])
                        i = j

        return self._dealt().mapInArrow(run, TRIANGLE)

    def count(self) -> DataFrame:
        """n."""
        number = self.number

        def run(batches):
            for _, _, _, _, met in _met(batches, number):
                n = sum(int(np.bitwise_count(bits).sum(dtype=np.int64)) for _, _, bits in met)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return self._dealt().mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))

    def support(self) -> DataFrame:
        """a, b, n_common for every edge, zeros included: each cell's counts, packed, added up for each pair of colours."""
        number, kinds = self.number, cells_of(self.number)

        def counted(batches):
            for cell, ids, src, dst, met in _met(batches, number):
                n = np.zeros(len(src), dtype=np.int64)
                for edge, _, bits in met:
                    np.add.at(n, edge, np.bitwise_count(bits).astype(np.int64))
                colour = colours(ids, number)
                s, d = colour[src], colour[dst]
                pair = np.minimum(s, d) * number + np.maximum(s, d)
                i, j, k = kinds[cell]
                for p in np.unique(pair).tolist():
                    # One cell of each pair tells of all its edges, (x, x, y) of the pair x <= y; others of what they found.
                    x, y = divmod(p, number)
                    at = np.flatnonzero((pair == p) & ((n > 0) | ((i, j, k) == (x, x, y))))
                    for lo in range(0, len(at), PACKED_EDGES):
                        some = at[lo : lo + PACKED_EDGES]
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([pack(ids[src[some]], ids[dst[some]], n[some])], pa.binary())], ["pair", "data"])

        def added(batches):
            at, held = None, []

            def done():
                a, b, n = (np.concatenate([h[k] for h in held]) for k in range(3))
                order = np.lexsort((b, a))
                a, b, n = a[order], b[order], n[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                a, b, n = a[new], b[new], np.add.reduceat(n, new)
                for lo in range(0, len(a), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in (a, b, n)], ["a", "b", "n_common"])

            for batch in batches:
                for pair, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if pair != at and held:
                        yield from done()
                        held = []
                    at = pair
                    held.append(unpack(x.as_py(), 1))
            if held:
                yield from done()

        parts = max(1, min(number * (number + 1) // 2, 20_000))
        found = self._dealt().mapInArrow(counted, "pair long, data binary")
        return found.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(added, "a long, b long, n_common long")
