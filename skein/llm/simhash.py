"""SimHash near-duplicates by bit-sliced comparison.

1. Every text gets a 64-bit fingerprint: bit b is set if it is set in over half of its
   word shingles' XXH64 hashes. Equal fingerprints are one node from here on.
2. Candidates: two fingerprints at most `radius` bits apart agree on at least k of
   radius + k bands of their bits, so every choice of k bands is a table whose key is
   those bits. For radius 4: 5 tables of 13 bits, 15 of 21, 35 of 27 and so on; the
   number of fingerprints decides, so that evenly filled buckets stay small. Every
   choice finds every link.
3. In every bucket (table and key) all pairs are compared bit-sliced: the buckets'
   fingerprints lie side by side as vertical bit planes, one lane each; a shifted copy
   of the planes holds every lane's partner at that distance, and carry-save counters
   add up the differing planes of 64 lanes with a few word operations. A block of
   lanes is abandoned once all of its counters exceed the radius. Buckets are ordered
   by size, so at every shift only the front lanes are live.
4. A bucket over BLOCK fingerprints is split into blocks; each pair of blocks is a
   task's unit of its own, so a bucket with a large share of all rows is dealt out
   over the cluster and memory stays bounded. Units hand on a spanning forest of their
   links (fewer links than fingerprints), not all pairs.
5. Components of these links: links are compacted to stars and their leaves set aside;
   the rest goes through rounds of hooking to smaller labels and pointer jumping, until
   nothing changes.

The filter drop_near_duplicates() has a wider net, by the same comparison: texts are
similar if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Fingerprints have 256 bits, of which similar texts may differ in 60; tables of random
bits find candidates with a stated chance of a miss (about N ** 0.24 tables), forests of
them give groups, and all pairs of a group are compared by their sets, in units of at
most BLOCK texts. Only sets of texts in groups are moved, once for each block of theirs.

Results for special inputs: a null text counts as empty. A text without words has
fingerprint zero, which is linked like any other. A null doc_id takes part, and
component_id is null only if every doc_id of the component is. Repeated rows each
give a row. An empty table gives an empty table. Extra columns are ignored. Texts
are hashed whole, in slices of bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import among, bounded_batches, checkpointed, id_and_text, keyed, stored, without

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fixed: A to Z in lower case, other characters as they are.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Fingerprints of a bucket that one unit compares with each other or with another block's.
BLOCK = 2048
#: Fingerprints of a bucket on average, which sets the length of keys.
MEAN_BUCKET = 256
#: Large buckets that may be broadcast; more are joined by a shuffle.
FEW_BUCKETS = 10_000
#: Lanes that a task holds at once.
LANES = 1 << 16
#: Fingerprints for similar texts: words of 64 bits, words of a shingle, the similarity that counts.
WIDE_WORDS, WIDE_SHINGLE, SIMILARITY = 4, 5, 0.8
#: Sets of Jaccard similarity J have the cosine 2 J / (1 + J); a bit differs with the chance arccos / pi.
DIFFERING = float(np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi)
#: That is 39 of 256 bits on average, with a deviation of 5.7: similar texts are hardly ever beyond this (nearly four above).
WIDE_RADIUS = 60
#: Shingles that make a text count once more in a unit of sets, and rows of units that may be broadcast.
HEAVY, FEW_MEMBERS = 1024, 500_000
#: Links that a task joins to trees at once.
LINKS = 1 << 20
#: Bucket size that sets the length of keys, and the share of pairs at SIMILARITY that no table may hold.
WIDE_BUCKET, MISSED = 64, 0.02
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit b set, for b from 0 (lowest) to 63."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, shingle: int, slice_size: int = 1 << 15) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, in order and with repeats, by slices of bounded memory; fewer words are one shingle."""
    words = [w.encode() for w in WORD.findall(text.translate(LOWER))]
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, slice_size):
        part = words[at : at + slice_size + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        first = np.r_[0, ends[:-1]].tolist()
        last = (ends - 1).tolist()
        m = min(slice_size, n - at)
        got = [digest(line[a:b], SEED) for a, b in zip(first[:m], last[min(shingle, len(part)) - 1 :], strict=False)]
        yield np.array(got, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE, slice_size: int = 1 << 15) -> int:
    total, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle, slice_size):
        total += bit_counts(hashes)
        n += len(hashes)
    return int(sum(1 << b for b in np.flatnonzero(2 * total > n).tolist()))


def shingle_set(text: str, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE_WORDS words: every bit is the majority of that bit of the hashes, each mixed anew for every word."""
    total = np.zeros((WIDE_WORDS, BITS), dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        for w in range(WIDE_WORDS):
            x = hashes[at : at + (1 << 14)] + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            total[w] += bit_counts(x ^ (x >> np.uint64(31)))
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; and row, if row_col names a column of row numbers."""
    bounded_batches(df.sparkSession)
    extra = ["row"] if row_col else []

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *extra])

    return id_and_text(df, id_col, text_col, row_col).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in extra)]))


# -- bit-sliced comparison


def bit_planes(fp: np.ndarray, spare: int) -> np.ndarray:
    """Planes of the fingerprints' bits (one word each, or a row of words): row b holds bit b of lane 64 w + i at bit i of word w; spare empty lanes follow."""
    fp = fp.reshape(len(fp), -1)
    words = (len(fp) + spare + 63) // 64
    padded = np.zeros((words * 64, fp.shape[1]), dtype=np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_words(base: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lanes are within radius of each other.

    base: planes of W words. other: planes of D shifts of W words. Returned: shift and
    word of every block of 64 lanes that has near ones, and the bits of these. Blocks of
    64 lanes that are all beyond the radius are abandoned on the way.
    """
    counters = radius.bit_length()
    shape = other.shape[1:]
    count = np.zeros((counters, *shape), dtype=np.uint64)
    beyond = np.zeros(shape, dtype=np.uint64)
    at = None
    for b in range(len(base)):
        carry = base[b] ^ other[b] if at is None else base[b][at[1]] ^ other[b][at]
        for c in range(counters):  # carry-save addition of one plane to every lane's counter
            flipped = count[c] & carry
            count[c] ^= carry
            carry = flipped
        beyond |= carry  # past the counters' range
        if b >= max(19, radius) and b % 4 == 3 and b < len(base) - 1:
            live = (beyond | _greater(count, radius)) != ALL
            if at is None:
                if live.mean() < 0.5:
                    at = np.nonzero(live)
                    count, beyond = count[:, at[0], at[1]], beyond[at]
            else:
                at, count, beyond = (at[0][live], at[1][live]), count[:, live], beyond[live]
            if at is not None and not len(at[0]):
                break
    near = ~(beyond | _greater(count, radius))
    if at is None:
        at = np.nonzero(near)
        return at[0], at[1], near[at]
    hit = near != 0
    return at[0][hit], at[1][hit], near[hit]


def _greater(count: np.ndarray, limit: int) -> np.ndarray:
    """Lanes whose counter, in binary from row 0 up, exceeds limit."""
    more = np.zeros(count.shape[1:], dtype=np.uint64)
    same = np.full(count.shape[1:], ALL)
    for c in range(len(count) - 1, -1, -1):
        if limit >> c & 1:
            same &= count[c]
        else:
            more |= same & count[c]
            same &= ~count[c]
    return more


def _link(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Join the trees of a[i] and b[i] for each i, smallest index as root; up holds roots before and after. Returned: the i that joined two trees."""
    known: dict[int, int] = {}
    joined = []

    def root(i: int) -> int:
        while (j := known.get(i, i)) != i:
            known[i] = i = known.get(j, j)
        return i

    for i, (x, y) in enumerate(zip(up[a].tolist(), up[b].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            known[max(x, y)] = min(x, y)
            joined.append(i)
    for i in known:
        up[i] = root(i)
    up[:] = up[up]
    return joined


#: Words of 64 lanes that one step of the comparison works on.
STEP = 4096


def unit_forest(
    unit: np.ndarray, side: np.ndarray, fp: np.ndarray, radii: tuple[int, ...], comp: np.ndarray | None = None, forests: int = 1, between: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forests of the links inside every unit: pairs of lanes that are within the largest radius, and whether their unit has links that no forest took.

    unit: a number for each lane, equal lanes contiguous. side: 2 if lanes compare with
    all of their unit; 0 and 1 if only with the other side. fp: a word for each lane, or
    a row of words. Radii ascend; links within a smaller one are found first, so what
    joins two trees is about their closest pair. Lanes of equal comp are one tree from
    the start. Each further forest spans the links that those before it left; with
    several, one radius is enough. between: lanes of one side that are linked, which
    another unit with that side alone tells of, are one tree from the start (one forest).
    """
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[first, len(unit)])
    order = np.argsort(-size, kind="stable")  # large units in front
    size = size[order]
    lane = np.repeat(first[order] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(unit))
    fp, side = fp[lane], side[lane]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(fp))  # lanes from here to the unit's end
    most = int(size[0])
    ends = np.cumsum(size)
    live = [int(ends[np.searchsorted(-size, -k, side="left") - 1]) if k < most else 0 for k in range(0, most, 64)]
    planes = bit_planes(fp.view(np.uint64), most + 128)
    number = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(fp))
    if comp is not None:  # the first lane of each unit and comp is the root of both
        by = np.lexsort((start, comp[lane], number))
        new = np.r_[True, (np.diff(number[by]) != 0) | (np.diff(comp[lane][by]) != 0)]
        start[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    trees = [start.copy() for _ in range(forests)]
    inner = start.copy() if between else None  # trees of links inside a side
    seen = np.zeros(len(size), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for radius in radii:
        for by in range(min(64, most)):
            moved = planes[:, :-1] if not by else (planes[:, :-1] >> np.uint64(by)) | (planes[:, 1:] << np.uint64(64 - by))
            over = 0
            while over < len(live):
                lanes = live[over]  # of the units with over 64 * over lanes, which come first
                words = (lanes + 63) // 64
                deep = min(len(live) - over, max(1, STEP // words))
                view = np.lib.stride_tricks.sliding_window_view(moved, words, axis=1)[:, over : over + deep]
                d, w, bits = near_words(planes[:, :words], view, radius)
                if len(d):
                    k, i = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    a, shift = w[k] * 64 + i, (over + d[k]) * 64 + by
                    ok = (a < lanes) & (shift > 0)
                    a, shift = a[ok], shift[ok]
                    ok = left[a] > shift
                    a, b = a[ok], (a + shift)[ok]
                    ok = (between | (side[a] == 2) | (side[a] != side[b])) & (start[a] != start[b])
                    a, b = a[ok], b[ok]
                    if inner is not None:
                        ok = (side[a] != 2) & (side[a] == side[b]) & (inner[a] != inner[b])
                        if ok.any():
                            _link(inner, a[ok], b[ok])
                    if radius == radii[-1]:  # which finds every link
                        np.add.at(seen, number[a], 1)
                    for up in trees:
                        ok = up[a] != up[b]
                        if ok.any():
                            at = np.flatnonzero(ok)
                            ok[:] = False
                            ok[at[_link(up, a[at], b[at])]] = True
                            found.append((a[ok], b[ok]))
                            a, b = a[~ok], b[~ok]
                over += deep
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if inner is not None:  # with the links inside sides, the forest's others still connect all
        ok = (side[a] == 2) | (side[a] != side[b])
        a, b = a[ok], b[ok]
        joined = _link(inner, a, b)
        a, b = a[joined], b[joined]
    more = seen > np.bincount(number[a], minlength=len(size))
    return lane[a], lane[b], more[number[a]]


def stars(a: np.ndarray, b: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that connect what the links a, b of lanes do: each node of a tree with the tree's smallest. A node has one tree, in however many units it is."""
    ids, at = np.unique(node, return_inverse=True)
    up = np.arange(len(ids))
    _link(up, at[a], at[b])
    leaf = np.flatnonzero(up != np.arange(len(ids)))
    return ids[leaf], ids[up[leaf]]


def unit_links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside every unit, as pairs of fingerprints."""
    a, b, _ = unit_forest(unit, side, fp, (radius,))
    return fp[a], fp[b]


def band_tables(radius: int = RADIUS, agree: int = 2) -> list[int]:
    """Masks of the tables: each choice of `agree` among radius + agree bands.

    At most radius bands hold differing bits, so at least `agree` bands are equal.
    """
    n = radius + agree
    edges = [BITS * k // n for k in range(n + 1)]
    bands = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(bands, agree)]


def bands_for(nodes: int, radius: int = RADIUS, bucket: int = MEAN_BUCKET) -> int:
    """How many bands form a key, so that buckets of so many evenly spread fingerprints stay small.

    More bands give more tables but longer keys; all choices find every pair.
    """
    for agree in range(1, BITS - radius):
        if nodes >> (BITS * agree // (radius + agree)) <= bucket:
            return agree
    return BITS - radius


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """a, b: links between the distinct fingerprints fp of nodes that connect all fingerprints within radius."""
    if not 0 < radius < 16:
        raise ValueError("radius must be from 1 to 15")
    masks = band_tables(radius, agree or bands_for(nodes.count(), radius))
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = nodes.select("fp", F.inline(tables))
    return _forests(_in_units(rows, "fp", block), ["fp"], "fp", (radius,)).select("a", "b").distinct()


def _in_units(rows: DataFrame, node: str, block: int) -> DataFrame:
    """rows (t, key and others) dealt out by unit: a bucket (t, key), or two blocks (i, j) of a large one, with the side of each row. A column weight, if any, says how many rows one counts for."""
    # How many blocks a bucket needs is known from its size; a row's own follows from its hash.
    size = F.sum("weight") if "weight" in rows.columns else F.count(F.lit(1))
    large = rows.groupBy("t", "key").agg(size.alias("count")).filter(F.col("count") > block)
    large = large.select(F.col("t").alias("lt"), F.col("key").alias("lkey"), F.ceil(F.col("count") / (block / 2)).cast("int").alias("blocks"))
    large = checkpointed(large)
    if large.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS:
        large = F.broadcast(large)
    columns = rows.columns
    rows = rows.join(large, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lkey")), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    # Units of a bucket: every pair of blocks. In unit (i, j) block i is side 0 and j side 1; (i, i) has side 2.
    units = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(
            F.least(F.col("own"), k).alias("i"),
            F.greatest(F.col("own"), k).alias("j"),
            F.when(k == F.col("own"), 2).when(F.col("own") < k, 0).otherwise(1).alias("side"),
        ),
    )
    spread = rows.withColumn("own", own).select(*columns, F.inline(units))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")


def _forests(spread: DataFrame, words: list[str], node: str, radii: tuple[int, ...], forests: int = 1, groups: bool = False) -> DataFrame:
    """a, b, distance, more: unit_forest() of all units, as pairs of nodes; a column comp of spread, if any, joins nodes beforehand.

    groups: only a, b, which need not be links themselves, as stars(); two blocks of a
    bucket add what joins their own trees, so a bucket's pairs grow with its nodes, not
    with its nodes times its blocks.
    """
    joined = "comp" in spread.columns
    lanes = max(LANES // forests, 1 << 12)  # every forest has a number for each lane

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def work(last: bool):
            nonlocal held, n
            table = pa.Table.from_batches(held)
            cols = [table.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            new = np.zeros(n, dtype=bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            end = n if last else int(np.flatnonzero(new)[-1])
            if end:
                unit = np.cumsum(new)[:end]
                fp = np.stack([table.column(c).to_numpy()[:end] for c in words], axis=1)
                comp = table.column("comp").to_numpy()[:end] if joined else None
                side = table.column("side").to_numpy()[:end]
                a, b, more = unit_forest(unit, side, fp, radii, comp, forests, groups)
                names = table.column(node).to_numpy()
                if groups:
                    pairs = stars(a, b, names[:end])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])
                    held, n = (table.slice(end).to_batches(), n - end) if end < n else ([], 0)
                    return
                far = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(names[b], pa.int64()), pa.array(far), pa.array(more)], ["a", "b", "distance", "more"])
            held, n = (table.slice(end).to_batches(), n - end) if end < n else ([], 0)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= lanes:
                yield from work(False)
        if n:
            yield from work(True)

    return spread.mapInArrow(run, "a long, b long" if groups else "a long, b long, distance long, more boolean")


# -- similar texts


def wide_tables(nodes: int) -> np.ndarray:
    """Masks of the tables for so many fingerprints: a row of WIDE_WORDS words for each.

    Keys are long enough for buckets of about WIDE_BUCKET evenly spread fingerprints, and
    there are so many tables that two texts of similarity SIMILARITY miss all of them with
    a chance of at most MISSED (bits differ by DIFFERING, independently).
    """
    bits = max(8, (max(1, nodes) // WIDE_BUCKET).bit_length())
    tables = int(np.ceil(np.log(MISSED) / np.log1p(-((1 - DIFFERING) ** bits))))
    r, chosen = np.random.default_rng(5), []
    while len(chosen) < tables:  # disjoint sets of bits as long as they last, then others
        line = r.permutation(BITS * WIDE_WORDS)
        chosen += [line[k : k + bits] for k in range(0, len(line) - bits + 1, bits)]
    masks = np.zeros((tables, WIDE_WORDS), dtype=np.uint64)
    for t, places in enumerate(chosen[:tables]):
        for x in places.tolist():
            masks[t, x // BITS] |= np.uint64(1 << x % BITS)
    return masks


def similar_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """components() of nodes linked by a similarity of SIMILARITY or more.

    nodes: node, low, shingles (how many), and words w0, w1 ... of its fingerprint.
    sets_of: from a frame of nodes, one column, to their node, shingles (distinct hashes).
    Forests of the pairs within WIDE_RADIUS bits give groups; every candidate pair lies
    in one. The sets of a group then meet once, and all pairs of the group are compared
    by them, so no pair that fails can hide another.
    """
    words = [f"w{k}" for k in range(WIDE_WORDS)]
    masks = wide_tables(nodes.count()).view(np.int64).tolist()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(x).cast("long").alias(w) for w, x in zip(words, m, strict=True)]) for t, m in enumerate(masks)])
    keys = F.transform(tables, lambda m: F.struct(m["t"].alias("t"), F.xxhash64(m["t"], *[F.col(w).bitwiseAND(m[w]) for w in words]).alias("key")))
    spread = _in_units(nodes.select("node", *words, F.inline(keys)), "node", block)
    # Which links a forest takes depends on the order of rows, so it is made once for both directions.
    found = stored(_forests(spread, words, "node", (WIDE_RADIUS,), groups=True).distinct())
    ranked = nodes.select(F.col("node").alias("fp"), "low")
    group = roots(found).select(_anew("fp").alias("member"), "root")
    # A text of many shingles counts for several, so that a unit's sets stay bounded.
    weight = F.ceil(F.col("shingles") / HEAVY).cast("long").alias("weight")
    rows = nodes.join(group, _anew("node") == F.col("member")).select(F.lit(0).alias("t"), F.col("root").alias("key"), "node", weight)
    units = stored(_in_units(stored(rows), "node", block).select("key", "i", "j", "side", "node"))
    return components(ranked, stored(_alike(units, sets_of)))


def _alike(units: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b: pairs whose sets have a similarity of SIMILARITY or more: in every unit (key, i, j; see _in_units()) a spanning forest, of two blocks what joins their own trees."""
    sets = sets_of(units.select("node").distinct())
    few = units.limit(FEW_MEMBERS + 1).count() <= FEW_MEMBERS
    near = units.select("key", "i", "j", "side", _anew("node").alias("kn"))
    rows = sets.join(F.broadcast(near) if few else near.hint("merge"), _anew("node") == F.col("kn"))
    parts = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("key", "i", "j", "side", "node", "shingles").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        at, held = None, []

        def done():
            side, names = (np.concatenate([h[k].to_numpy() for h in held]) for k in (0, 1))
            sizes = np.concatenate([h[2].value_lengths().to_numpy() for h in held]).astype(np.int64)
            a, b = alike_forest(side, sizes, np.concatenate([h[2].flatten().to_numpy() for h in held]), between=True)
            return pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(names[b], pa.int64())], ["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            unit = [x.column(k).to_numpy() for k in range(3)]
            cut = np.flatnonzero((np.diff(unit[0]) != 0) | (np.diff(unit[1]) != 0) | (np.diff(unit[2]) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), x.num_rows], strict=True):
                key = tuple(int(u[lo]) for u in unit)
                if held and key != at:
                    yield done()
                    held = []
                at = key
                held.append([x.column(k).slice(lo, hi - lo) for k in (3, 4, 5)])
        if held:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def alike_forest(side: np.ndarray, sizes: np.ndarray, values: np.ndarray, between: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets with a similarity of SIMILARITY or more. sizes, values: the sets, one after another; side, between: as for unit_forest()."""
    code = np.unique(values, return_inverse=True)[1]
    often = np.bincount(code)
    post = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(code, kind="stable")]
    first, ends = np.cumsum(often) - often, np.cumsum(sizes)
    up, inner = np.arange(len(sizes)), np.arange(len(sizes))
    a, b = [], []
    for t in range(1, len(sizes)):
        own = code[ends[t] - sizes[t] : ends[t]]
        own = own[often[own] > 1]
        m = often[own]
        other = post[np.repeat(first[own] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        both = np.bincount(other[other < t], minlength=t)
        alike = (both > 0) & (both >= SIMILARITY * (sizes[:t] + sizes[t] - both))
        own_side = (side[:t] != 2) & (side[:t] == side[t])
        if between and len(hit := np.flatnonzero(alike & own_side)):
            _link(inner, np.full(len(hit), t), hit)
        hit = np.flatnonzero(alike if between else alike & ~own_side)
        if len(hit):
            joined = hit[_link(up, np.full(len(hit), t), hit)]
            joined = joined[~own_side[joined]]
            a += [t] * len(joined)
            b += joined.tolist()
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    joined = _link(inner, a, b)
    return a[joined], b[joined]


# -- components


def _anew(name: str) -> Column:
    """The same key as another expression.

    Both sides of a join are then dealt out for the join itself, and adaptive execution
    can split a key that very many rows share, such as the root of a large component.
    """
    return F.col(name).bitwiseXOR(F.lit(0x5851F42D4C957F2D))


def _anonymous(df: DataFrame) -> DataFrame:
    """The same rows as new columns.

    A checkpoint keeps what the optimiser has inferred about its columns; in a loop of
    joins that grows with every round. New columns have no such past.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _compacted(links: DataFrame) -> DataFrame:
    """a, b (a > b): links that connect the same nodes, as stars() of each task's links; a node's links to smaller ones are in one task."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            table = pa.Table.from_batches(held)
            n = table.num_rows
            pairs = stars(np.arange(n), np.arange(n) + n, np.concatenate([table.column(k).to_numpy() for k in (0, 1)]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= LINKS:
                yield done()
                held = []
        if held:
            yield done()

    parts = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return links.repartition(parts, "a").mapInArrow(run, "a long, b long").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """fp, root: for every node of the edges a, b one node of its component, the same for all of it.

    Edges are first compacted twice: trees of several tables or units over the same nodes
    become one, told as stars. A node with one link, to a smaller node, and none to it
    takes that node's root at the end. Only links among the others go through rounds, so
    what the rounds move doesn't grow with a star's leaves.

    In each round every edge offers one end's label to the other end; the smallest offer to
    a node goes to it and to the node that its label names; each node takes the smallest it
    got, then the label of the node that its own label names. Hooking whole trees this way,
    not only the nodes at their edges, needs about the logarithm of a chain's length in rounds.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    links = checkpointed(_anonymous(_compacted(_compacted(links))))
    none = F.lit(None).cast("long")
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("fp"), F.col("b").alias("up")), F.struct(F.col("b").alias("fp"), none.alias("up")))))
    ends = ends.groupBy("fp").agg(F.min("up").alias("up"), F.count("up").alias("own"), F.count(F.lit(1)).alias("all"))
    leaf = (F.col("own") == 1) & (F.col("all") == 1)
    known = checkpointed(_anonymous(ends.select("fp", F.when(leaf, F.col("up")).otherwise(F.col("fp")).alias("at"))))
    leaves = known.filter("fp <> at").select(_anew("fp").alias("leaf"))
    core = links.join(leaves, _anew("a") == F.col("leaf"), "left_anti")
    both = checkpointed(_anonymous(core.union(core.select(F.col("b"), F.col("a")))))
    if both.isEmpty():
        return known.select("fp", F.col("at").alias("root"))
    now = checkpointed(_anonymous(both.select(F.col("a").alias("fp"), F.col("a").alias("label")).distinct()))
    while True:
        far = now.select(_anew("fp").alias("kb"), F.col("label").alias("offer"))
        near = now.select(_anew("fp").alias("ka"), F.col("label").alias("own"))
        best = both.join(far, _anew("b") == F.col("kb")).groupBy("a").agg(F.min("offer").alias("offer"))
        met = best.join(near, _anew("a") == F.col("ka")).filter("offer < own")
        offers = met.select(F.inline(F.array(F.struct(F.col("a").alias("fp"), F.col("offer").alias("label")), F.struct(F.col("own").alias("fp"), F.col("offer").alias("label")))))
        low = now.union(offers).groupBy("fp").agg(F.min("label").alias("label"))
        up = low.select(_anew("fp").alias("parent"), F.col("label").alias("top"))
        jumped = low.join(up, _anew("label") == F.col("parent")).select("fp", F.least("label", "top").alias("label"))
        after = checkpointed(_anonymous(jumped))
        was = now.select(_anew("fp").alias("kw"), F.col("label").alias("was"))
        settled = after.join(was, _anew("fp") == F.col("kw")).filter("label <> was").isEmpty()
        now = after
        if settled:
            break
    top = now.select(_anew("fp").alias("kt"), F.col("label").alias("top"))
    return known.join(top, _anew("at") == F.col("kt"), "left").select("fp", F.coalesce("top", "at").alias("root"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, label, node: for every node fp with an edge and a value `low` (null last), the smallest low reachable over edges a, b, and the node that has it."""
    rank = F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("fp").alias("node"))
    of = roots(edges).select(_anew("fp").alias("member"), "root")
    known = checkpointed(_anonymous(nodes.join(of, _anew("fp") == F.col("member")).select("fp", "root", rank.alias("label"))))
    first = known.groupBy("root").agg(F.min("label").alias("label")).select(_anew("root").alias("kr"), "label")
    return known.select("fp", "root").join(first, _anew("root") == F.col("kr")).select("fp", F.col("label.low").alias("label"), "label.node")


def near_duplicates(df: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    docs = checkpointed(fingerprints(df, shingle, id_col, text_col))
    nodes = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("low")))
    label = components(nodes, links(nodes.select("fp"), radius, block))
    known = nodes.join(label.drop("node"), "fp", "left").select(_anew("fp").alias("node"), F.coalesce("label", "low").alias("component_id"))
    return docs.join(known, _anew("fp") == F.col("node")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """df's rows, all columns, with one row of each group of similar texts (similarity SIMILARITY or more, linked).

    That is the row with the smallest id (null last); of rows that repeat it, the first by
    row number. Texts with equal sets of shingles, such as all without words, are alike.
    """
    numbered, key = keyed(df)
    bounded_batches(df.sparkSession)
    texts = id_and_text(numbered, id_col, text_col, key)
    words = [f"w{k}" for k in range(WIDE_WORDS)]

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            fp = np.array([wide_fingerprint(x) for x in sets], dtype=np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            same = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), same, pa.array([len(x) for x in sets], pa.int64()), *(pa.array(fp[:, k]) for k in range(WIDE_WORDS))], ["doc_id", "row", "same", "shingles", *words])

    def run_sets(batches):
        for b in batches:
            sets = pa.array([shingle_set(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(2), sets], ["node", "shingles"])

    docs = checkpointed(texts.mapInArrow(run, ", ".join(["doc_id long, row long, same binary, shingles long", *(f"{w} long" for w in words)])))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    nodes = docs.groupBy("same").agg(first, *[F.min(w).alias(w) for w in ("shingles", *words)])
    nodes = checkpointed(nodes.select(F.col("first.row").alias("node"), F.col("first.doc_id").alias("low"), "shingles", *words))
    sets_of = lambda some: among(texts, "row", some).mapInArrow(run_sets, "node long, shingles array<long>")
    label = similar_components(nodes, sets_of, block).filter("fp <> node").select(F.col("fp").alias("other"))
    kept = nodes.join(label, _anew("node") == _anew("other"), "left_anti").select(F.col("node").alias("keep"))
    return without(numbered, key, docs.join(kept, F.col("row") == F.col("keep"), "left_anti").select("row")).drop(key)
