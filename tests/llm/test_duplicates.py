"""Exact duplicates, near duplicates and fingerprints against brute force."""

import hashlib
import random
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import exact_dedup, fingerprints, simhash

WHITE = re.compile("[\x20\x09-\x0d]+")


# -- exact duplicates


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((len(t or ""), i))
    out = []
    for i, t in rows:
        norm = WHITE.sub("", t or "")
        n, keep = max(groups[norm], key=lambda x: (x[0], x[1] is not None, -(x[1] or 0)))
        out.append((i, keep, len(groups[norm]), i == keep and len(t or "") == n, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def texts_with_copies(seed, n=300):
    r = random.Random(seed)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "délta", "🙂"]) + str(r.randint(0, 50)) for _ in range(r.choice([0, 1, 5, 300, 4000]))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = r.choice(base)
        rows.append((i, r.choice([t, t.replace(" ", "\n"), t + "\x0b", t + "x", t[: len(t) // 2]])))
    return rows


def test_exact_duplicates(make, odd):
    rows = texts_with_copies(1) + odd
    got = exact_dedup.exact_duplicates(make(rows, clash=True))
    assert Counter(map(tuple, got.collect())) == exact_brute(rows)
    assert exact_dedup.exact_duplicates(make([])).count() == 0


def test_colliding_identifiers_are_widened(make):
    rows = texts_with_copies(2, 120)
    df = make(rows)
    assert not exact_dedup.verified(df.select("doc_id", F.col("text")), 1)
    assert Counter(map(tuple, exact_dedup.exact_duplicates(df, width=1).collect())) == exact_brute(rows)


def test_chunks_depend_on_content_alone():
    r = np.random.default_rng(3)
    data = r.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    chunks = exact_dedup.chunks_of(data)
    assert b"".join(chunks) == data and all(len(c) <= exact_dedup.MOST for c in chunks) and all(len(c) >= exact_dedup.LEAST for c in chunks[:-1])
    shifted = exact_dedup.chunks_of(b"inserted at the front" + data)
    assert len(set(chunks) & set(shifted)) > 0.9 * len(chunks)
    assert exact_dedup.chunks_of(b"") == [] and exact_dedup.chunks_of(b"x") == [b"x"]
    flat = exact_dedup.chunks_of(b"a" * 100_000)
    assert b"".join(flat) == b"a" * 100_000


def test_exact_filter_keeps_all_columns(make, odd):
    df = make(odd + texts_with_copies(4, 80)[20:], clash=True)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    want = {i for (i, _, _, k, _) in exact_brute([tuple(r) for r in df.select("doc_id", "text").collect()]) if k}
    assert {r["doc_id"] for r in kept.collect()} - {None} == want - {None}


# -- SimHash


def simhash_brute(rows, radius=4):
    fps = []
    for _, t in rows:
        words = [w for w in WHITE.split((t or "").translate(simhash.LOWER)) if w]
        if not words:
            fps.append(0)
            continue
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), seed=42) for k in range(max(1, len(words) - 3))]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
        fps.append(int("".join("1" if 2 * b > len(h) else "0" for b in bits), 2))
    distinct = sorted(set(fps))
    arr = np.array(distinct, dtype=np.uint64)
    up = list(range(len(distinct)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= radius):
            a, b = root(k), root(int(j))
            up[max(a, b)] = min(a, b)
    place = {v: k for k, v in enumerate(distinct)}
    low = defaultdict(list)
    for (i, _), fp in zip(rows, fps, strict=True):
        if i is not None:
            low[root(place[fp])].append(i)
    return Counter((i, f"{fp:016x}", min(low[root(place[fp])], default=None)) for (i, _), fp in zip(rows, fps, strict=True))


def near_copies(seed, groups=30):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [r.choice("abcdefghij") * r.randint(1, 4) + str(r.randint(0, 99)) for _ in range(r.choice([3, 40, 200, 900]))]
        for _ in range(r.randint(1, 12)):
            mine = list(words)
            for _ in range(r.randint(0, 3)):
                mine[r.randrange(len(mine))] = "edited"
            rows.append((len(rows), " ".join(mine)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_near_duplicates(make, odd, block):
    rows = near_copies(1) + [(i if i is None else i + 10_000, t) for i, t in odd]
    got = simhash.near_duplicates(make(rows, clash=True), block=block)
    want = simhash_brute(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_every_number_of_bands_gives_the_same_components(spark, agree):
    r = random.Random(9)
    fps = set()
    for _ in range(60):
        centre = r.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(20)}
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(sorted(fps))], "fp long, low long")
    got = {r["fp"] % (1 << 64): r["label"] for r in simhash.components(nodes, simhash.links(nodes.select("fp"), block=16, agree=agree)).collect()}
    arr = np.array(sorted(fps), dtype=np.uint64)
    for k, x in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr ^ x) <= 4):
            if j != k:
                assert got[int(x)] == got[int(arr[j])]
    assert len({got.get(int(x), -1 - k) for k, x in enumerate(arr)}) == components_of(arr)


def components_of(arr):
    up = list(range(len(arr)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= 4):
            a, b = root(k), root(int(j))
            up[max(a, b)] = min(a, b)
    return len({root(k) for k in range(len(arr))})


def test_near_duplicates_of_the_driver_table(make, sample):
    assert Counter(map(tuple, simhash.near_duplicates(make(sample)).collect())) == simhash_brute(sample)
    assert simhash.near_duplicates(make([])).count() == 0


def test_long_texts_in_slices():
    text = " ".join(str(k % 701) for k in range(5000))
    assert simhash.fingerprint(text, slice_size=64) == simhash.fingerprint(text)
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")


def test_bit_sliced_links_equal_brute_force():
    r = np.random.default_rng(0)
    for units, sides in ((1, False), (3, True), (40, False), (900, True)):
        centres = r.integers(0, 1 << 63, 40, dtype=np.uint64)
        fp = centres[r.integers(0, 40, 1200)]
        for k in range(len(fp)):
            for b in r.integers(0, 64, r.integers(0, 5)):
                fp[k] ^= np.uint64(1 << int(b))
        unit = np.sort(r.integers(0, units, len(fp)))
        side = r.integers(0, 2, len(fp)) if sides else np.full(len(fp), 2)
        a, b = simhash.unit_links(unit, side, fp.view(np.int64))
        close = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (unit[:, None] == unit[None, :]) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))

        def components(pairs):
            up = {}

            def root(x):
                while up.setdefault(x, x) != x:
                    x = up[x]
                return x

            for x, y in pairs:
                p, q = root(x), root(y)
                up[max(p, q)] = min(p, q)
            return {x: root(x) for x in list(up)}

        i, j = np.nonzero(close)
        assert components((x, y) for x, y in zip(fp[i].tolist(), fp[j].tolist(), strict=True) if x != y) == components((x, y) for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True) if x != y)
        assert len(a) <= len(fp)


def test_forests_take_all_links_between_groups():
    r = np.random.default_rng(1)
    fp = r.integers(0, 4, 300, dtype=np.uint64)
    unit = np.sort(r.integers(0, 12, len(fp)))
    comp = r.integers(0, 9, len(fp))
    apart = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 1) & (unit[:, None] == unit[None, :]) & (comp[:, None] != comp[None, :])
    want = {(x, y) for x, y in zip(*(k.tolist() for k in np.nonzero(apart)), strict=True) if x < y}
    taken = []
    for forests in (1, 3, 64):
        a, b, more = simhash.unit_forest(unit, np.full(len(fp), 2), fp.view(np.int64), (1,), comp, forests)
        got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert len(got) == len(a) and got <= want
        for x, m in zip(a.tolist(), more.tolist(), strict=True):
            own = {p for p in want if unit[p[0]] == unit[x]}
            assert m == (not own <= got)
        taken.append(len(got))
    assert taken == sorted(taken) and got == want


def test_bands_miss_no_pair():
    r = random.Random(2)
    for agree, n in ((1, 5), (2, 15), (3, 35)):
        tables = simhash.band_tables(4, agree)
        assert len(tables) == n
        for _ in range(2000):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(diff & m == 0 for m in tables)
    assert [simhash.bands_for(n) for n in (0, 10_000, 1 << 20, 1 << 29, 1 << 30, 1 << 36)] == [1, 1, 1, 2, 3, 4]


def test_chains_become_one_component(spark):
    n = 200
    nodes = spark.createDataFrame([(k, (k * 7919) % n + 1 if k else None) for k in range(n)], "fp long, low long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 2)], "a long, b long")
    got = {r["fp"]: r["label"] for r in simhash.components(nodes, edges).collect()}
    assert set(got) == set(range(n - 1)) and set(got.values()) == {min((k * 7919) % n + 1 for k in range(1, n - 1))}


def similar_brute(rows, least=0.8):
    """For each row the smallest id (None last) of its group of texts linked by a Jaccard similarity of their five-word shingles of at least 0.8."""
    sets = []
    for _, t in rows:
        words = [w for w in WHITE.split((t or "").translate(simhash.LOWER)) if w]
        sets.append(frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    distinct = list(dict.fromkeys(sets))
    up = list(range(len(distinct)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    have = defaultdict(list)
    for k, x in enumerate(distinct):
        for g in x:
            have[g].append(k)
    for k, x in enumerate(distinct):
        met = Counter(j for g in x for j in have[g] if j < k)
        for j, n in met.items():
            if n >= least * (len(x) + len(distinct[j]) - n):
                a, b = root(k), root(j)
                up[max(a, b)] = min(a, b)
    place = {x: k for k, x in enumerate(distinct)}
    low = defaultdict(list)
    for (i, _), x in zip(rows, sets, strict=True):
        low[root(place[x])].append(i)
    return [min((i for i in low[root(place[x])] if i is not None), default=None) for x in sets]


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_near_filter_keeps_one_of_each(make, block):
    rows = near_copies(5)
    df = make(rows, clash=True)
    kept = simhash.drop_near_duplicates(df, block=block)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(similar_brute(rows))


def edited_copies(seed, groups=60):
    """Groups of texts whose copies have edits of all degrees, so that similarities lie on both sides of the limit."""
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [r.choice("abcdefghij") * r.randint(1, 4) + str(r.randint(0, 999)) for _ in range(r.choice([12, 60, 200, 600]))]
        for _ in range(r.randint(1, 6)):
            mine = list(words)
            for _ in range(r.randint(0, max(1, len(mine) // 25))):
                at = r.randrange(len(mine))
                mine[at : at + r.choice([0, 1])] = [r.choice(["edited", "other"]) + str(r.randint(0, 99))]
            rows.append((len(rows), " ".join(mine)))
    return rows


def test_near_filter_finds_similar_texts(make, sample):
    rows = sample + [(i + 100_000, t) for i, t in edited_copies(3)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(make(rows)).collect()}
    want = set(similar_brute(rows))
    every = {i for i, _ in rows}
    assert want <= kept  # nothing goes without a similar text
    assert len(every - kept) >= 0.97 * len(every - want)


def test_pairs_that_fail_hide_no_others(make, monkeypatch):
    # Many texts of one kind, whose pairs lie closely on both sides of the limit.
    r = random.Random(8)
    rows = []
    for _ in range(4):
        words = [str(r.getrandbits(40)) for _ in range(240)]
        for _ in range(40):
            mine = list(words)
            for at in r.sample(range(24), r.randint(1, 6)):
                mine[10 * at + 4] = str(r.getrandbits(40))
            rows.append((len(rows), " ".join(mine)))
    monkeypatch.setattr(simhash, "MISSED", 1e-6)
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(make(rows)).collect()}
    want = set(similar_brute(rows))
    assert 4 < len(want) < len(rows) and kept == want


def test_tables_of_wide_fingerprints_reach_similar_texts():
    r = random.Random(4)
    for nodes in (100, 100_000, 10_000_000):
        masks = simhash.wide_tables(nodes)
        met = tries = 0
        for _ in range(60):
            a = [str(r.getrandbits(40)) for _ in range(404)]
            b = a[:356] + [str(r.getrandbits(40)) for _ in range(48)]  # 352 of 448 shingles in common
            x, y = (simhash.wide_fingerprint(simhash.shingle_set(" ".join(t))) for t in (a, b))
            tries += 1
            met += bool((((x ^ y) & masks) == 0).all(axis=1).any()) and int(np.bitwise_count(x ^ y).sum()) <= simhash.WIDE_RADIUS
        assert met >= 0.9 * tries and masks.any(axis=1).all()


#: Ids that repeat with other texts, rows that repeat id and text, null ids: and what must stay.
ONE, TWO = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta"
REPEATS = [(3, ONE), (4, ONE), (4, TWO), (7, "same row"), (7, "same row"), (None, TWO), (None, "only null ids"), (None, "only null ids"), (9, ONE)]
STAY = Counter([(3, ONE), (4, TWO), (7, "same row"), (None, "only null ids")])


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_filters_decide_by_row(make, drop):
    assert Counter((r["doc_id"], r["text"]) for r in drop(make(REPEATS, clash=True)).collect()) == STAY
    df = make(REPEATS).withColumn("__row", F.lit(0))
    assert drop(df).columns == df.columns


def test_near_filter_keeps_one_row_of_each_group(make):
    rows = near_copies(6, 8)
    again = [(i if i % 3 else None, t) for i, t in rows] + rows
    got = simhash.drop_near_duplicates(make(again)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(set(similar_brute(again)))


# -- fingerprints


def shingles(t):
    words = [w for w in WHITE.split(t) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(make, sample):
    rows = sample + [(5000, "one two"), (5001, "")]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(make(rows, clash=True)).collect()}
    text = dict(rows)
    ids = sorted(text, reverse=True)
    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n, r = text[i], len(text[i]), got[i]
        edited = t[: n - n // 2] + text[j][: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b, c = shingles(t), shingles(edited), shingles(text[j])
        if len(a | b) > 200:
            errors.append(len(a & b) / len(a | b) - r["near_edited"])
            errors.append(len(a & c) / len(a | c) - r["near_next"])
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.06
    same = defaultdict(set)
    for i in ids:
        same[text[i]].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert got[5001]["fingerprint"] == "" and len(got[5000]["fingerprint"]) == 16


def next_texts(docs):
    return fingerprints.with_next(fingerprints.met(docs.withColumn("tie", F.xxhash64("text"))), ["text"])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(words):
    """Spark's XXH64 of several strings: each one's hash is the next one's seed."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return signed(seed)


def sketch_brute(text):
    words = [w for w in WHITE.split(text) if w]
    hashes = {spark_hash(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return {h for h in hashes if h < -(1 << 63) + (1 << 64) // 8}, min(hashes, default=None)


def printed_brute(text):
    sketch, lowest = sketch_brute(text)
    return "".join(f"{h % (1 << 64):016x}" for h in sorted(sketch) or ([] if lowest is None else [lowest]))


def likeness_brute(a, b):
    (x, p), (y, q) = sketch_brute(a), sketch_brute(b)
    return len(x & y) / len(x | y) if x | y else float(p == q)


def test_fingerprints_equal_brute_force(make, sample):
    r = random.Random(12)
    rows = sample[:300] + [(50_000 + k, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 12)))) for k in range(400)]
    text = dict(rows)
    ids = sorted(text, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for row in fingerprints.compare_with_next(make(rows)).collect():
        t, nxt = text[row["doc_id"]], text[after[row["doc_id"]]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert row["fingerprint"] == printed_brute(t) and row["edited_fingerprint"] == printed_brute(edited)
        assert row["near_edited"] == pytest.approx(likeness_brute(t, edited)) and row["near_next"] == pytest.approx(likeness_brute(t, nxt))


def test_sketches_of_short_parts_merge(make):
    r = random.Random(13)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(600)]
    parts = [" ".join(words[k : k + 9]) for k in range(0, 596, 5)]  # every shingle lies in a part
    rows = [(k, t) for k, t in enumerate(parts)] + [(-1, " ".join(words))]
    got = {r["doc_id"]: r["sketch"] for r in fingerprints.fingerprint(make(rows)).collect()}
    whole = got.pop(-1)
    assert set().union(*got.values()) == set(whole) and any(not x for x in got.values())
    spark = make(rows).sparkSession
    assert spark.createDataFrame([(list(got.values()),)], "s array<array<bigint>>").select(fingerprints.merged(F.col("s"))).head()[0] == whole


def test_next_document_over_many_buckets(make, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    monkeypatch.setattr(fingerprints, "BINS", 4)
    clustered = [10**15 + k for k in range(200)] + [-(10**15) + 3 * k for k in range(50)] + [7, 8]
    for ids in (sorted({(k * k * 31) % 100_003 - 500 for k in range(300)}, reverse=True), sorted(clustered, reverse=True)):
        docs = make([(i, f"t{i}") for i in ids])
        got = next_texts(docs)
        assert {r["doc_id"]: r["next"]["text"] for r in got.collect()} == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}
        sizes = [r["count"] for r in fingerprints.with_bucket(docs.withColumn("tie", F.xxhash64("text"))).groupBy("bucket").count().collect()]
        assert max(sizes) <= 8  # by rank, however the ids lie


def test_hot_ids_are_dealt_out(make, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    monkeypatch.setattr(fingerprints, "BINS", 8)
    rows = [(5, f"five {k}") for k in range(300)] + [(None, f"none {k}") for k in range(300)] + [(10 + k, f"t{k}") for k in range(300)]
    docs = make(rows).withColumn("tie", F.xxhash64("text"))
    sizes = [r["count"] for r in fingerprints.with_bucket(docs).groupBy("bucket").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 20
    tie = {t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for _, t in rows}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]), reverse=True)
    want = {t: u for (_, t), (_, u) in zip(order, order[1:] + order[:1], strict=True)}
    assert {r["text"]: r["next"]["text"] for r in next_texts(make(rows)).collect()} == want


def test_fingerprint_edges(make, odd):
    assert fingerprints.compare_with_next(make(odd, clash=True)).count() == len(odd)
    one = fingerprints.compare_with_next(make([(3, "a b c d e f g")])).head()
    assert one["near_next"] == 1.0 and one["n_chars"] == 13
    assert fingerprints.compare_with_next(make([])).count() == 0
    nulls = next_texts(make([(2, "b"), (1, "a"), (None, "n")])).collect()
    assert {r["text"]: r["next"]["text"] for r in nulls} == {"b": "a", "a": "n", "n": "b"}
    assert fingerprints.compare_with_next(make([(None, None), (None, "x")])).count() == 2


def test_sketches_merge_and_estimate_containment(make):
    words = [str(k) for k in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1400])), (3, "other " * 3)]
    sketch = {r["doc_id"]: set(r["sketch"]) for r in fingerprints.fingerprint(make(rows)).collect()}
    assert sketch[2] - sketch[1] == set() and sketch[3].isdisjoint(sketch[1])
    halves = {r["doc_id"]: set(r["sketch"]) for r in fingerprints.fingerprint(make([(1, " ".join(words[:2004])), (2, " ".join(words[2000:]))])).collect()}
    assert halves[1] | halves[2] == sketch[1]


def test_failed_pairs_make_no_rows(make, monkeypatch):
    """A family of texts that are all alike, below the limit: neither units nor links grow with its pairs."""
    r = random.Random(9)
    words = [str(r.getrandbits(40)) for _ in range(240)]
    rows = []
    for _ in range(120):
        mine = list(words)
        for at in r.sample(range(24), 4):
            mine[10 * at + 4] = str(r.getrandbits(40))
        rows.append((len(rows), " ".join(mine)))
    seen = []
    stored = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(make(rows)).collect()}
    assert kept == set(similar_brute(rows)) and len(kept) > 60
    forests, *others = seen
    assert forests.count() < 0.5 * len(rows) ** 2 / 2  # every table has one; pairs of the family are over 7,000
    assert len(others) == 3 and all(x.count() <= len(rows) for x in others)


def test_sets_of_units_equal_brute_force():
    r = np.random.default_rng(3)
    for n in (1, 2, 60):
        base = r.integers(0, 1 << 60, 40)
        sets = [np.unique(np.where(r.random(40) < 0.06, r.integers(0, 1 << 60, 40), base))[: r.integers(30, 41)] for _ in range(n)]
        side = r.integers(0, 2, n)
        a, b = simhash.alike_forest(side, np.array([len(x) for x in sets]), np.concatenate(sets))
        tree, want = list(range(n)), list(range(n))
        pairs = [(x, y) for x in range(n) for y in range(x) if side[x] != side[y] and len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))]
        for up, links in ((tree, zip(a.tolist(), b.tolist(), strict=True)), (want, pairs)):
            for x, y in links:
                up[:] = [min(up[x], up[y]) if k in (up[x], up[y]) else k for k in up]
        assert tree == want and len(a) == n - len(set(want))


def connected(n, pairs):
    up = list(range(n))
    for x, y in pairs:
        up = [min(up[x], up[y]) if k in (up[x], up[y]) else k for k in up]
    return up


@pytest.mark.parametrize("kind", ["fingerprints", "sets"])
def test_links_of_a_bucket_in_blocks_grow_with_its_nodes(kind):
    r = np.random.default_rng(8)
    for n, blocks in ((60, 3), (240, 12)):
        own = r.integers(0, blocks, n)
        base = r.integers(0, 1 << 62, 3)
        which = r.integers(0, 3, n)
        fp = base[which] ^ (1 << r.integers(0, 30, n))
        sets = [np.unique(np.r_[1000 * w : 1000 * w + 30, 500_000 + r.integers(0, 1000)]) for w in which]
        found = []
        for i in range(blocks):
            for j in range(i, blocks):
                at = np.flatnonzero((own == i) | (own == j))
                side = np.where(i == j, 2, (own[at] != i).astype(int))
                if kind == "sets":
                    a, b = simhash.alike_forest(side, np.array([len(sets[k]) for k in at]), np.concatenate([sets[k] for k in at]), between=True)
                    found += list(zip(at[a].tolist(), at[b].tolist(), strict=True))
                else:
                    a, b, _ = simhash.unit_forest(np.zeros(len(at), np.int64), side, fp[at].astype(np.int64), (2,), between=True)
                    found += list(zip(*(x.tolist() for x in simhash.stars(a, b, at)), strict=True))
        assert connected(n, found) == connected(n, [(int(np.flatnonzero(which == w)[0]), int(k)) for w in range(3) for k in np.flatnonzero(which == w)])
        assert len(found) <= n + 3 * blocks * (blocks - 1) // 2  # with the blocks' own trees told again it was n * blocks


def test_stars_join_a_nodes_trees_of_several_units():
    a, b = simhash.stars(np.array([0, 3, 4]), np.array([1, 4, 5]), np.array([7, 9, 5, 9, 8, 7]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(8, 7), (9, 7)]


def test_components_of_a_complete_graph(spark):
    n = 40
    nodes = spark.range(n).select(F.col("id").alias("fp"), F.col("id").alias("low"))
    edges = spark.createDataFrame([(x, y) for x in range(n) for y in range(x)], "a long, b long")
    assert {tuple(x) for x in simhash.components(nodes, edges).select("fp", "label").collect()} == {(x, 0) for x in range(n)}


def test_rounds_move_no_more_links_than_a_group_has_nodes(spark, monkeypatch):
    """A group whose trees are told by many tables, each with another root."""
    n, tables = 400, 20
    nodes = spark.range(n).select(F.col("id").alias("fp"), (-F.col("id")).alias("low"))
    edges = spark.createDataFrame([(x, t) for t in range(tables) for x in range(t + 1, n)], "a long, b long")
    seen = []
    checkpointed = simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: seen.append(checkpointed(df)) or seen[-1])
    got = {tuple(x) for x in simhash.components(nodes, edges).collect()}
    assert got == {(x, 1 - n, n - 1) for x in range(n)}
    assert max(x.count() for x in seen if x.columns == ["a", "b"]) <= n + tables  # both directions of all links: 15,580


def test_roots_equal_brute_force(spark):
    r = np.random.default_rng(4)
    for n, m, batch in ((60, 45, 1 << 20), (300, 500, 16), (300, 280, 16)):
        pairs = [(int(x), int(y)) for x, y in r.integers(0, n, (m, 2))] + [(0, 0)]
        ids = r.integers(-(1 << 62), 1 << 62, n)
        edges = spark.createDataFrame([(int(ids[x]), int(ids[y])) for x, y in pairs], "a long, b long")
        at = {int(x): k for k, x in enumerate(ids)}
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "LINKS", batch)
            got = {at[x["fp"]]: at[x["root"]] for x in simhash.roots(edges).collect()}
        want = connected(n, pairs)
        assert set(got) == {k for p in pairs for k in p if p[0] != p[1]}
        assert len({(want[k], got[k]) for k in got}) == len({want[k] for k in got}) == len(set(got.values()))
