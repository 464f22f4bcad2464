"""SentencePiece, byte-level BPE, token counts and packing against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import packing, sentencepiece_bpe, token_counts
from skein.llm.byte_bpe import BytePieces

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
LETTERS = "abcdeinorst ▁\n\t\r.,!'ÀÉé×÷日🙂0²Ⅷ\x85\x1c 　_-ñ—“«€ǅ"


@pytest.fixture(scope="module")
def piece_lib():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bpe():
    return sentencepiece_bpe.PieceBpe(PIECES)


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def pieces():
    return BytePieces(BYTES)


def odd_texts():
    r = random.Random(5)
    out = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 120))) for _ in range(1500)]
    out += ["".join(r.choice("abetnrsi") for _ in range(20_000)), " " * 40 + "x" + " " * 31 + "the" + " " * 17, "a" * 3000, "<s>x</s><unk><0x41>"]
    return out + ["".join(r.choice(" a") for _ in range(300)) for _ in range(100)]


def test_encoding_equals_the_library(bpe, piece_lib, sample):
    texts = [t for _, t in sample] + odd_texts()
    ids = bpe.encode(texts)
    assert ids == piece_lib.encode(texts, num_threads=1)
    assert [bpe.decode(i) for i in ids] == [piece_lib.decode(i) for i in ids]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_encoding_of_any_text(bpe, piece_lib, text):
    assert bpe.encode([text]) == [piece_lib.encode(text)]


def test_decoding_of_any_ids(bpe, piece_lib):
    r = random.Random(7)
    for _ in range(1500):
        ids = [r.randrange(32_000) for _ in range(r.randint(0, 30))] + [r.randrange(3, 259) for _ in range(r.randint(0, 9))]
        assert bpe.decode(ids) == piece_lib.decode(ids)


def test_rounds_equal_the_queue(bpe):
    words = ["▁" + w for w in ("internationalisation", "aaaaaaaaaaaaa", "banana" * 50, "日本語", "x")]
    assert [list(x) for x in bpe.merge_rounds(words)] == [list(bpe._spelled(bpe.one_at_a_time(w))) for w in words]


def test_small_caches_change_nothing(piece_lib, byte_lib, sample, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr("skein.llm.byte_bpe.CACHE_PIECES", 50)
    texts = [t for _, t in sample[:60]]
    small, counts = sentencepiece_bpe.PieceBpe(PIECES), BytePieces(BYTES)
    for k in range(0, 60, 7):
        assert small.encode(texts[k : k + 7]) == piece_lib.encode(texts[k : k + 7])
        assert token_counts.count_batch(counts, texts[k : k + 7]).tolist() == [len(e) for e in byte_lib.encode_batch(texts[k : k + 7], add_special_tokens=False)]


def test_many_rounds_end_in_the_queue(piece_lib, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "MOST_ROUNDS", 3)
    texts = odd_texts()[:300]
    assert sentencepiece_bpe.PieceBpe(PIECES).encode(texts) == piece_lib.encode(texts)


def test_round_trip_frames(make, piece_lib, odd):
    df = make(odd, clash=True)
    got = sentencepiece_bpe.round_trip_digests(df, PIECES).collect()
    want = []
    for i, t in odd:
        ids = piece_lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece_lib.decode(ids).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    ids = sentencepiece_bpe.encode(df, PIECES)
    back = sentencepiece_bpe.decode(ids, PIECES)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in odd if t is None or "▁" not in t) + Counter((i, t.replace("▁", " ")) for i, t in odd if t and "▁" in t)
    assert sentencepiece_bpe.round_trip_digests(make([]), PIECES).count() == 0
    nothing = ids.selectExpr("doc_id", "cast(null as array<int>) as ids")
    assert {r["text"] for r in sentencepiece_bpe.decode(nothing, PIECES).collect()} == {""}


def test_byte_ids_equal_the_library(pieces, byte_lib, sample):
    texts = [t for _, t in sample] + odd_texts() + ["a<|endoftext|> b", "<|endoftext|>", "  \n <|endoftext|>  x"]
    want = [e.ids for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
    assert [pieces.encode(t).tolist() for t in texts] == want
    assert token_counts.count_batch(pieces, texts).tolist() == list(map(len, want))


def test_long_texts_are_counted_in_slices(pieces, byte_lib, sample, monkeypatch):
    monkeypatch.setattr(token_counts, "text_slices", lambda t, f=token_counts.text_slices: f(t, 50))
    texts = [t for _, t in sample[:80]] + odd_texts()[:500]
    assert token_counts.count_batch(pieces, texts).tolist() == [len(e) for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
    assert all("".join(token_counts.text_slices(t)) == t for t in texts)


def test_token_count_frames(make, byte_lib, odd):
    got = token_counts.token_counts(make(odd, clash=True), BYTES, limit=9).collect()
    n = lambda t: len(byte_lib.encode(t or "", add_special_tokens=False))
    assert Counter(map(tuple, got)) == Counter((i, len((t or "").encode()), n(t), n(t) > 9) for i, t in odd)
    assert token_counts.token_counts(make([]), BYTES).count() == 0


def test_long_runs_are_encoded(pieces, byte_lib):
    for text in (" " * 1_000_000, "\n" * 1_000_000 + "x", "a" + " \t" * 600_000 + " b <|endoftext|>" + "\n" * 20_000, "é日" + "\u3000" * 300_000, "x" * 1_000_000, "日" * 300_000, "!?" * 500_000):
        want = byte_lib.encode(text, add_special_tokens=False).ids
        assert pieces.encode(text).tolist() == want
        assert token_counts.count_batch(pieces, [text]).tolist() == [len(want)]


def test_pre_tokens_are_the_tokenizers_own(pieces):
    from tokenizers.pre_tokenizers import ByteLevel

    pre = ByteLevel(add_prefix_space=False, use_regex=True)
    r = random.Random(11)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = odd_texts() + ["".join(chr(r.choice(points)) if r.random() < 0.5 else r.choice(LETTERS) for _ in range(30)) for _ in range(5000)]
    for text in texts:
        assert pieces.pieces(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]


@pytest.mark.parametrize("head", [0, 3, 40])
def test_pre_tokens_beyond_the_broadcast_are_joined(make, byte_lib, odd, sample, head):
    rows = odd + sample[:150] + [(9, "a <|endoftext|>" + " " * 50_000 + "日本"), (9, "x" * 100_000)]
    got = token_counts.token_counts(make(rows, clash=True), BYTES, limit=9, head=head).collect()
    n = lambda t: len(byte_lib.encode(t or "", add_special_tokens=False))
    assert Counter(map(tuple, got)) == Counter((i, len((t or "").encode()), n(t), n(t) > 9) for i, t in rows)


def test_every_distinct_pre_token_is_counted_once(make, pieces, sample, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 20)
    docs = make(sample[:100]).select("text")
    table = {bytes(r["piece"]).decode(): (r["times"], r["n"]) for r in token_counts.piece_counts(token_counts.distinct_pieces(docs, BYTES), BYTES).collect()}
    times = Counter(p for _, t in sample[:100] for p in pieces.pieces(t))
    assert table == {p: (k, len(pieces.merged(p))) for p, k in times.items()}


@settings(deadline=None)
@given(st.integers(0, 100_000), st.sampled_from([1, 2, 64, 2048]))
def test_binary_lengths(n, most):
    got = packing.binary_lengths(n, most)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= most for x in got)
    assert len(got) == n // most + (n % most).bit_count() and got == sorted(got, reverse=True)


def test_packing_frames(make, byte_lib, odd, sample, tmp_path):
    rows = odd + [(i + 100, t) for i, t in sample[:200]]
    df = make(rows, clash=True)
    got = packing.pack(df, BYTES, max_tokens=64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and 1 << r["bucket"] == r["length"] <= 64 and r["sequence_id"] % 32 == r["bucket"] for r in got)
    want, have = defaultdict(Counter), defaultdict(lambda: defaultdict(list))
    for i, t in rows:
        ids = byte_lib.encode(t or "", add_special_tokens=False).ids + [1]
        want[i][tuple(ids)] += 1
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"]
        have[r["doc_id"]][r["doc_tokens"]].append((r["start"], ids))
    for i, texts in want.items():
        for ids, times in texts.items():
            parts = sorted(p for p in have[i][len(ids)])
            assert sum(len(p) for _, p in parts) == sum(len(x) * k for x, k in texts.items() if len(x) == len(ids))
            for start, part in parts:
                assert any(part == list(x[start : start + len(part)]) for x in texts if len(x) == len(ids))
            assert times >= 1
    crc = packing.pack_digests(make(sample[:50]), BYTES).collect()
    whole = {i: byte_lib.encode(t, add_special_tokens=False).ids + [1] for i, t in sample[:50]}
    for r in crc:
        part = np.array(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(whole[r["doc_id"]])
    assert packing.pack(make([]), BYTES).count() == 0
    path = str(tmp_path / "packed")
    packing.write_buckets(packing.pack(df, BYTES, max_tokens=64), path)
    full = df.sparkSession.read.parquet(f"{path}/bucket=6")
    assert {r["length"] for r in full.select("length").collect()} == {64} and full.count() == sum(r["length"] == 64 for r in got)
    for wrong in (0, 3, 100):
        with pytest.raises(ValueError):
            packing.pack(df, BYTES, max_tokens=wrong)
