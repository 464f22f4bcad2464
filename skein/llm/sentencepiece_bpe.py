"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of distinct words becomes one flat numpy array of symbols. Each round finds
the lowest pair rank of every word (a segmented minimum), merges all its leftmost
non-overlapping occurrences at once, and compacts the array, until no word has a
pair left. Words end before every space marker that follows another character, between
Latin letters and other characters, and at line ends. No piece crosses these edges (checked
when a model is loaded), so no merge is lost there.

Results equal the sentencepiece library's for BPE models with the identity
normaliser, a dummy prefix and byte fallback (checked when a model is loaded).

Inputs: a null text counts as empty and gives no ids; a null id list decodes to the
empty text; repeated rows each give a row; an empty table gives an empty table.
Extra columns are ignored. A word is processed whole whatever its length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import bounded_batches, id_and_text

MARK = "▁"
NONE = np.int64(1) << 40  # rank of a pair that doesn't merge
SHIFT = np.int64(22)  # code points, offset by the vocabulary size, fit in 22 bits
#: Rounds after which the few words still merging, all very long ones, go to the queue.
MOST_ROUNDS = 400
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 400_000
#: Latin letters, A to Z and U+00C0 to U+024F: no piece joins one to a character outside, other than space markers before it.
LATIN = "A-Za-z\u00c0-\u024f"
WORD = re.compile(rf"{MARK}*(?:[{LATIN}]+|[^{LATIN}{MARK}\n]+)|\n|{MARK}+")


def _each_byte(err: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (err.end - err.start), err.end


codecs.register_error("skein_each_byte", _each_byte)


class PieceBpe:
    """A sentencepiece BPE model's vocabulary with batch encoding and decoding."""

    def __init__(self, model_path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if lib.normalize("ﬁ  x") != f"{MARK}ﬁ{MARK}{MARK}x":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        n = self.size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        scores = np.array([lib.get_score(i) for i in range(n)])
        ranks = np.unique(-scores, return_inverse=True)[1]  # equal scores share a rank

        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.char_ids = np.arange(0x110000, dtype=np.int64) + n  # a character without a piece
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i

        keys, rank, made = [], [], []
        for p, i in ids.items():
            if WORD.fullmatch(p) is None or "\n" in p:
                raise ValueError("only models whose pieces stay inside a word are supported")
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                # A single character that is no piece of its own can still be half of a pair.
                left = left if left is not None or cut > 1 else n + ord(p[0])
                right = right if right is not None or cut < len(p) - 1 else n + ord(p[-1])
                if left is not None and right is not None:
                    keys.append((left << int(SHIFT)) | right)
                    rank.append(ranks[i])
                    made.append(i)
        order = np.argsort(keys)
        self._hash(np.array(keys, dtype=np.int64)[order], np.array(rank, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order])
        self.pair = {k: (int(r), m) for k, r, m in zip(keys, rank, made, strict=True)}

        surface = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            surface[i] = bytes([b])
        for i in range(n):
            if lib.is_control(i):
                surface[i] = b""
            elif lib.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        self.surface = surface
        self.marked = [p.startswith(MARK) and plain[i] for i, p in enumerate(pieces)]
        self.skipped = [lib.is_control(i) for i in range(n)]
        self.number = [str(i) for i in range(n)]
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- encoding

    def _hash(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """An open hash table of the pairs, at most a sixteenth full, with linear probing."""
        self.bits = max(4, len(keys).bit_length() + 4)
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, NONE)
        self.made = np.zeros(size, dtype=np.int64)
        at, self.probes = self._place(keys), 0
        todo = np.arange(len(keys))
        while len(todo):  # every round each free place takes one of the keys that want it
            self.probes += 1
            free = todo[self.keys[at[todo]] == -1]
            place, one = np.unique(at[free], return_index=True)
            self.keys[place] = keys[free[one]]
            self.rank[place] = rank[free[one]]
            self.made[place] = made[free[one]]
            todo = np.setdiff1d(todo, free[one])
            at[todo] = (at[todo] + 1) & (size - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << SHIFT) | right
        at = self._place(key)
        held = self.keys[at]
        found = held == key
        rank, made = np.where(found, self.rank[at], NONE), np.where(found, self.made[at], 0)
        more = np.flatnonzero(~found & (held != -1))
        for k in range(1, self.probes):
            if not len(more):
                break
            at = (self._place(key[more]) + k) & (len(self.keys) - 1)
            found = self.keys[at] == key[more]
            rank[more[found]], made[more[found]] = self.rank[at[found]], self.made[at[found]]
            more = more[~found & (self.keys[at] != -1)]
        return rank, made

    def merge_rounds(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each non-empty word."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sym = self.char_ids[flat]
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), length)
        ended_sym, ended_word = [], []
        queued: list[int] = []

        rank = np.full(len(sym), NONE)
        made = np.zeros(len(sym), dtype=np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], made[inside] = self._look_up(sym[inside], sym[inside + 1])
        for turn in range(MOST_ROUNDS + 1):
            if not len(sym):
                break
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            low = np.minimum.reduceat(rank, first)
            going = low < NONE
            if not going.all():
                stay = np.repeat(going, size)
                ended_sym.append(sym[~stay])
                ended_word.append(word[~stay])
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                low, size = low[going], size[going]
                if not len(sym):
                    break
            if turn == MOST_ROUNDS:
                queued += np.unique(word).tolist()
                break
            low_at = np.repeat(low, size)
            best = rank == low_at
            # In a run of neighbouring candidates every other one merges, from the left.
            place = np.arange(len(sym))
            run_first = np.maximum.accumulate(np.where(best & ~np.r_[False, best[:-1]], place, 0))
            merge = best & ((place - run_first) % 2 == 0)
            at = np.flatnonzero(merge)
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), dtype=bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            skip = at[at >= 2]
            touched[skip[~keep[skip - 1]] - 2] = True  # the left neighbour is itself a merged pair
            merges = np.add.reduceat(merge, np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
            many = np.repeat(merges > 1, size)[keep]
            low_at = low_at[keep]
            sym, word, rank, made, touched = sym[keep], word[keep], rank[keep], made[keep], touched[keep]
            t = np.flatnonzero(touched)
            last = np.r_[word[1:] != word[:-1], True]
            rank[t] = NONE
            inner = t[~last[t]]
            rank[inner], made[inner] = self._look_up(sym[inner], sym[inner + 1])
            # A new pair that ranks no later than the merged one would have come before the
            # word's other merges: such a word is done one merge at a time instead.
            early = t[(rank[t] <= low_at[t]) & many[t]]
            if len(early):
                again = np.unique(word[early])
                queued += again.tolist()
                rest = ~np.isin(word, again)
                sym, word, rank, made = sym[rest], word[rest], rank[rest], made[rest]

        out: list[tuple[int, ...]] = [()] * len(words)
        for w in queued:
            out[w] = self._spelled(self.one_at_a_time(words[w]))
        if ended_sym:
            sym, word = np.concatenate(ended_sym), np.concatenate(ended_word)
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            odd = np.zeros(len(words), dtype=bool)
            odd[word[sym >= self.size]] = True
            listed, bounds = sym.tolist(), first.tolist() + [len(sym)]
            for k, w in enumerate(word[first].tolist()):
                got = listed[bounds[k] : bounds[k + 1]]
                out[w] = self._spelled(got) if odd[w] else tuple(got)
        return out

    def one_at_a_time(self, word: str) -> list[int]:
        """The same merges in a priority queue: lowest rank first, then leftmost."""
        sym = [int(self.char_ids[ord(c)]) for c in word]
        left = list(range(-1, len(sym) - 1))
        right = [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j >= 0 and (hit := self.pair.get((sym[i] << int(SHIFT)) | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i] = self.pair[(a << int(SHIFT)) | b][1]
            sym[j] = -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [s for s in sym if s >= 0]

    def _spelled(self, symbols: list[int]) -> tuple[int, ...]:
        """Characters without a piece become the ids of their bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in chr(s - self.size).encode()]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        get = self.cache.get
        found = [list(map(get, p)) for p in parts]
        lacking = [k for k, f in enumerate(found) if None in f]
        if lacking:
            self._learn({w for k in lacking for w, f in zip(parts[k], found[k], strict=True) if f is None})
            for k in lacking:
                found[k] = [self.cache[w] if f is None else f for w, f in zip(parts[k], found[k], strict=True)]
        return [list(chain.from_iterable(f)) for f in found]

    def _learn(self, new: set[str]) -> None:
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
        chars, block = 0, []
        for w in new:  # blocks of a bounded number of symbols
            block.append(w)
            chars += len(w)
            if chars > 200_000:
                self.cache.update(zip(block, self.merge_rounds(block), strict=True))
                chars, block = 0, []
        if block:
            self.cache.update(zip(block, self.merge_rounds(block), strict=True))

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if not self.skipped[i]), None)
        if first is not None and self.marked[first]:
            raw = raw[1:]
        return raw.decode("utf-8", "skein_each_byte")


@lru_cache(maxsize=2)
def piece_bpe(model_path: str) -> PieceBpe:
    """One per worker process and model."""
    return PieceBpe(model_path)


def _slices(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters."""
    first = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of every whole text."""
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = piece_bpe(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(bpe.encode(texts[i:j]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text that each list of ids stands for."""
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = piece_bpe(model_path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode, in one pass without a shuffle."""
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = piece_bpe(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                all_ids = bpe.encode(texts[i:j])
                listed = [",".join(map(bpe.number.__getitem__, x)) for x in all_ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(map(len, all_ids), pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in all_ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
