"""Ids and pre-tokens of byte-level BPE texts, equal to the tokenizers library's.

Pre-tokens are the tokenizer's own for every text: its pattern is written for Python's
re with the character classes that the library's pre-tokenizer shows when it is given
every code point, so no two versions of Unicode are mixed. Special tokens inside a text
are cut out first, as the library does.

Ids come from tiktoken's merge loop with the same vocabulary. It merges by the rank of
the joined bytes, the library by listed pairs. These agree on every text if every
token's own bytes encode to that token alone: then whenever two neighbours join to a
token, the merges inside its bytes have run as in isolation, which ends in the listed
pair. That is checked for the whole vocabulary when it is loaded.

Texts of Latin letters and common signs (no UNSAFE character) go to tiktoken whole; its
pattern engine can't take very long runs of white space, so texts with LONG_RUN, and
those with other characters, are merged pre-token by pre-token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

#: Latin letters; the other characters of known class.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHERS = "\\t\\n\\r\\x20-\\x7e¡-©«-±´¶-¸»¿×÷‐-‧€"
UNSAFE = re.compile(f"[^{LETTERS}{OTHERS}]")
LONG_RUN = re.compile(r"\s{10000}")
#: Distinct pre-tokens whose ids a worker remembers, of at most CACHED_CHARS characters.
CACHE_PIECES, CACHED_CHARS = 200_000, 64


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def pre_token_pattern(letters: str, numbers: str, spaces: str) -> re.Pattern[str]:
    """The byte-level pre-tokenizer's pattern over these character classes."""
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


#: For texts without UNSAFE characters; short classes are quicker.
LATIN_PRE_TOKEN = pre_token_pattern(LETTERS, "0-9", r"\t\n\r\x20")


@lru_cache(maxsize=1)
def any_pre_token() -> re.Pattern[str]:
    """For all texts. The library splits the string of all code points from U+0080 wherever their class changes."""
    from tokenizers.pre_tokenizers import ByteLevel

    pre = ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))))
    classes: dict[str, list[str]] = {"x": [], "1": [], "!": [], "": []}
    for _, (a, b) in pre.pre_tokenize_str(every):
        own = next((like for like in "x1!" if len(pre.pre_tokenize_str(like + every[a])) == 1), "")
        classes[own].append(f"{re.escape(every[a])}-{re.escape(every[b - 1])}")
    return pre_token_pattern("A-Za-z" + "".join(classes["x"]), "0-9" + "".join(classes["1"]), r"\t-\r\x20" + "".join(classes[""]))


class BytePieces:
    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE tokenizers without normaliser or prefix space are supported")
        added = lib.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("only added tokens that match as they are written are supported")
        self.special = {t.content: i for i, t in added.items()}
        letters = byte_letters()
        names = {name: i for name, i in spec["model"]["vocab"].items() if name not in self.special}
        ranks = {bytes(map(letters.__getitem__, name)): i for name, i in names.items()}
        if any([t.id for t in lib.model.tokenize(name)] != [i] for name, i in names.items()):
            raise ValueError("a token's own bytes encode to something else")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.known: dict[str, list[int]] = {}

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special tokens, with None, and these tokens with their ids."""
        at = 0
        for m in self.specials.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text, None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        return (any_pre_token() if UNSAFE.search(text) else LATIN_PRE_TOKEN).findall(text)

    def merged(self, piece: str) -> list[int]:
        """The ids of one pre-token, of whatever length."""
        return self.fast._encode_single_piece(piece)

    def _remembered(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.merged(piece)
            if len(piece) <= CACHED_CHARS:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The whole text's ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(np.array([special], dtype="<u4"))
            elif UNSAFE.search(part) or LONG_RUN.search(part):
                out.append(np.fromiter(chain.from_iterable(map(self._remembered, self.pieces(part))), "<u4"))
            else:
                out.append(self.fast.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False))
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, dtype="<u4")


@lru_cache(maxsize=2)
def byte_pieces(tokenizer_path: str) -> BytePieces:
    """One per worker process and tokenizer."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    return BytePieces(tokenizer_path)
