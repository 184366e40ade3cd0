"""Byte-pair merging over ragged numpy arrays, for token counts."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import regex

#: The pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone are split here; others by the library's own splitter, as Unicode tables differ between the two.
PLAIN = re.compile("[\t\n\r -~ -ɏ‐-‧‰-⁞]*")
NONE = np.int64(1 << 40)


class Merger:
    """Merge tables of a byte-level vocabulary file for `tokenizers`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = [t["content"] for t in data["added_tokens"]]
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.to_byte = {ord(c): chr(b) for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 17) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def split(self, text: str) -> tuple[list[bytes] | list[str], int]:
        """Pre-tokens of a text, and the number of special strings in it."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        out: list = []
        for part in parts:
            if PLAIN.fullmatch(part):
                out += find(part)
            elif part:
                out += [x.translate(self.to_byte).encode("latin-1") for x, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out, len(parts) - 1

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token. In each step every sequence merges all places of its lowest-rank pair."""
        n = len(tokens)
        result = np.zeros(n, dtype=np.int64)
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
        sym = self.first[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        own = np.repeat(np.arange(n), sizes)
        while len(sym):
            key = np.append((sym[:-1] << 17) | sym[1:], -1)
            key[:-1][own[:-1] != own[1:]] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            lengths = np.diff(np.append(starts, len(own)))
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            result[own[starts[done]]] = lengths[done]
            hit = (rank == np.repeat(low, lengths)) & (rank != NONE)
            if hit[1:].any() and (hit[1:] & hit[:-1]).any():  # a run of one symbol: every second place, from the left
                place = np.arange(len(hit))
                head = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, -1))
                hit &= (place - head) % 2 == 0
            sym = np.where(hit, self.made[np.where(hit, rank, 0)], sym)
            keep = ~np.append(False, hit[:-1]) & np.repeat(~done, lengths)
            sym, own = sym[keep], own[keep]
        return result


find = regex.compile(PATTERN).findall


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def in_chunks(items: list, size: int):
    """Slices of `items`, each of about `size` bytes or one item."""
    ends = np.cumsum([len(x) for x in items])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(size, ends[-1] + size, size)), len(items))) if items else []
    for a, b in pairwise([0, *cuts]):
        if b > a:
            yield items[a:b]
