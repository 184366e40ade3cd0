"""Byte-level BPE by prefix dynamic programming.

Merging pairs by rank has one outcome for each byte string, and that of a prefix is that of the string up to its last
token, if tokens end there. So each byte prefix has just one last token, and whether a token may follow another depends
on the two alone: their bytes together must merge to just these two. Prefixes are filled in from left to right; the ids
are read off backwards. Bytes put at the end leave all earlier prefixes as they are, and behind an edit the old ones hold
again as soon as a stretch of the longest token's length has come out as before.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a worker remembers before it starts anew: pairs of tokens, and pieces of text of up to LONG bytes.
PAIRS, PIECES, LONG = 300_000, 300_000, 256
RESULTS = ("n_tokens", "ids")
#: Texts whose results are held at a time.
SLICE = 512


class Vocabulary:
    """Tokens and ranks of a `.tiktoken` file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.endings = ahocorasick.Automaton()  # tokens that end at a byte, the longest first
        for token, rank in self.ranks.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), rank))
        self.endings.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """Ids of a short byte string by the rule itself: the leftmost pair of lowest rank is merged until none has one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of which the last merge makes this one; none for a byte, or if no merges make it."""
        if token not in self.halves:
            parts = self.merged(self.tokens[token], down_to=2)
            if len(parts) == 2 and max(parts) > token:
                raise ValueError(f"token {token} comes before its halves {parts}: ranks must be in the order of the merges")
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def stands_alone(self, token: int) -> bool:
        """Whether a token's bytes merge to that token."""
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the bytes of two tokens merge to just these two.

        Merges are undone from the last to the first. Two neighbours over the border would merge if their pair comes
        before the merge that takes one of them away; of equal ranks the one further left comes first.
        """
        if not (self.stands_alone(before) and self.stands_alone(token)):
            return False
        a, b, until = before, token, None
        while True:
            crossing = self.ranks.get(self.tokens[a] + self.tokens[b])
            if crossing is not None and (until is None or crossing < until):
                return False
            whole_a, whole_b = self.split(a), self.split(b)
            if whole_a is None and whole_b is None:
                return True
            if whole_b is None or (whole_a is not None and a > b):
                a, until = whole_a[1], a
            else:
                b, until = whole_b[0], b + 1

    def extend(self, data: bytes, last: list[int]) -> None:
        """Puts the last tokens of all further prefixes of `data` at the end of those that are known."""
        first = len(last)
        base = max(0, first + 1 - self.longest)
        known = self.pairs
        if len(known) >= PAIRS:
            known.clear()
        last += [-1] * (len(data) - first)
        for at, (size, token) in self.endings.iter(data[base:].decode("latin-1")):
            end = base + at
            if end < first or last[end] >= 0:
                continue
            start = end - size
            if start < 0:
                fits = self.stands_alone(token)
            else:
                pair = last[start], token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = self.may_follow(*pair)
            if fits:
                last[end] = token


class Prefixes:
    """The last token of each byte prefix of one piece of text."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Puts bytes at the end; what is there stays as it is."""
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in the place of bytes start to end; gives how many prefixes were worked out anew."""
        old, shift = self.last, start + len(new) - end
        self.data, self.last = self.data[:start] + new + self.data[end:], old[:start]
        done, step = start + len(new), self.vocabulary.longest
        self.vocabulary.extend(self.data[:done], self.last)
        while done < len(self.data):
            more = min(done + step, len(self.data))
            self.vocabulary.extend(self.data[:more], self.last)
            same = self.last[done:more] == old[done - shift : more - shift]
            done = more
            if same:
                self.last += old[done - shift :]
                break
        return done - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Splitter:
    """Matches of a pattern as the library finds them.

    Character tables differ between versions of Unicode, so characters that this Python doesn't know are put to the
    library: whether they join a letter, a digit or a mark. The pattern is then matched with a known one of that kind.
    """

    KINDS = "a1!"

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        pairs = [bytes([i]) for i in range(256)] + [kind.encode() + bytes([i]) for kind in self.KINDS for i in range(256)]
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(pairs)}, special_tokens={})
        self.known: dict[str, str] = {}

    def kind(self, c: str) -> str:
        if c not in self.known:
            self.known[c] = next((k for k in self.KINDS if self.probe.encode_ordinary(k + c)[0] > 255), c)
        return self.known[c]

    def split(self, text: str) -> list[str]:
        odd = () if text.isascii() else {c for c in set(text) if unicodedata.category(c) in ("Cn", "Co")}
        if not odd:
            return self.find(text)
        stand_in = text.translate({ord(c): self.kind(c) for c in odd})
        return [text[m.start() : m.end()] for m in self.spans(stand_in)]


class Encoder(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers; those of short pieces are remembered."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.vocabulary, self.splitter = Vocabulary(path), Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = np.array([whole] if whole is not None else Prefixes(self.vocabulary, data).ids(), dtype="<u4").tobytes()
        if len(data) <= LONG:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.splitter.split(text)))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, so that what it remembers outlives a task."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; ids that have none are empty."""
    tokens = Vocabulary(path).tokens
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def encoding(path: str, pattern: str, decode: bool = False):
    """Arrow UDF: ids of each text as one binary, and if asked for the bytes that these stand for, from the same worker."""
    names = ("ids", "decoded") if decode else ("ids",)

    @F.arrow_udf(", ".join(f"{n} binary" for n in names))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        token = own.vocabulary.tokens.__getitem__
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                out = []
                for text in batch.slice(lo, SLICE):
                    if len(own) > PIECES:
                        own.clear()
                    out.append(own.encode(text.as_py() or ""))
                told = [pa.array(out, pa.binary())]
                if decode:
                    told.append(pa.array([b"".join(map(token, np.frombuffer(ids, dtype="<u4").tolist())) for ids in out], pa.binary()))
                yield pa.StructArray.from_arrays(told, names=list(names))

    return encode


def decoding(path: str):
    """Arrow UDF: bytes of each binary of ids."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = token_bytes(path).__getitem__
        for batch in batches:
            yield pa.array([b"".join(map(token, np.frombuffer(ids.as_py() or b"", dtype="<u4").tolist())) for ids in batch], pa.binary())

    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """All rows and columns of `docs` with ids (little-endian unsigned 32-bit, one binary) and n_tokens, and with `decode`
    the bytes that the ids stand for (decoded).

    Each match of `pattern` is encoded by itself, as the library would: a match that is a token is that token, others
    merge by rank. Special tokens are ordinary text. Null and empty texts have no ids. Repeated rows get equal results; an
    empty table stays empty; columns named like the results are replaced. Texts are read whole, in time that grows with their
    length even where a match is long; one pass, no shuffle.
    """
    results = (*RESULTS, "decoded") if decode else RESULTS
    names = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    told = docs.select(F.struct(*names).alias("row"), encoding(path, pattern, decode)(F.coalesce(F.col(text_col), F.lit(""))).alias("told"))
    ids = F.col("told.ids")
    return told.select("row.*", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), *(F.col(f"told.{c}") for c in results[1:]))


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids stand for, as binary; null and empty ids give none. An id that the vocabulary lacks is an error."""
    return decoding(path)(ids)
