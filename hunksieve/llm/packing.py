"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window it fills best; when none has room,
the fullest window is emitted and a new one opened. What is still open when a partition ends is merged with the
leftovers of its neighbours, a bounded number of partitions at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Windows open in a partition; partitions whose leftovers are merged together; words a worker remembers.
OPEN, MERGED, REMEMBERED = 64, 8, 600_000
#: Texts of these characters alone are split into words here; others go to the library whole.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įıĴ-ňŊ-ž]*")
#: Fixed value: the word pattern of this vocabulary, over PLAIN.
WORDS = re.compile("[a-zß-öø-ž]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\\sa-z0-9ß-öø-ž]+")
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part int"
ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}[t]) for n, t in (x.split(" ") for x in SCHEMA.split(", "))])


class WordEncoder:
    """Ids of texts by a vocabulary whose words end in a marked symbol; words are looked up, new ones encoded in bulk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [WORDS.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        new = list(set().union(*filter(None, split)).difference(self.known))
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            self.known.update((w, data[a:b]) for w, a, b in zip(some, [0, *stops], stops, strict=False))
        whole = iter(self.library.encode_batch_fast([t for t, words in zip(texts, split, strict=True) if words is None], add_special_tokens=False))
        get = self.known.__getitem__
        for words in split:
            yield np.array(next(whole).ids, dtype="<u4") if words is None else np.frombuffer(b"".join(map(get, words)), dtype="<u4")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, so that what it remembers outlives a task."""
    return WordEncoder(path)


class OpenWindows:
    """Best fit over at most `most` windows; `add` returns the window that had to go, if any."""

    def __init__(self, size: int, most: int | None):
        self.size, self.most, self.rooms, self.held, self.made = size, most, [], {}, 0

    def add(self, piece: tuple, length: int) -> list[tuple] | None:
        gone = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, key = self.rooms.pop(at)
        else:
            if self.most and len(self.rooms) >= self.most:
                gone = self.held.pop(self.rooms.pop(0)[1])
            room, key, self.made = self.size, self.made, self.made + 1
            self.held[key] = []
        self.held[key].append((*piece, self.size - room))
        if room > length:
            insort(self.rooms, (room - length, key))
            return gone
        full = self.held.pop(key)
        return full if gone is None else gone + full

    def rest(self) -> Iterator[list[tuple]]:
        yield from self.held.values()


def batches(rows: Iterator[tuple], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about `size` bytes of ids."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[6]) + 64
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


def packer(path: str, end_id: int, size: int, most: int):
    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows, part = word_encoder(path), OpenWindows(size, most), TaskContext.get().partitionId()
        count = 0

        def rows():
            nonlocal count
            for batch in source:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for lo in range(0, len(ids), 128):
                    for doc, tokens in zip(ids[lo : lo + 128], encoder.encode([t or "" for t in texts.slice(lo, 128).to_pylist()]), strict=True):
                        tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                        for start in range(0, len(tokens), size):
                            piece = tokens[start : start + size]
                            gone = windows.add((doc, start, len(piece), len(tokens), piece.tobytes()), len(piece))
                            if gone:
                                yield from emitted(gone)
            for window in windows.rest():
                for doc, start, n, total, data, _ in window:
                    yield doc, start, n, total, None, None, data, part

        def emitted(window):
            nonlocal count
            for doc, start, n, total, data, offset in window:
                count += offset == 0
                yield doc, start, n, total, (part << 32) + count, offset, data, None

        yield from batches(rows())

    return pack


def merge_leftovers(size: int):
    """Best fit of the largest pieces first, over the leftovers of one group of partitions."""

    def merge(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [tuple(r.values()) for b in source for r in b.select(["doc_id", "start", "length", "doc_tokens", "ids"]).to_pylist()]
        pieces.sort(key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[4]))
        windows, full = OpenWindows(size, None), []
        for p in pieces:
            if gone := windows.add(p, p[2]):
                full.append(gone)
        rows = ((doc, start, n, total, (1 << 62) + (key[0].as_py() << 32) + i, offset, data, None) for i, w in enumerate(chain(full, windows.rest())) for doc, start, n, total, data, offset in w)
        yield from batches(rows)

    return merge


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, open_windows: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids: little-endian uint32 binary).

    A document's ids end in `end_id`; one of more than `size` ids is cut at multiples of `size`. A null or empty text
    is the end id alone. Repeated rows are packed as often as they occur. Ids are whole numbers, or text that is one; a
    null id stays. An empty table gives no pieces; other columns don't matter. No window exceeds `size`, and offsets in a
    sequence are gapless. The tokens are written once and read twice: for the emitted windows and for the leftovers,
    of which a group holds at most `MERGED * open_windows` windows.
    """
    pieces = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packer(path, end_id, size, open_windows), SCHEMA))
    left = pieces.where("part is not null").withColumn("_group", F.floor(F.col("part") / MERGED))
    merged = left.groupBy("_group").applyInArrow(merge_leftovers(size), SCHEMA)
    return pieces.where("part is null").unionByName(merged).drop("part")
