"""Removal of long word sequences that occur earlier, by a compacted De Bruijn graph of the repeated part.

Edges are the windows of `width` consecutive words. Windows in a row that share their rarest-looking inner k-mer (the
minimiser) form a run: a path that is handled as one record, keyed by the minimiser. A minimiser met once marks no
repeated edge, and its run is dropped. Where all runs of a minimiser are alike, the path doesn't branch: it stays
compacted, and every run but the one with the least coordinates (document, start) is a repeat. Where runs differ, the
path branches there, and just those runs are taken apart into their edges, whose first coordinates decide. Equality
rests on two independent 64-bit hashes of the words at the source coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_key

#: Words of a minimiser, and windows in a run at most (two windows then cover all words of a run).
INNER = 7
RUN_BITS = 5
#: Low bits of a packed span that hold its length in words.
SPAN_BITS = 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each `width` consecutive words."""
    n = len(words) - width + 1
    acc = words[:n].copy()
    for j in range(1, width):
        acc *= base
        acc += words[j : n + j]
    return mixed(acc)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rolled(words, width, MIX[0]), rolled(mixed(words), width, MIX[1] | np.uint64(1))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def runs_of(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document: minimiser, start, windows, content hash and whether a window may recur inside, for each run."""
    inner = rolled(words, INNER, MIX[2])
    low = sliding_min(inner, width - INNER + 1)
    most = min(width, 1 << RUN_BITS)
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    sizes = np.diff(np.append(starts, len(low)))
    if (sizes > most).any():
        pieces = -(-sizes // most)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + (np.arange(pieces.sum()) - first) * most
        sizes = np.diff(np.append(starts, len(low)))
    h1, h2 = window_hashes(words, width)
    content = mixed(h1[starts] ^ mixed(h2[starts + sizes - 1]) ^ sizes.astype(np.uint64))
    order = np.argsort(inner, kind="stable")
    close = (inner[order][1:] == inner[order][:-1]) & (np.diff(order) < 2 * width)
    within = np.isin(low[starts], inner[order][1:][close]) if close.any() else np.zeros(len(starts), dtype=bool)
    return low[starts], starts, sizes, content, within


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _slices(batch: pa.RecordBatch, size: int = 64):
    for lo in range(0, batch.num_rows, size):
        yield [c.to_pylist() for c in batch.slice(lo, size).columns]


def find_runs(docs: DataFrame, width: int) -> DataFrame:
    """(d, k, m, sn, r): document, its key, minimiser, start and windows and recurrence packed, content hash."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for ids, keys, texts in _slices(batch):
                d, k, cols = [], [], []
                for i, key, text in zip(ids, keys, texts, strict=True):
                    words = word_hashes(text)
                    if len(words) >= width:
                        m, start, n, r, within = runs_of(words, width)
                        cols.append((m, (((start << 1) | within) << RUN_BITS) | (n - 1), r))
                        d += [i] * len(m)
                        k += [key] * len(m)
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.string()), *(_longs(np.concatenate(c)) for c in zip(*cols, strict=True))], names=["d", "k", "m", "sn", "r"])

    return docs.mapInArrow(run, "d long, k string, m long, sn long, r long")


def windows_in_runs(docs: DataFrame, width: int) -> DataFrame:
    """(h1, h2, d, k, p): the windows of the runs that column `runs` lists for a document."""

    def take_apart(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for ids, keys, texts, runs in _slices(batch):
                d, k, cols = [], [], []
                for i, key, text, sn in zip(ids, keys, texts, runs, strict=True):
                    sn = np.array(sn, dtype=np.int64)
                    start, n = sn >> (RUN_BITS + 1), (sn & ((1 << RUN_BITS) - 1)) + 1
                    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    h1, h2 = window_hashes(word_hashes(text), width)
                    cols.append((h1[at], h2[at], at))
                    d += [i] * len(at)
                    k += [key] * len(at)
                if cols:
                    h1, h2, at = (_longs(np.concatenate(c)) for c in zip(*cols, strict=True))
                    yield pa.RecordBatch.from_arrays([h1, h2, pa.array(d, pa.int64()), pa.array(k, pa.string()), at], names=["h1", "h2", "d", "k", "p"])

    return docs.mapInArrow(take_apart, "h1 long, h2 long, d long, k string, p long")


@F.pandas_udf(T.StructType().add("kept", "string").add("n_words", "long").add("n_removed", "long"))
def without_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        out = []
        for text, some in zip(texts, spans, strict=True):
            words = (text or "").encode("utf-8", "replace").split()
            gone = 0
            if some is not None and len(some):
                ends = np.zeros(len(words) + 1, dtype=np.int64)
                s = np.asarray(some, dtype=np.int64)
                np.add.at(ends, s >> SPAN_BITS, 1)
                np.add.at(ends, (s >> SPAN_BITS) + (s & ((1 << SPAN_BITS) - 1)), -1)
                keep = np.cumsum(ends[:-1]) == 0
                gone = len(words) - int(keep.sum())
                kept = [w for w, x in zip(words, keep.tolist(), strict=True) if x]
            else:
                kept = words
            out.append((b" ".join(kept).decode(), len(words), gone))
        yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])


def find_repeats(docs: DataFrame, width: int, same: list[str]) -> DataFrame:
    """Coordinates `same` of documents with `spans`: array of start and length, packed. docs: (d, k, text), rows distinct."""
    found = find_runs(docs, width).select(*same, "m", "sn", "r")
    within = (F.shiftright("sn", RUN_BITS) % 2).cast("int")
    # What is joined back is written first: Spark then deals both sides out anew and can split a frequent key.
    often = cut(found.groupBy("m").agg(F.sum(1 + within).alias("n")).where("n > 1").select("m"))
    runs = cut(found.join(often, "m"))
    paths = cut(runs.groupBy("m").agg(F.min(F.struct(*same, "sn")).alias("first"), ((F.min("r") == F.max("r")) & (F.max(within) == 0)).alias("alike")))
    # A path met once after all (a run whose window may recur inside) is taken apart like a branching one.
    placed = cut(runs.join(paths, "m").where(~F.col("alike") | (F.struct(*same, "sn") != F.col("first"))).select(*same, "sn", "alike"))
    start = F.shiftright("sn", RUN_BITS + 1)
    span = lambda at, n: F.shiftleft(at, SPAN_BITS) + n
    whole = placed.where("alike").select(*same, span(start, F.col("sn") % (1 << RUN_BITS) + width).alias("span"))

    branches = placed.where(~F.col("alike")).groupBy(*same).agg(F.collect_list("sn").alias("runs"))
    edges = cut(windows_in_runs(on_document(docs, branches, same, "inner").select("d", "k", "text", "runs"), width).select("h1", "h2", *same, "p"))
    first = cut(edges.groupBy("h1", "h2").agg(F.min(F.struct(*same, "p")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = edges.join(first, ["h1", "h2"]).where(F.struct(*same, "p") != F.col("first")).select(*same, span(F.col("p"), F.lit(width)).alias("span"))
    return whole.unionByName(later).groupBy(*same).agg(F.collect_list("span").alias("spans"))


def on_document(docs: DataFrame, more: DataFrame, same: list[str], how: str) -> DataFrame:
    more = more.select(*(F.col(c).alias(f"_{c}") for c in same), *(c for c in more.columns if c not in same))
    cond = F.lit(True)
    for c in same:
        cond = (docs["d"].eqNullSafe(more["_d"]) if len(same) > 1 else docs["d"] == more["_d"]) & cond if c == "d" else (docs[c] == more[f"_{c}"]) & cond
    return docs.join(more, cond, how).drop(*(f"_{c}" for c in same))


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` with kept (words left, joined by one space), n_words, n_removed.

    A word goes if a window of `width` words that covers it also starts earlier: in a document of smaller id, or
    before in the same one; windows are judged on the input. Words are runs of other than ASCII white space, as they
    stand. Null and empty texts have none. Ids are whole numbers, or text that is one; a null id counts as the smallest. Rows that repeat id and text count as one
    document and get equal results; rows that share an id but not the text are told apart by `row_key`. Shorter
    documents are never touched. Columns named like the results are replaced.
    """
    ids = docs.agg(F.count("*"), F.count_distinct(id_col)).first()
    same = ["d"] if ids[0] == ids[1] else ["d", "k"]
    names = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("d"), (row_key(id_col, text_col) if len(same) > 1 else F.lit("")).alias("k"))
    texts = keyed.select("d", "k", "text")
    keyed = keyed.drop("text")
    spans = find_repeats(texts if len(same) == 1 else texts.distinct(), width, same)
    out = on_document(keyed, spans, same, "left").withColumn("cut", without_spans(F.col(f"row.`{text_col}`"), F.col("spans")))
    return out.select("row.*", "cut.kept", "cut.n_words", "cut.n_removed")


def dedup_texts(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated passages cut from its texts; untouched texts stay as they are, n_chars follows the text."""
    out = remove_repeats(docs, width, id_col, text_col)
    out = out.withColumn(text_col, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
