"""Near copies by the Jaccard similarity of their word shingles, besides SimHash links.

Every distinct shingle set is signed by min-hashes in bands: two sets of similarity s share a band with probability
1 - (1 - s^4)^32, which at 0.8 misses one pair in twenty million. In a band all sets are compared with one leader, the
one with the most company over all its bands, which is what near copies of one text have in common; so a group of them
is joined without its pairs. Sets that still share a band with another component then meet in a prefix-filtered set
join: by the sets' rarest shingles, and only where places and sizes allow the similarity and the components differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_key
from .components import merge_roots
from .simhash import FOLD, classes_of, component_roots, fingerprint_of, member_rows, rows_that_stay

BANDS, IN_BAND = 32, 4
#: Odd factors of the min-hashes, and the shingles taken at a time.
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * IN_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1024
#: Room for rounding in bounds of sizes.
EPS = 1e-9


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all words together, if there are fewer."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype="<u8"))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit number for each band: hash of its min-hashes and its place."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[lo : lo + BLOCK, None] * FACTORS).min(0), out=least)
    groups = least.reshape(BANDS, IN_BAND)
    return np.array([xxhash.xxh3_64_intdigest(g.tobytes(), i) for i, g in enumerate(groups)], dtype=np.uint64).view(np.int64).tolist()


def signed(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, fp, set (128-bit digest of the shingle set), size (of the set), bands."""

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for text in part.column(2).to_pylist():
                    own = shingle_set(text, shingle)
                    out.append((fingerprint_of(text), xxhash.xxh3_128_digest(own.tobytes()), len(own), bands_of(own)))
                fps, digests, sizes, bands = zip(*out, strict=True)
                columns = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "key", "fp", "set", "size", "bands"])

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, key string, fp long, set binary, size long, bands array<long>")


def shingles_of(chosen: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """`chosen` (set, key, and more) with `hashes`, the set itself, read from the texts of those keys."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, shingle).view("<i8") for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", "hashes"])

    wanted = chosen.select("key").distinct()
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).join(wanted, "key", "left_semi")
    return chosen.join(texts.dropDuplicates(["key"]).mapInArrow(read, "key string, hashes array<long>"), "key")


@F.pandas_udf(T.DoubleType())
def jaccard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of two sorted arrays without repeats."""
    for left, right in batches:
        out = []
        for a, b in zip(left, right, strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / (len(a) + len(b) - both))
        yield pd.Series(out, dtype="float64")


def alike(pairs: DataFrame, reps: DataFrame, docs: DataFrame, least: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the fingerprints of those `pairs` (x, y: sets) whose similarity is `least` or more."""
    ends = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    held = cut(shingles_of(reps.join(ends, "set").select("set", "key", "fp"), docs, shingle, id_col, text_col).select("set", "fp", "hashes"))
    left, right = (held.select(F.col("set").alias(c), F.col("fp").alias(f), F.col("hashes").alias(f"hashes_{c}")) for c, f in (("x", "a"), ("y", "b")))
    return cut(pairs.join(left, "x").join(right, "y").where(jaccard("hashes_x", "hashes_y") >= least - EPS).select("a", "b").distinct(), [held])


def sized(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) >= F.greatest(a, b) * least - EPS


def band_pairs(held: DataFrame, least: float) -> DataFrame:
    """(x, y): sets and the leader of a band, in each band (`held`: band, set, size, n) that they share."""
    company = held.groupBy("set").agg(F.sum("n").alias("company"))
    lead = held.join(company, "set").groupBy("band").agg(F.max(F.struct("company", "set", "size")).alias("lead"))
    met = held.join(lead, "band").where((F.col("set") != F.col("lead.set")) & sized("size", F.col("lead.size"), least))
    return met.select(F.least("set", "lead.set").alias("x"), F.greatest("set", "lead.set").alias("y")).distinct()


def viable(entries: DataFrame, least: float) -> DataFrame:
    """The `entries` (h, set, size, root, place) that could meet one of another root at the same shingle.

    Sets of sizes a and b that share no shingle before places p and q have at most 1 + min(a - p, b - q) - 1 in common,
    and need least / (1 + least) * (a + b). The root with the most entries is held against the others, those against all.
    """
    by_root = entries.groupBy("h", "root").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("place").alias("first"))
    top = by_root.groupBy("h").agg(F.max(F.struct("n", "root")).alias("top"))
    sides = by_root.join(top.select("h", F.col("top.root").alias("top")), "h")
    low, high, first = (lambda side: F.min(F.when(side, F.col("lo")))), (lambda side: F.max(F.when(side, F.col("hi")))), (lambda side: F.min(F.when(side, F.col("first"))))
    other, every = F.col("root") != F.col("top"), F.lit(True)
    told = sides.groupBy("h", "top").agg(*(f(side).alias(f"{name}_{s}") for name, f in (("lo", low), ("hi", high), ("first", first)) for s, side in (("o", other), ("e", every))))
    met = entries.join(told.where("lo_o is not null"), "h")
    lo, hi, q = (F.when(F.col("root") == F.col("top"), F.col(f"{c}_o")).otherwise(F.col(f"{c}_e")) for c in ("lo", "hi", "first"))
    a, p = F.col("size"), F.col("place")
    smallest = F.greatest(lo, least * a + (1 + least) * q)
    largest = F.least(hi, (a - p) * ((1 + least) / least) - a, a / least)
    return met.where(smallest <= largest + 1e-6).select(*entries.columns)


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(x, y): the sets of different roots that can be similar, by a prefix-filtered join.

    sets: set, size, root, hashes. A set's shingles are ordered from the rarest on; two sets of similarity `least`
    share one among the first size - least * size + 1 of each. Shingles of one set alone take places but meet nothing.
    """
    each = sets.select("set", "size", "root", F.explode("hashes").alias("h"))
    known = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    here = Window.partitionBy("set")
    place = F.col("size") - F.count("*").over(here) + F.row_number().over(here.orderBy("n", "h")) - 1
    entries = each.join(known, "h").select("h", "set", "size", "root", place.alias("place")).where(F.col("place") <= F.col("size") * (1 - least) + EPS)
    entries = cut(viable(cut(entries), least))
    entries = cut(viable(entries, least), [entries])
    other = entries.select("h", *(F.col(c).alias(f"{c}_") for c in ("set", "size", "root", "place")))
    common = 1 + F.least(F.col("size") - F.col("place") - 1, F.col("size_") - F.col("place_") - 1)
    enough = common >= least / (1 + least) * (F.col("size") + F.col("size_")) - EPS
    apart = (F.col("set") < F.col("set_")) & (F.col("root") != F.col("root_"))
    met = entries.join(other, (entries["h"] == other["h"]) & apart & sized("size", "size_", least) & enough)
    return met.select(F.col("set").alias("x"), F.col("set_").alias("y")).distinct()


def near_copies(docs: DataFrame, distance: int = 3, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `simhash.near_duplicates`, where besides fingerprints at `distance` or fewer bits all texts link whose sets
    of word shingles have a Jaccard similarity of `similarity` or more, however far their fingerprints are.

    Texts of fewer words have the set of all words together, so those without words are alike.
    """
    made = cut(signed(docs, shingle, id_col, text_col))
    rows = made.select("doc_id", "key", "fp")
    classes = classes_of(rows)
    reps = cut(made.groupBy("set").agg(F.min(F.struct("key", "fp")).alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("set", "rep.*", "size", "bands"))
    same = made.select("set", "fp").distinct().join(reps.select("set", F.col("fp").alias("b")), "set").where("fp <> b").select(F.col("fp").alias("a"), "b")

    each = reps.select("set", "size", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    held = cut(each.join(shared, "band"))
    stars = cut(band_pairs(held, similarity))
    member = component_roots(classes, distance, known=alike(stars, reps, docs, similarity, shingle, id_col, text_col).unionByName(same))

    rooted = reps.select("set", "key", "fp", "size").join(member, "fp")
    told = cut(held.select("band", "set").join(rooted.select("set", "root"), "set"))
    split = told.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = cut(rooted.join(told.join(split, "band", "left_semi").select("set").distinct(), "set"))
    sets = cut(shingles_of(open_, docs, shingle, id_col, text_col).select("set", "size", "root", "hashes"))
    rest = cut(prefix_pairs(sets, similarity), [sets])
    return member_rows(rows, classes, merge_roots(member, alike(rest, reps, docs, similarity, shingle, id_col, text_col), "fp"))


def keep_one(docs: DataFrame, distance: int = 3, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the one of the smallest id (of repeated rows one), columns unchanged."""
    return rows_that_stay(docs, near_copies(docs, distance, similarity, shingle, id_col, text_col), id_col, text_col)
