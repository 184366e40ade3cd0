"""Canonical exact document fingerprints, and what an edit does to them."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_key, text_bytes

#: So many shared digests are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text in a range of ids, the most ranges (beyond them ranges grow; a task sorts with spills and streams), ids sampled for each.
RANGE_BYTES, MOST_RANGES, SAMPLE = 32 << 20, 1 << 14, 16


def canonical_text(text: str | None) -> str:
    """Compatibility-normalised, case-folded, normalised again; white space folded to single spaces."""
    text = text or ""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def namer(clashes: frozenset[str]) -> Callable[[str | None], str]:
    """A text's fingerprint: the wide digest of its canonical form, longer in the buckets where texts differ."""

    def name(text: str | None) -> str:
        data = canonical_text(text).encode("utf-8", "replace")
        short = xxhash.xxh3_128_hexdigest(data)
        return f"{short}-{hashlib.sha256(data).hexdigest()}" if short in clashes else short

    return name


@F.pandas_udf(T.StringType())
def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(canonical_text)


def fingerprint_udf(clashes: frozenset[str] = frozenset()):
    @F.pandas_udf(T.StringType())
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        name = namer(clashes)
        for texts in batches:
            yield texts.map(name)

    return fingerprint


def find_clashes(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """Digests that different canonical texts share, found by comparing bytes inside equal buckets.

    Of each bucket of more than one row a task sends on its least and greatest canonical text, however many copies it
    holds; they are equal just if all are. At 128 bits no clash is to be expected at any size, so the set is tiny.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_digest", fingerprint_udf()("_text"))
    shared = cut(texts.groupBy("_digest").count().where("count > 1").select("_digest"))
    small = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    members = texts.join(small, "_digest", "left_semi").select("_digest", canonical("_text").alias("_canon"))
    bounds = members.groupBy("_digest").agg(F.min("_canon").alias("lo"), F.max("_canon").alias("hi"))
    return frozenset(r[0] for r in bounds.where("lo <> hi").select("_digest").collect())


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with fingerprint: equal exactly where the canonical texts are equal byte by byte. Null counts as empty.

    Repeated rows get equal fingerprints. A column of that name is replaced. Texts are not shuffled.
    """
    return docs.withColumn("fingerprint", fingerprint_udf(find_clashes(docs, text_col))(F.coalesce(F.col(text_col), F.lit(""))))


def range_bounds(rows: DataFrame, wanted: int) -> np.ndarray:
    """Ids at which ranges begin, from a sample of ids by their hashes: SAMPLE for each range, MOST_RANGES ranges at most.

    They decide which task a row goes to and nothing else, so the sample doesn't show in the result.
    """
    n = rows.count()
    share = min(1.0, SAMPLE * wanted / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(5), "d"), F.lit(1 << 30)) < int(share * (1 << 30))).where("d is not null")
    ids = np.sort(np.array([r[0] for r in chosen.select("d").distinct().limit(2 * SAMPLE * wanted).collect()], dtype=np.int64))
    return np.unique(ids[(np.arange(1, wanted) * len(ids)) // wanted]) if len(ids) else ids


def by_id_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, k, text, next) in ranges of ids, sorted in each; the first rows of a range follow the one before as `next`.

    The ranges' first ids are values of the table, so the row after a range's last one is known at the scan. After the
    last range come the first rows of all. Null ids are the smallest. Ids are whole numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("d"), row_key(id_col, text_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, least, nulls = docs.agg(F.sum(text_bytes(text_col)), F.min(F.col(id_col).cast("long")), F.count_if(F.col(id_col).isNull())).first()
    wanted = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // RANGE_BYTES))
    found = range_bounds(rows, wanted)
    bounds = found[found != least] if not nulls and least is not None else found
    last = len(bounds)

    @F.pandas_udf("part int, follows int")
    def place(ids: pd.Series) -> pd.DataFrame:
        """The range of each id, and the range that it follows as its first id, or -1."""
        d = ids.to_numpy(dtype=np.int64)
        at = np.searchsorted(bounds, d, side="right")
        first = (at > 0) & (bounds[np.maximum(at, 1) - 1] == d) if last else np.zeros(len(d), dtype=bool)
        return pd.DataFrame({"part": at.astype(np.int32), "follows": np.where(first, at - 1, -1).astype(np.int32)})

    told = rows.withColumn("at", place(F.coalesce("d", F.lit(0).cast("long"))))
    part = F.when(F.col("d").isNull(), 0).otherwise(F.col("at.part"))
    follows = F.when(F.col("d").isNull() | (F.col("at.follows") < 0), None).otherwise(-1 - F.col("at.follows"))
    wraps = F.when(F.col("d").isNull() if nulls else F.col("d") == F.lit(least), -1 - last)
    placed = told.withColumn("place", F.explode(F.array_compact(F.array(part, follows, wraps))))
    placed = placed.select("d", "k", "text", (F.col("place") < 0).alias("next"), F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("part"))
    return placed.repartitionById(last + 1, F.col("part")).sortWithinPartitions("next", F.col("d").asc_nulls_first(), "k").drop("part")


def fingerprints_under_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) for each row.

    `edited` has the last n_chars // share code points replaced by the first as many (or all) of the next document in
    order of id; after the last comes the first, a sole document follows itself. Rows that repeat id and text are one
    document here and get equal results; texts of one id are ordered by `row_key`. Null texts count as empty. Ids are whole
    numbers, or text that is one; an empty table gives no rows.
    """
    clashes = find_clashes(docs, text_col)

    def walk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, copies = namer(clashes), None, 0  # the row that waits for the next one's text, and how often it came

        def done(text: str) -> tuple:
            d, _, own = held
            n = len(own) // share
            edited = own[: len(own) - n] + text[:n]
            return (d, len(own), edited, name(own), name(edited), name(text))

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True)], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"])

        for batch in source:
            for lo in range(0, batch.num_rows, 64):
                out = []
                for d, k, text, follows in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    if held and (follows or held[:2] != (d, k)):
                        row = done(text)
                        for _ in range((copies - 1) // 64):
                            yield told([row] * 64)
                        out += [row] * ((copies - 1) % 64 + 1)
                        held, copies = None, 0
                    if not follows:
                        held, copies = (d, k, text), copies + 1
                if out:
                    yield told(out)

    return by_id_ranges(docs, id_col, text_col).mapInArrow(walk, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def likeness(a: str, b: str):
    """1 for equal fingerprints, else 0: an exact digest knows no more."""
    return (F.col(a) == F.col(b)).cast("double")
