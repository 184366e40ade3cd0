"""SimHash fingerprints and links at few differing bits, by the generalised pigeonhole principle.

Correlated bits are grouped into parts. For each fingerprint a dynamic program gives every part its own threshold, by
the candidates that a histogram of the parts lets expect; the thresholds add up to `distance - parts + 1`, so a linked
fingerprint must lie within the threshold in some part. Each fingerprint is indexed by its parts' values once and
probes the values around its own; what meets is verified over all bits. Fingerprints at two bits or fewer that meet in
a common neighbour are joined to components before, and only what lies in different components is linked then: a
dense group of near copies never makes its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, cut, row_key
from .components import merge_roots

BITS = 64
#: Bits of a part that its histogram tells apart, and the probes made at a time.
BIN_BITS, BATCH = 12, 1 << 19
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64 bits; a bit is set if it is set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    total = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(parts), 4096):
        some = parts[lo : lo + 4096]
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in some), dtype="<u8", count=len(some))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(parts)).tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).astype(np.int64))


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(fps: np.ndarray) -> np.ndarray:
    """(n, 64): bit i in column i."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pairs(classes: DataFrame) -> np.ndarray:
    """How often each two bits are both set, over all fingerprints: 64 x 64 sums, whatever the size."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in source:
            x = _bits(_fps(batch)).astype(np.float32)
            total += np.rint(x.T @ x).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for i, j, n in classes.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = out[j, i] = n
    return out


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal width, each grown from a bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        part = [max(free, key=lambda b: (corr[b, list(free)].sum(), -b))]
        free -= {*part}
        while len(part) < width:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free -= {part[-1]}
        out.append(part)
    return out


def values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, as one number."""
    out = np.zeros(len(fps), dtype=np.int64)
    for k, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def probes(width: int, threshold: int) -> int:
    return sum(comb(width, d) for d in range(threshold + 1))


def masks(width: int, threshold: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for d in range(threshold + 1) for c in combinations(range(width), d)], dtype=np.int64)


def choose_parts(n: int, distance: int) -> int:
    """The number of parts with the least probes and candidates for n evenly spread fingerprints."""

    def cost(parts: int) -> float:
        width = BITS // parts
        spare = distance - parts + 1
        return sum(probes(width, t) * (1 + n / 2**width) for t in [spare // parts + (i < spare % parts) for i in range(parts)])

    return min(range(2, distance + 2), key=cost)


def thresholds(costs: list[np.ndarray], distance: int) -> np.ndarray:
    """(n, parts), each -1 to distance, adding up to distance - parts + 1, of least cost. costs[i][:, t]: of threshold t."""
    n, room = len(costs[0]), distance + 1
    best = np.full((n, room + 1), np.inf)
    best[:, 0] = 0
    taken = np.zeros((len(costs), n, room + 1), dtype=np.int8)
    for i, cost in enumerate(costs):
        step = np.full_like(best, np.inf)
        for have in range(room + 1):
            for use in range(room + 1 - have):
                c = best[:, have] + (cost[:, use - 1] if use else 0)
                better = c < step[:, have + use]
                step[better, have + use] = c[better]
                taken[i, better, have + use] = use
        best = step
    out, left = np.zeros((n, len(costs)), dtype=np.int8), np.full(n, room)
    for i in reversed(range(len(costs))):
        out[:, i] = taken[i, np.arange(n), left]
        left = left - out[:, i]
    return out - 1


def part_histogram(classes: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """Fingerprints by the first bits of each part: parts x 4096 counts."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), 1 << BIN_BITS), dtype=np.int64)
        for batch in source:
            fps = _fps(batch)
            for i, part in enumerate(parts):
                total[i] += np.bincount(values(fps, part[:BIN_BITS]), minlength=1 << BIN_BITS)
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(total[i, b])], names=["i", "b", "n"])

    out = np.zeros((len(parts), 1 << BIN_BITS))
    for i, b, n in classes.select("fp").mapInArrow(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n")).collect():
        out[i, b] = n
    return out


def close_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): of all fingerprints that are at most one bit from a number, the least and the greatest. They differ in two bits at most."""
    around = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    ends = classes.select("fp", around.alias("z")).groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    return ends.where("a <> b").select("a", "b").distinct()


def find_links(classes: DataFrame, distance: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b), a < b: fingerprints of different roots that differ in at most `distance` bits.

    classes: fp, distinct, and root, that of a component found so far; without it each fingerprint is its own root.
    """
    n = classes.count()
    cuts = group_bits(bit_pairs(classes), n, parts or choose_parts(n, distance))
    seen = part_histogram(classes, cuts)
    tables = [[masks(len(part), t) for t in range(distance + 1)] for part in cuts]

    def index(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fps = _fps(batch)
            for i, part in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(values(fps, part) | i << 40), pa.array(fps.view(np.int64)), batch.column(1)], names=["part", "x", "rx"])

    def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fps, roots = _fps(batch), batch.column(1).to_numpy(zero_copy_only=False)
            vals = [values(fps, part) for part in cuts]
            near = [seen[i][v & ((1 << BIN_BITS) - 1)] / 2 ** max(0, len(cuts[i]) - BIN_BITS) for i, v in enumerate(vals)]
            costs = [np.stack([probes(len(part), t) * (1 + near[i]) for t in range(distance + 1)], axis=1) for i, part in enumerate(cuts)]
            allowed = thresholds(costs, distance)
            for i, v in enumerate(vals):
                for t in range(distance + 1):
                    rows, around = np.flatnonzero(allowed[:, i] == t), tables[i][t]
                    step = max(1, BATCH // len(around))
                    for lo in range(0, len(rows), step):
                        r = rows[lo : lo + step]
                        key = (v[r][:, None] ^ around[None, :]).ravel() | i << 40
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.repeat(c[r], len(around))) for c in (fps.view(np.int64), roots))], names=["part", "q", "rq"])

    rooted = "root" in classes.columns
    rows = classes.select("fp", F.col("root" if rooted else "fp").alias("root"))
    there = rows.mapInArrow(index, "part long, x long, rx long")
    asked = rows.mapInArrow(probe, "part long, q long, rq long")
    if rooted:  # a part value of one component alone links nothing
        both = there.select("part", F.col("rx").alias("r")).unionByName(asked.select("part", F.col("rq").alias("r")))
        split = cut(both.groupBy("part").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("part"))
        there, asked = cut(there.join(split, "part", "left_semi")), cut(asked.join(split, "part", "left_semi"))
    apart = (F.col("rq") != F.col("rx")) & (F.col("q") < F.col("x"))
    met = asked.join(there, (asked["part"] == there["part"]) & apart & (F.bit_count(F.col("q").bitwiseXOR(F.col("x"))) <= distance))
    return met.select(F.col("q").alias("a"), F.col("x").alias("b")).distinct()


def component_roots(classes: DataFrame, distance: int = 3, parts: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(fp, root) for each of `classes` (fp, distinct): the component of links at `distance` or fewer bits, and of those `known` (a, b).

    What joins dense groups before the links are looked for are the known links, or else the close pairs.
    """
    member = cut(classes.select("fp", F.col("fp").alias("root")))
    if known is not None or distance >= 2:
        member = merge_roots(member, close_pairs(member) if known is None else known, "fp")
    return merge_roots(member, find_links(member, distance, parts), "fp")


def member_rows(rows: DataFrame, classes: DataFrame, member: DataFrame) -> DataFrame:
    """`rows` with the component of their fingerprint, by its smallest id, and the key of the row that stays."""
    known = classes.join(member, "fp")
    leaders = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(leaders, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("keep"))
    return rows.join(known, "fp").select("doc_id", "key", "fp", "component_id", "keep")


def classes_of(rows: DataFrame) -> DataFrame:
    """(fp, first) for each fingerprint of `rows` (doc_id, key, fp); first: its row of the smallest id, null ids last."""
    return cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, key (`row_key`), fp (long), component_id, keep (key of the row that stays).

    Equal fingerprints are one class, so copies are never paired; classes link at `distance` or fewer bits and are
    joined to components. component_id is the smallest id in the component; null ids count as the largest. Texts
    without words have fingerprint zero, which is linked like any other. Repeated rows share key, fingerprint and
    component. Long texts are read whole. The table may be empty; its other columns don't matter.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), fingerprint(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")))
    classes = classes_of(rows)
    return member_rows(rows, classes, component_roots(classes, distance))


def rows_that_stay(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose key is a `keep` of `found`, of repeated rows one; columns and their names unchanged."""
    stay = found.select(F.col("keep").alias("key")).distinct()
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rec")).join(stay, "key", "left_semi")
    once = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.withColumn("once", once).where("once = 1").select("rec.*")


def keep_one(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the one of the smallest id (of repeated rows one), columns unchanged.

    Nulls, empty texts, ties, repeated rows and empty tables are as in `near_duplicates`.
    """
    return rows_that_stay(docs, near_duplicates(docs, distance, id_col, text_col), id_col, text_col)
