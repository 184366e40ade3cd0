"""Ranked lexical search by a hierarchical max tree over ranges of documents.

Documents lie in segments. In a segment each term has its largest share of a score for each range of documents: for
single ones, for 32 of them, for 32 times as many and so on; empty ranges are left out. The sum of a query's terms over a
range bounds the score of every document in it. A query opens ranges best first, until what it has is better than the
bound of all that is left; ranges whose bound equals its last place are opened too, since a tie goes to the smaller id.

Scores are whole numbers, so bounds and ties are exact. A task goes through its segments one after the other and takes
the places a query has so far with it; the places of all tasks are ranked at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .decontaminate import words

#: Ranges below one, levels of ranges above single documents, and so documents of a segment at most.
FAN, LEVELS = 32, 3
SEGMENT = FAN**LEVELS
#: Terms in documents of a segment at most, and the bytes of the queries that go through the documents at a time.
POSTINGS, QUERY_BYTES = 1_000_000, 8 << 20
#: Words that are counted in one step.
COUNTED = 1 << 18
FOUND = "query long, doc_id long, score long"


@dataclass
class Query:
    """Distinct terms of a query, by their place in the vocabulary, and how often each occurs times its weight."""

    terms: np.ndarray
    weights: np.ndarray


class Tree:
    """The max tree of a segment: for each level, from single documents up, ranges and largest shares by term.

    What lies below an entry is the stretch of the level under it that `below` tells.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, shares: np.ndarray, n_terms: int):
        order = np.lexsort((docs, terms))
        term, at, share = terms[order], docs[order], shares[order]
        self.ranges, self.shares, self.below = [at], [share], [None]
        for _ in range(LEVELS):
            up = at // FAN
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (up[1:] != up[:-1]))[: len(term)])
            self.below.append(np.append(first, len(term)))
            share = np.maximum.reduceat(share, first) if len(first) else share
            term, at = term[first], up[first]
            self.ranges.append(at)
            self.shares.append(share)
        self.root = np.full(n_terms, -1, dtype=np.int64)  # the entry of each term at the top, which is one range
        self.root[term] = np.arange(len(term))

    def search(self, query: Query, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Puts the documents that belong among the k best into `best`, a heap of (score, -id)."""
        there = np.flatnonzero(self.root[query.terms] >= 0)
        if not len(there):
            return
        entries, weights = self.root[query.terms[there]], query.weights[there]
        bound = int((self.shares[LEVELS][entries] * weights).sum())
        heap, n = [(-bound, 0, LEVELS, entries, weights)], 0
        while heap:
            bound, _, level, entries, weights = heapq.heappop(heap)
            if len(best) == k and -bound < best[0][0]:
                return
            starts, ends = self.below[level][entries], self.below[level][entries + 1]
            size = ends - starts
            inside = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
            weight = np.repeat(weights, size)
            place = self.ranges[level - 1][inside]
            order = np.argsort(place, kind="stable")
            place, inside, weight = place[order], inside[order], weight[order]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            sums = np.add.reduceat(self.shares[level - 1][inside] * weight, first)
            if level == 1:
                for score, d in zip(sums.tolist(), ids[place[first]].tolist(), strict=True):
                    if score > 0 and (len(best) < k or (score, -d) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -d))
                continue
            least = best[0][0] if len(best) == k else 1
            last = np.append(first[1:], len(place))
            for j in np.flatnonzero(sums >= least).tolist():
                n += 1
                part = slice(first[j], last[j])
                heapq.heappush(heap, (-int(sums[j]), n, level - 1, inside[part], weight[part]))


def term_counts(vocabulary: list[str]):
    """Arrow UDF: of each array of words its length, and which terms of the vocabulary it holds how often."""

    @F.arrow_udf("n bigint, terms array<int>, counts array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            sizes, terms, counts = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for flat, offsets in slices(batch, COUNTED):
                code = pc.fill_null(pc.index_in(flat.cast(pa.string()), known), -1).to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[code >= 0]
                key, n = np.unique(own * (len(vocabulary) + 1) + code[code >= 0], return_counts=True)
                own, term = np.divmod(key, len(vocabulary) + 1)
                sizes.append(np.bincount(own, minlength=len(offsets) - 1))
                terms.append(term)
                counts.append(n)
            ends = pa.array(np.append(0, np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (terms, counts)]
            yield pa.StructArray.from_arrays([pc.list_value_length(batch).cast(pa.int64()), *lists], names=["n", "terms", "counts"])

    return count


def segments(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n, place of the document, term, count) of segments, from batches of (id, n, terms, counts)."""
    held, docs, postings = [], 0, 0
    for batch in source:
        lo = 0
        while lo < batch.num_rows:
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            room = min(SEGMENT - docs, batch.num_rows - lo)
            fits = int(np.searchsorted(ends[lo + 1 : lo + room + 1] - ends[lo], POSTINGS - postings, side="right"))
            if not fits and docs:
                yield joined(held)
                held, docs, postings = [], 0, 0
                continue
            fits = max(fits, 1)
            held.append(batch.slice(lo, fits))
            docs, postings, lo = docs + fits, postings + int(ends[lo + fits] - ends[lo]), lo + fits
            if docs == SEGMENT:
                yield joined(held)
                held, docs, postings = [], 0, 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, n, terms, counts = (table.column(i).chunk(0) for i in range(4))
    sizes = np.diff(terms.offsets.to_numpy().astype(np.int64))
    whole = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), sizes), whole(terms), whole(counts)


def searcher(queries: list[Query], n_terms: int, n_docs: int, n_words: int, k: int):
    """mapInArrow function: the k best documents of each query in a partition of (id, n, terms, counts)."""

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for ids, n, doc, term, tf in segments(source):
            m = 100 - 75 + (75 * n * n_docs) // max(n_words, 1)
            tree = Tree(term, doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]), n_terms)
            for query, own in zip(queries, best, strict=True):
                tree.search(query, ids, own, k)
        rows = [(q, -d, score) for q, own in enumerate(best) for score, d in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query", "doc_id", "score"])

    return search


def query_blocks(items: DataFrame) -> list[DataFrame]:
    """The queries in blocks of about QUERY_BYTES of words, by the hash of their key; a block's queries are taken to the driver."""
    size = items.agg(F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8))).first()[0] or 0
    blocks = size // QUERY_BYTES + 1
    return [items.where(F.pmod(F.xxhash64(F.lit(3), "item"), F.lit(blocks)) == b) for b in range(blocks)]


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score for each item's text, if it is above 0.

    Terms are runs of letters, digits and all non-ASCII characters, A-Z lower-cased. N counts the documents with a term,
    L all their terms, n those of a document, tf and df a term's occurrences in a document and the documents that hold it.
    Its weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums, over the item's terms with repeats,
    weight * (10^9 tf div (1000 tf + 8 m)) with m = 25 + (75 n N) div L. Equal scores rank by ascending id.

    Null and empty texts have no terms: such documents are never found and such items find nothing. Ids of documents are whole
    numbers; a null id is taken as the smallest and comes out as null. Rows that repeat an item's id and text are one
    query, texts of one id are queries of their own. Repeated documents are all ranked. Other columns don't matter. Items go
    through the documents in blocks of bounded size, which alone are sent to tasks; documents are read whole, once a block.
    """
    spark = docs.sparkSession
    least = -(1 << 63) + 1
    every = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    every = cut(every.select("item_id", F.struct("item_id", "text").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc_id"), words(F.col(text_col)).alias("w"))
    out = None
    for block in query_blocks(every):
        told = block.select("item_id", "w").collect()  # at most QUERY_BYTES or one item
        vocabulary = sorted({w for r in told for w in r.w})
        number = {w: i for i, w in enumerate(vocabulary)}
        counted = texts.select("doc_id", term_counts(vocabulary)("w").alias("t")).select("doc_id", "t.n", "t.terms", "t.counts").where("n > 0")
        counted = cut(counted)
        n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one for each term of the block
            df[r.term] = r["count"]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        queries = []
        for r in told:
            terms, repeats = np.unique(np.array([number[w] for w in r.w], dtype=np.int64), return_counts=True)
            queries.append(Query(terms, repeats * weights[terms]))
        parts = counted.where(F.size("terms") > 0).mapInArrow(searcher(queries, len(vocabulary), n_docs, n_words, k), FOUND)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        ranked = parts.withColumn("rank", place).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(told)], f"query long, item_id {every.schema['item_id'].dataType.simpleString()}")
        found = ranked.join(F.broadcast(named), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(least)).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out
