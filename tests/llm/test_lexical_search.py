"""Ranked search against the scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hunksieve.llm import lexical_search


def terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for i, text in set(items):
        scores = []
        for (d, bag), n in zip(bags, sizes, strict=True):
            score = 0
            for w in terms(text):
                if bag[w]:
                    m = 100 - 75 + (75 * n * n_docs) // n_words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, *_, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("fan", "levels", "postings"), [(32, 3, 4_000_000), (2, 3, 40), (3, 2, 5), (2, 1, 100)])
def test_tree(fan, levels, postings, monkeypatch):
    """Segments, trees and the order of opening, in this process."""
    for name, value in {"FAN": fan, "LEVELS": levels, "SEGMENT": fan**levels, "POSTINGS": postings}.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(8)
    for _ in range(60):
        n_terms, n = rng.choice([1, 4, 9]), rng.choice([1, 7, 60])
        docs = [(rng.choice([i, i // 2]), rng.randrange(1, 9), {t: rng.choice([1, 1, 2, 7]) for t in range(n_terms) if rng.random() < 0.3}) for i in range(n)]
        batches, at = [], 0
        while at < n:
            some = docs[at : at + rng.randrange(1, 20)]
            at += len(some)
            columns = [[d for d, *_ in some], [s for _, s, _ in some], [list(b) for *_, b in some], [list(b.values()) for *_, b in some]]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=list("abcd")))
        queries = [lexical_search.Query(np.array(sorted(rng.sample(range(n_terms), rng.randrange(1, n_terms + 1)))), np.array([])) for _ in range(5)]
        queries = [lexical_search.Query(q.terms, np.array([rng.choice([0, 1, 1, 5]) for _ in q.terms])) for q in queries]
        k, words = rng.choice([1, 3, 10]), sum(s for _, s, _ in docs)
        got = Counter(tuple(r.values()) for b in lexical_search.searcher(queries, n_terms, n, words, k)(batches) for r in b.to_pylist())
        want = Counter()
        for i, q in enumerate(queries):
            weight = dict(zip(q.terms.tolist(), q.weights.tolist(), strict=True))
            scores = [(-sum(weight.get(t, 0) * ((10**9 * c) // (1000 * c + 8 * (25 + (75 * s * n) // words))) for t, c in b.items()), d) for d, s, b in docs]
            want.update((i, d, -s) for s, d in sorted(x for x in scores if x[0] < 0)[:k])
        assert got == want


@pytest.mark.parametrize("block", [60, 8 << 20])
def test_search(spark, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "42", "Ünï"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.choice([1, 2, 5, 40])), "s", "t") for i in range(150)]
    docs += [(i + 1000, "w1 w2 W3, same", "s", "t") for i in range(25)]
    docs += [(500, None, "s", "t"), (501, "", "s", "t"), (502, " - ", "s", "t"), (503, "w0 " * 9000, "s", "t"), (None, "w5 w7", None, "t"), docs[3], docs[3]]
    items = [(i, text(rng.choice([1, 3, 9]))) for i in range(12)] + [(50, "w1 w2 w3"), (51, None), (52, ""), (53, "nowhere"), (1, "w4 w4 w4"), (2, "w5"), (2, "w5")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, w string").repartition(3)
    out = lexical_search.search_documents(frame, spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert Counter(tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()) == brute([d[:2] for d in docs], items, 4)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "b c")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical_search.search_documents(docs, items).collect()] == [("q", 1, 1)]
    assert lexical_search.search_documents(docs.limit(0), items).count() == 0
    assert lexical_search.search_documents(docs, items.limit(0)).count() == 0
    assert lexical_search.search_documents(docs.selectExpr("doc_id", "'' AS text"), items).count() == 0
