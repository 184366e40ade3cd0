"""Periodic runs against all periods of all texts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from hunksieve.llm import periodic_runs
from hunksieve.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def all_runs(w, least):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {p for s, n, q in runs for p in range(s + q, s + n)}
    return [x for p, x in enumerate(w) if p not in gone]


@pytest.mark.parametrize(("tree", "step"), [(periodic_runs.TREE, periodic_runs.STEP), (10, 7)])
def test_batches(tree, step, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TREE", tree)
    monkeypatch.setattr(periodic_runs, "STEP", step)
    rng = random.Random(1)
    for _ in range(400):
        docs = [[rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 3, 12, 30, 90]))] * rng.choice([1, 1, 3]) for _ in range(rng.choice([0, 1, 9]))]
        offsets, least = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64), rng.choice([2, 5, 12])
        got = periodic_runs.runs_of_batch(np.array(sum(docs, []), dtype=np.int64), offsets, least)
        want = [[i, *r] for i, d in enumerate(docs) for r in all_runs(d, least)]
        assert got.tolist() == want
        parts = periodic_runs.kept_parts(got, offsets).tolist()
        for i, d in enumerate(docs):
            assert [d[p] for j, s, n in parts if j == i for p in range(s, s + n)] == kept(d, [r[1:] for r in want if r[0] == i])


def test_find_runs(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["a", "b", "Ä ö"], k=rng.choice([1, 5, 40, 90]))), "x") for i in range(60)]
    docs += [(100, None, "x"), (101, "", "x"), (102, "\t \n", "x"), (103, "w " * 30000, "x"), (None, " ".join("pqr" * 9), None), docs[0], docs[0]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, row string").withColumnsRenamed({"row": "row"}).selectExpr("*", "1 AS runs", "row AS found", "text AS parts")
    out = periodic_runs.find_runs(frame)
    assert out.columns == ["doc_id", "text", "row", "found", "parts", "words", "n_words", "runs", "kept"]
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), tuple(r.kept)) for r in out.collect())
    want = Counter()
    for d, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = all_runs(w, 12)
        want[d, len(w), tuple(runs), tuple(kept(w, runs))] += 1
    assert got == want and periodic_runs.find_runs(frame.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_query(spark):
    want = set()
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = all_runs(w, 12)
        s, length, q = min(((s, length, q) for s, length, q in runs), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.add((d, len(runs), s, length, q, length and 1000 * length // q, sha(lines), sha(" ".join(kept(w, runs)))))
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()]
    assert set(got) == want and len(got) == len(want)
    assert any(r[1] for r in got)
