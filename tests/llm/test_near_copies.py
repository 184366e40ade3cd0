"""Near copies against brute force over all pairs, at every distance of their fingerprints."""

import random

import pytest

from hunksieve.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def brute(docs, least=0.8, distance=3):
    sets, fps = [set(near_copies.shingle_set(t, 5).tolist()) for _, t in docs], [simhash.fingerprint_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i in range(len(docs)):
        for j in range(i):
            bits, alike = bin(fps[i] ^ fps[j]).count("1"), len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least
            far += alike and bits > 5
            if bits <= distance or alike:
                root[find(i)] = find(j)
    least_id = {}
    for i, (d, _) in enumerate(docs):
        least_id[find(i)] = min(d, least_id.get(find(i), d))
    return {d: least_id[find(i)] for i, (d, _) in enumerate(docs)}, far


def test_near_copies(spark):
    rng = random.Random(11)
    docs = []

    def add(words):
        docs.append((len(docs) * 2, " ".join(words)))

    for _ in range(60):  # lone pairs around the limit
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 300]))]
        add(words)
        for _ in range(max(1, len(words) * rng.choice([1, 2, 3]) // 150)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        add(words)
    base = [f"b{i}" for i in range(150)]
    for _ in range(60):  # a group whose members are linked in part
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            words[rng.randrange(150)] = f"m{rng.randrange(10**6)}"
        add(words)
    docs.extend([(1001, ""), (1003, "one"), (1005, "ONE"), (1007, docs[0][1])])
    want, far = brute(docs)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(docs, DOCS).repartition(5)).collect()}
    assert far > 20 and got == want
    frame = spark.createDataFrame(docs, DOCS)
    kept = pytest.importorskip("corpus_pipeline").drop_near_duplicates(spark, frame, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert near_copies.keep_one(frame.limit(0)).count() == 0
