"""SimHash links, components and repeated passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from hunksieve.llm import simhash, substring_dedup
from hunksieve.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, kept string"


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(5001, 5100)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len({x for e in edges for x in e if e[0] != e[1]})
    assert all(r.root == root(r.node) for r in out)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_docs():
    rng = random.Random(7)
    vocab = ["The", "of", "é", "x1", "word", "Other", "long", "thing", "\xa0", "más"]
    base = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 30, 300]))) for _ in range(40)]
    docs = []
    for i in range(150):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, rng.choice([" ", "\n", " \x0b "]).join(words), "en", None))
    return docs + [(900, None, None, None), (901, "", "", ""), (None, "no id here", "", ""), docs[3], docs[3], (902, "Word " * 9000, "", "")]


def test_near_duplicates(spark):
    docs = near_docs()
    frame = spark.createDataFrame(docs, DOCS)
    fps = [brute_fp(t) for _, t, *_ in docs]
    near = [[bin(a ^ b).count("1") <= 3 for b in fps] for a in fps]
    group = list(range(len(docs)))
    for _ in range(12):
        for i, row in enumerate(near):  # settles long before
            group[i] = min(group[j] for j, x in enumerate(row) if x)
    least = {}
    for (d, *_), g in zip(docs, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    out = simhash.near_duplicates(frame).collect()
    want = Counter((d, f, least.get(g)) for (d, *_), f, g in zip(docs, fps, group, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out) == want
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(g) for g in set(group))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_links_for_each_number_of_parts(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3}
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for parts in (2, 3, 4):
        got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.find_links(frame, 3, parts).collect()}
        assert got == want, parts
    assert simhash.choose_parts(1000, 3) in (2, 3, 4)
    t = simhash.thresholds([np.array([[1, 5, 50, 500]]), np.array([[90, 100, 200, 900]])], 3)
    assert t.tolist() == [[2, 0]] or t.sum() == 2


def brute_repeats(docs, width):
    seen, out = set(), []
    for d, t in sorted({(d, t) for d, t, *_ in docs}, key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            win = tuple(w[i : i + width])
            if win in seen:
                gone.update(range(i, i + width))
            seen.add(win)
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "the", "the", "a", "\xa0x"]
    shared = [" ".join(rng.choices(vocab, k=rng.choice([19, 20, 21, 45, 80]))) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 40]))) for _ in range(3)]
        for k in range(rng.choice([0, 1, 2, 3])):
            parts.insert(k, rng.choice(shared))
        docs.append((i, rng.choice([" ", "\n"]).join(parts), "en", "k"))
    docs += [(500, "a " * 130, "", ""), (501, "a b " * 90, "", ""), (502, "a b c d e f g " * 20, "", ""), (503, None, None, None), (504, "", "", ""), (505, docs[9][1], "", "")]
    return docs


def test_repeats(spark):
    for seed in (1, 2):
        docs = passages(seed)
        rng = random.Random(seed)
        frame = spark.createDataFrame(rng.sample(docs, len(docs)), DOCS).repartition(6)
        for width in (20, 8):
            out = substring_dedup.remove_repeats(frame, width)
            got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect())
            assert got == sorted(brute_repeats(docs, width)), (seed, width)


def test_repeats_with_repeated_rows(spark):
    docs = passages(3)
    more = [*docs, docs[4], docs[4], docs[505 - 505]]
    want = {d: x for d, *x in brute_repeats(docs, 20)}
    out = substring_dedup.remove_repeats(spark.createDataFrame(more, DOCS)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in more)
    assert all([r.n_words, r.n_removed, r.kept] == want[r.doc_id] for r in out)
    null_id = spark.createDataFrame([(None, "q " + "z y x w v " * 5, "", ""), (1, "z y x w v " * 5, "", "")], DOCS)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(null_id).collect()}[1] == 25
    texts = substring_dedup.dedup_texts(spark.createDataFrame(docs, DOCS))
    assert texts.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id: r.text for r in texts.collect()} == {d: (want[d][2] if want[d][1] else t) for d, t, *_ in docs}
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
