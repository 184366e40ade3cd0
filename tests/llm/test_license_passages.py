"""Licence passages against brute force over all spans, and in wrapped, embedded and whole texts."""

import random
import textwrap

import pytest

from hunksieve.llm import license_passages
from hunksieve.llm.licenses import TEMPLATES

DOCS = "doc_id long, text string"
PROSE = "The river was high that spring and nobody in the village could remember such rain. " * 20


def brute(text, rows):
    words = license_passages.words_of(text or "")
    pairs, found = list(zip(words, words[1:], strict=False)), []
    for t, (name, template) in enumerate(rows):
        w = license_passages.words_of(template)
        own, best = set(zip(w, w[1:], strict=False)), None
        for i in range(len(pairs)):
            a = set()
            for j in range(i, len(pairs)):
                a.add(pairs[j])
                dice = 2.0 * len(a & own) / (len(a) + len(own))
                if dice >= 0.8 and (best is None or (-dice, j - i, i) < best):
                    best = (-dice, j - i, i)
        if best:
            found.append((best[0], t, best[1], best[2], name))
    if not found:
        return (None, None, None, None, "")
    less, _, n, i, name = min(found)
    return name, -less, i, n + 2, ",".join(sorted({f[4] for f in found}))


def test_against_all_spans(spark):
    rng = random.Random(5)
    rows = [r for r in TEMPLATES if len(r[1]) < 100] + [("twice", "a b a b a c a b d a b")]
    docs = [(0, None), (1, ""), (2, "license " * 60), (3, "a b a b a c a b d a b a b a b c a b"), (4, "license")]
    for i in range(5, 45):
        words = rng.choices(["a", "b", "c", "under", "the", "license"], k=rng.randrange(12))
        for _ in range(rng.choice([1, 1, 2])):
            put = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 2])):
                put.insert(rng.randrange(len(put) + 1), rng.choice(["the", "License", "a"]))
            at = rng.randrange(len(words) + 1)
            words[at:at] = put
        docs.append((i, "".join(w + rng.choice([" ", "\n", "\n * "]) for w in words)))
    out = license_passages.find_passages(spark.createDataFrame([*docs, docs[7]], DOCS), rows).collect()
    assert len(out) == len(docs) + 1
    for r in out:
        assert (r.license, r.dice, r.word, r.n_words, r.licenses) == brute(dict(docs)[r.doc_id], rows), r.doc_id


def test_wrapped_embedded_and_whole(spark):
    notices = [("GPL-2.0", TEMPLATES[7][1]), ("GPL-3.0", TEMPLATES[6][1]), ("BSD", TEMPLATES[8][1]), ("ISC", TEMPLATES[10][1])]
    docs, want = [], {}
    for n, (name, text) in enumerate(notices):
        lines = textwrap.wrap(text, 60)
        for i, t in ((n, "\n".join(lines)), (100 + n, f"{PROSE}\n/*\n * {chr(10).join(' * ' + x for x in lines)}\n */\n{PROSE}"), (200 + n, f"{PROSE}{text} {PROSE}")):
            docs.append((i, t))
            want[i] = name
    for n, (name, text) in enumerate(license_passages.whole_texts()):
        docs.append((300 + n, f"{name}\n\nCopyright (c) 2020 Somebody\n\n{text}\n"))
        docs.append((400 + n, f"{PROSE}\n{textwrap.fill(text, 50)}\n{PROSE}"))
        want[300 + n] = want[400 + n] = name
    docs.append((500, PROSE))
    out = {r.doc_id: r for r in license_passages.find_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert {i: r.license for i, r in out.items()} == want | {500: None}
    assert all(r.dice == pytest.approx(1) for i, r in out.items() if i != 500)
    assert len(license_passages.whole_texts()) == 17


def test_query(spark):
    from hunksieve.llm.queries import QUERIES

    found = QUERIES["op8_license_passages"](spark, "/root/testdata/sf0.001")
    old = {r.doc_id for r in QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.001").where("license is not null").collect()}
    assert old and old <= {r.doc_id for r in found.where("license is not null").collect()}
