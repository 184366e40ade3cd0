"""Columns of the registered queries without SQL, against brute force over the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hunksieve.llm import langid, sharding
from hunksieve.llm.queries import QUERIES

from .test_dedup import brute_fp

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall())


def rows(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def test_op1(spark, docs):
    out = rows(spark, "op1_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs.items()}
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None} and len(out) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op1_does_not_depend_on_arrival(spark, tmp_path):
    spark.range(500).selectExpr("id doc_id", "repeat(string(id), 20) text").write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    first = sharding.shuffle_into_shards(frame, 5).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = sharding.shuffle_into_shards(frame, 5).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert Counter(first) == Counter(again)


def test_op4(spark, docs):
    ids, out = list(docs), {r.doc_id: r for r in rows(spark, "op4_fingerprints")}
    names = defaultdict(set)
    for i, d in enumerate(ids):
        own, other = docs[d] or "", docs[ids[(i + 1) % len(ids)]] or ""
        n = len(own) // 4
        assert out[d].n_chars == len(own)
        assert out[d].edited_sha256 == hashlib.sha256((own[: len(own) - n] + other[:n]).encode()).hexdigest()
        assert out[d].near_next == float(out[d].fingerprint == out[ids[(i + 1) % len(ids)]].fingerprint)
        assert out[d].near_edited == float(out[d].fingerprint == out[d].edited_fingerprint)
        names[own].add(out[d].fingerprint)
    assert len(out) == len(docs) and all(len(x) == 1 for x in names.values())


def test_op5(spark, docs):
    fps = {d: brute_fp(t) for d, t in docs.items()}
    group = {d: d for d in docs}
    for _ in range(8):
        for a in docs:
            group[a] = min(group[b] for b in docs if bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")} == {d: (f"{fps[d]:016x}", group[d]) for d in docs}


def test_op6(spark, docs):
    out = {r.doc_id: r for r in rows(spark, "op6_language_id")}
    told = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_DIR}/documents.parquet'").fetchall())
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    counts = defaultdict(Counter)
    for d, t in docs.items():  # fewer than the bound of the training sample, so all of them count
        if told[d] is not None and t is not None and not held(d):
            counts[told[d]].update(grams_of(t))
    ranks = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[: langid.RANKS])} for lang, c in counts.items()}
    for d, t in docs.items():
        top = [g for g, _ in sorted(Counter(grams_of(t or "")).items(), key=lambda x: (-x[1], code(x[0])))[: langid.RANKS]]
        far = {lang: sum(abs(i - r[g]) if g in r else langid.RANKS for i, g in enumerate(top)) for lang, r in ranks.items()}
        best = min(sorted(far), key=far.get) if top else "und"
        assert out[d].held_out == held(d) and out[d].lang_pred == best
        assert abs(out[d].score - (1 - far[best] / (langid.RANKS * len(top)) if top else 0)) < 1e-9


def grams_of(text):
    """Runs of letters with one space around each; n-grams of one to three that neither are nor hold a space in the middle."""
    out, words = [], re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    for n in (1, 2, 3) if words else ():
        padded = f" {words} "
        out += [g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if (n == 1 and g != " ") or n == 2 or (n == 3 and g[1] != " ")]
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def test_und(spark):
    frame = spark.createDataFrame([(1, "½ ² ①", "k"), (2, "12 !", "k"), (3, None, "k"), (4, "the", "k")], "doc_id long, text string, _lang string")
    learned = langid.train(spark.createDataFrame([(i, "the of and", "aa") for i in range(9)], "doc_id long, text string, lang string"))
    out = langid.identify_language(frame, learned)
    assert out.columns == [*frame.columns, "lang_pred", "score"]
    assert {r.doc_id: (r.lang_pred, r._lang) for r in out.collect()} == {1: ("und", "k"), 2: ("und", "k"), 3: ("und", "k"), 4: ("aa", "k")}


def test_op7(spark, docs):
    out = rows(spark, "op7_toxicity")
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_op9(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in docs.items()}
    out = rows(spark, "op9_token_counts")
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == want and all(r.over_limit == (r.n_tokens > 1024) for r in out)


def test_op2(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs.items()}
    got, sequences = Counter(), defaultdict(list)
    for r in rows(spark, "op2_packing"):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        got.update((r.doc_id, p) for p in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == Counter((d, p) for d, own in ids.items() for p in range(len(own)))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


def test_gradient():
    """The steps of `fit` go down the risk: with one step, against differences of the risk itself."""
    import numpy as np

    from hunksieve.llm import toxicity

    rng = random.Random(4)
    x = [np.array(sorted(rng.sample(range(6), 3))) for _ in range(40)]
    positive = np.array([0 in i for i in x])

    def risk(w, b, prior=0.2):
        p = np.array([1 / (1 + np.exp(-(w[i].sum() + b))) for i in x])
        held = p[~positive].mean() - prior * p[positive].mean()
        return prior * (1 - p[positive]).mean() + max(held, 0)

    w, b = toxicity.fit(x, positive, 0.2, 6, steps=1, rate=1e-4, decay=0)
    slope = [(risk(np.eye(6)[i] * 1e-6, -1.0) - risk(np.zeros(6), -1.0)) / 1e-6 for i in range(6)]
    assert all(abs(g) < 1e-9 or np.sign(-g) == np.sign(step) for g, step in zip(slope, w, strict=True))
    assert risk(*toxicity.fit(x, positive, 0.2, 6)) < risk(np.zeros(6), -1.0) - 0.05


def test_packing_looks_up_words_without_a_walk_over_all_known():
    import time

    import public_tokenizers

    from hunksieve.llm import packing

    own = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["don't stop: they'll, I'd, we've, 'tis 's'm 12 3a1b", "", "l'ÉTÉ d'été\r\n\tx", "'''s'", "<|odd|>", "日本"] * 2
    ids = lambda: [x.tolist() for x in own.encode(texts)]
    assert ids() == [x.ids for x in own.library.encode_batch_fast(texts, add_special_tokens=False)]

    def spent():
        begin = time.process_time()
        for _ in range(40):
            ids()
        return time.process_time() - begin

    few = spent()
    own.known.update((f"w{i}", b"") for i in range(packing.REMEMBERED // 2))
    assert spent() < 3 * few + 0.2  # a walk over them takes seconds
