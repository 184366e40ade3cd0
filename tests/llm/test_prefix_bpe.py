"""Prefix encoding against the library, edits against encoding anew."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hunksieve.llm import prefix_bpe
from hunksieve.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return prefix_bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})


def texts(n: int):
    rng = random.Random(4)
    known = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for i in range(n):
        if i % 3 == 0:
            yield "".join(rng.choices(known, k=rng.randrange(40)))
        elif i % 3 == 1:
            yield "".join(rng.choice("abeth \n\t's1é日!") for _ in range(rng.randrange(200)))
        else:
            yield "".join(rng.choice(["ab", "the", "ing", " ", "ä", "x" * 9, "<|endoftext|>"]) for _ in range(rng.randrange(99)))


def test_encoding(own, library):
    for text in texts(6000):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode_ordinary(text)


def test_every_character_is_split_as_the_library_does(own):
    for c in map(chr, range(0x110000)):
        if not "\ud800" <= c <= "\udfff" and not c.isspace():
            kind = own.splitter.kind(c)
            mine = [len(own.splitter.split(k + c)) == 1 for k in "a1!"]
            assert mine == [k == kind for k in "a1!"] or c in "'", c


def test_pairs_of_tokens(own):
    rng, v = random.Random(5), own.vocabulary
    tokens = list(v.tokens)
    common = [t for t in tokens if len(v.tokens[t]) < 4]
    for _ in range(20_000):
        a, b = rng.choice(common), rng.choice(tokens if rng.random() < 0.5 else common)
        assert v.may_follow(a, b) == (v.merged(v.tokens[a] + v.tokens[b]) == [a, b])


def test_appends_and_edits(own):
    rng, v = random.Random(6), own.vocabulary
    some = lambda n: "".join(rng.choice("abcdeth ing") for _ in range(rng.randrange(n))).encode()
    for _ in range(800):
        data, new = some(200), some(9)
        a = rng.randrange(len(data) + 1)
        b = min(len(data), a + rng.randrange(9))
        p = prefix_bpe.Prefixes(v, data)
        p.replace(a, b, new)
        after = data[:a] + new + data[b:]
        assert p.data == after and p.last == prefix_bpe.Prefixes(v, after).last and p.ids() == v.merged(after)
        p.append(new)
        assert p.last == prefix_bpe.Prefixes(v, after + new).last
    long = prefix_bpe.Prefixes(v, b"abcdefgh" * 5000)
    assert long.replace(100, 101, b"zz") < 10 * v.longest


def test_order_of_ranks(tmp_path):
    import base64

    rows = [(bytes([i]), i) for i in range(256)] + [(b"abc", 256), (b"ab", 257)]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in rows))
    with pytest.raises(ValueError, match="before its halves"):
        prefix_bpe.Vocabulary(str(tmp_path / "v")).split(256)


def test_documents(spark, library):
    docs = [(i, t, "x") for i, t in enumerate(texts(200))] + [(500, None, "x"), (501, "", "x"), (502, "x" * 300_000, None), (None, "no id", "x")]
    docs += docs[:2]
    frame = spark.createDataFrame(docs, "doc_id long, text string, ids string").withColumnsRenamed({"ids": "row"}).selectExpr("*", "1 AS n_tokens", "row AS ids")
    out = prefix_bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "row", "n_tokens", "ids"]
    rows = out.withColumn("back", prefix_bpe.decoded(out["ids"], PATH)).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in rows) == Counter((d, len(x), np.array(x, dtype="<u4").tobytes()) for d, t, _ in docs for x in [library.encode_ordinary(t or "")])
    assert all(bytes(r.back).decode() == (r.text or "") for r in rows)
    assert prefix_bpe.encode_documents(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_query(spark, library):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    want = set()
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op12_byte_bpe"](spark, SF_DIR).collect()]
    assert set(got) == want and len(got) == len(docs)


def test_ids_and_their_bytes_come_from_one_worker(spark, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "SLICE", 3)
    texts = ["", None, "one two", "é😀͸ don't", "a" * 300, "x\n\ny", "1234"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = prefix_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, decode=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r.doc_id: r for r in out.collect()}
    plain = {r.doc_id: bytes(r.ids) for r in prefix_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    assert {i: bytes(r.decoded).decode() for i, r in rows.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert {i: bytes(r.ids) for i, r in rows.items()} == plain and all(4 * r.n_tokens == len(r.ids) for r in rows.values())
