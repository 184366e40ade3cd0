"""Sharding, packing, token counts and decontamination against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hunksieve.llm import decontaminate, packing, sharding, tokencount

DOCS = "doc_id long, text string, lang string, shard string"


def rows(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["the", "Of", "naïve", "Straße", "x", "don't", "42", "<|endoftext|>", "😀", "日本", "e" * 40, "İ", "á"]
    out = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 20, 200]))), "en", "s") for i in range(n)]
    out += [(n, None, None, None), (n + 1, "", "en", None), (n + 2, "word " * 6000, "en", None), (None, "no id", "en", None)]
    return out + out[:3]


@pytest.mark.parametrize("fan_out", [1 << 15, 10])
def test_shards(spark, tmp_path, fan_out):
    data = rows(300)
    spark.createDataFrame(data, DOCS).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = sharding.shuffle_into_shards(docs, shards=7, fan_out=fan_out).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(x[:2] for x in data)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order != sorted(order)
    assert sharding.shuffle_into_shards(docs, shards=7, fan_out=fan_out).collect() == out
    assert sharding.shuffle_into_shards(docs.limit(0), fan_out=fan_out).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    data = rows(300)
    tok = Tokenizer.from_file(path)
    out = tokencount.count_tokens(spark.createDataFrame(data, DOCS), path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in data)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    data = rows(300)
    tok = Tokenizer.from_file(path)
    out = packing.pack_documents(spark.createDataFrame(data, DOCS).repartition(40), path, size=256, open_windows=4).collect()
    want = Counter((d, bytes(b"".join(i.to_bytes(4, "little") for i in [*tok.encode(t or "", add_special_tokens=False).ids, 2]))) for d, t, *_ in data)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    assert sum(r.length for r in out) == sum(len(b) // 4 * n for (_, b), n in want.items())
    unique = {d for (d, _), n in want.items() if n == 1 and sum(x[0] == d for x in data) == 1}
    for (d, _), ps in pieces.items():
        if d in unique:
            assert want[d, b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))] == 1
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in out) / (256 * len(windows)) > 0.9
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


def brute(docs, items, width=13):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = []
    for d, t, *_ in docs:
        w, hit, found = split(t), set(), set()
        for i, text in items:
            x = split(text)
            n = min(len(x), width)
            for win in {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == win:
                        hit.update(range(s, s + n))
                        found.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)  # 0: joined by shuffles, frequent words salted
    rng = random.Random(3)
    vocab = ["a", "B", "c", "été", "7", "rare", "the"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 12, 13, 15, 30])))) for i in range(12)] + [(None, "Rare, the; c"), (99, None), (5, "a a a a a a a a a a a a a a a")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(vocab + ["zz"], k=rng.choice([0, 1, 5, 60])))
        if rng.random() < 0.4:
            text += " " + (rng.choice(items)[1] or "") + " " + "zz " * rng.choice([0, 3, 900])
        docs.append((i, text, "en", "s"))
    docs += [(500, None, None, None), (501, "", "", ""), (502, "a " * 5000, "", ""), (None, "rare the c", "", ""), docs[0]]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(frame, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out) == Counter(brute(docs, items))
    clean = decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, *_, dirty in brute(docs, items) if not dirty)
    names = {"_bad": "lang", "key": "shard", "row": "doc_id", "w": "text"}
    clashing = decontaminate.drop_contaminated(frame.select("doc_id", "text", *(F.col(c).alias(n) for n, c in names.items())), bench)
    assert clashing.columns == ["doc_id", "text", *names] and clashing.count() == clean.count()
    assert decontaminate.find_contamination(frame, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(frame.limit(0), bench).count() == 0
