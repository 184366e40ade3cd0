"""Rules in tables: what is looked for in lines, and how often."""

import numpy as np
import pyarrow as pa

from hunksieve.operators import packs
from hunksieve.schemas import LINES

TEXTS = ["abc", "the sea", "abcabcabcabcabcd", "sand", "ñaé", "bca", "the seaside of"]
ROWS = ["abcabcabcabcabcabcd the seaside of", "", None, "ab", "cabc", "the seä sa", "nd ñaé sand", "x" * 50 + "abc" * 40, "the sea"]


def test_texts_are_found_whole(monkeypatch):
    codes = [int(packs.trigrams(np.frombuffer(t.encode(), dtype=np.uint8))[-1]) for t in TEXTS]
    want = [[i for i, t in enumerate(TEXTS) if t in (row or "")] for row in ROWS]
    for size, pairs in ((1 << 20, 1 << 19), (1, 1), (40, 3)):
        monkeypatch.setattr(packs, "SLICE", size)
        monkeypatch.setattr(packs, "PAIRS", pairs)
        known = packs.Texts([t.encode() for t in TEXTS], codes)
        for lines in (pa.array(ROWS, pa.string()), pa.array(["abc", *ROWS], pa.string())[1:]):
            keys = [known.within(offsets, data) + first * len(TEXTS) for first, offsets, data in packs.slices(lines)]
            assert packs.lists(keys, len(lines), len(TEXTS)).to_pylist() == want


def test_lines_meet_only_patterns_whose_text_they_hold(spark, monkeypatch):
    """Trigrams are counted once over the lines, and the events are those of the join by trigram."""
    rows = [("d", i, "a.rs", i + 1, f"word{i % 7}ing the seaside", "added") for i in range(50)]
    lines = spark.createDataFrame(rows, LINES)
    pack = spark.createDataFrame([(f"r{i}", "info", [f"word{i}[a-z]"] + ["sea[a-z]+"] * (i == 3)) for i in range(9)], "id string, severity string, patterns array<string>")
    seen, counting = spark.sparkContext.accumulator(0), packs.counting

    def watched(bits):
        def count(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return counting(bits)(each())

        return count

    monkeypatch.setattr(packs, "counting", watched)
    key = lambda df: sorted((r["at"], r["rule_id"], r["match_text"], r["start"], r["suppressed"]) for r in df.collect())
    sole = packs.find_in_pack(lines, pack.where("size(patterns) = 1"))
    want = sorted((i, f"r{i % 7}", f"word{i % 7}i", 0, False) for i in range(50) if i % 7 != 3)
    assert key(sole) == want
    assert seen.value == 50
    both = [key(packs.find_in_pack(lines, pack, sent=sent)) for sent in (packs.SENT, 0)]
    assert both[0] == both[1]
    found = {(at, rule): text for at, rule, text, *_ in both[0]}
    assert all(found[i, "r3"] == ("word3i" if i % 7 == 3 else "seaside") for i in range(50))
    assert {rule for _, rule in found} == {f"r{i}" for i in range(7)}
