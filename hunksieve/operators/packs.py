"""Packs of any number of rules, held in a table, against all lines.

A pattern that can't match without some text is looked up by one trigram of it, the one that is rarest in the lines. Where
a line has the trigram, the whole text is compared at that place, so a line is copied only for the patterns whose text it
holds; those are tested in full. So the time hardly depends on how many rules there are, but on how many come close. Of
more than SENT bytes of patterns a line meets those of the trigrams that it has. Patterns without such a text are tested
on every line, in bounded blocks.

Trigrams are of UTF-8 bytes, so sets of them are bit sets of fixed size: 2 MB, which passes the driver beside SENT bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIRECTIVE
from ..functions.patterns import FLAGS, java_pattern, required_text
from ..functions.sets import may_be_in
from .evaluate import held, suppressions
from .rules import RuleError

TRIGRAMS = 1 << 24
#: Bytes of patterns that are sent to all tasks at a time.
SENT = 8 << 20
LINE = ("diff_id", "path", "at", "line", "content")


def trigrams(data: np.ndarray) -> np.ndarray:
    """The number of the trigram that begins at each byte but the last two."""
    wide = data.astype(np.int32)
    return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]


def compiler():
    """Pandas UDF: a rule pattern in Java's dialect, the text that its matches hold, and the trigrams of that."""

    @F.pandas_udf("java string, needed string, codes array<int>")
    def compiled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for patterns in batches:
            out = []
            for p in patterns:
                needed = required_text(p)[0]
                out.append((FLAGS + java_pattern(p), needed, np.unique(trigrams(np.frombuffer(needed.encode(), dtype=np.uint8)))))
            yield pd.DataFrame(out, columns=["java", "needed", "codes"])

    return compiled


#: Bytes of lines that are looked through at a time, and pairs of a place and a text that are compared at a time.
SLICE, PAIRS = 1 << 20, 1 << 19


def slices(lines: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some lines after another, about SLICE bytes at a time: the first one's number, where each begins and ends, and the bytes."""
    lines = lines.fill_null("")
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(lines):
        b = max(int(np.searchsorted(offsets, int(offsets[a]) + SLICE, side="right")) - 1, a + 1)
        yield a, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def found_in(offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the wanted trigrams in lines."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(wanted[trigrams(data)])
    line = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 2 < offsets[line + 1]
    return line[inside], at[inside]


def bits_of(codes: np.ndarray | list[int]) -> bytes:
    """Trigrams as a bit set, one bit for each of all trigrams."""
    bits = np.zeros(TRIGRAMS, dtype=bool)
    bits[codes] = True
    return np.packbits(bits).tobytes()


def bit_set(codes: DataFrame) -> bytes:
    return bits_of([r[0] for r in codes.distinct().toLocalIterator()])


def of_bits(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


def lists(keys: list[np.ndarray], lines: int, width: int) -> pa.ListArray:
    """What each line has, from numbers line * width + what, each once."""
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    ends = np.append(0, np.cumsum(np.bincount(key // width, minlength=lines)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key % width, pa.int32()))


def held_by(bits: bytes):
    """Arrow UDF: the trigrams of a set that each line holds."""

    @F.arrow_udf("array<int>")
    def hold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = of_bits(bits)
        for batch in batches:
            keys = []
            for first, offsets, data in slices(batch):
                line, at = found_in(offsets, data, wanted)
                keys.append(np.unique(((line + first) * TRIGRAMS) + (trigrams(data)[at] if len(at) else at)))
            yield lists(keys, len(batch), TRIGRAMS)

    return hold


def padded(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as one number; zeros follow the last."""
    wide = np.append(np.frombuffer(data, dtype=np.uint8), np.zeros(8, dtype=np.uint8))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[: len(wide) - 8]).view("<u8").ravel()


class Texts:
    """Texts that are looked for in lines, each by one of its trigrams."""

    def __init__(self, texts: list[bytes], codes: list[int]):
        order = np.argsort(np.array(codes, dtype=np.int64), kind="stable")
        self.number = order
        self.codes, self.first, self.count = np.unique(np.array(codes, dtype=np.int64)[order], return_index=True, return_counts=True)
        own = [texts[i] for i in order]
        self.size = np.array([len(t) for t in own], dtype=np.int64)
        self.begin = np.append(0, np.cumsum(self.size))[:-1]
        self.word = padded(b"".join(own))
        self.ahead = np.array([t.index(int(codes[i]).to_bytes(3, "big")) for i, t in zip(order, own, strict=True)], dtype=np.int64)
        self.wanted = of_bits(bits_of(self.codes))
        self.mask = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

    def within(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """line * (number of texts) + text for each text that a line holds, in order, each once."""
        line, at = found_in(offsets, data, self.wanted)
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        group = np.searchsorted(self.codes, trigrams(data)[at])
        word, size, out = padded(data), self.count[group], []
        ends = np.cumsum(size)
        a = 0
        while a < len(at):  # a place alone may have more than PAIRS texts
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")), a + 1)
            n = size[a:b]
            which = np.repeat(np.arange(a, b), n)
            text = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[group[which]]
            start = at[which] - self.ahead[text]
            fits = np.flatnonzero((start >= offsets[line[which]]) & (start + self.size[text] <= offsets[line[which] + 1]))
            which, text, start = which[fits], text[fits], start[fits]
            done = 0
            while len(text):  # eight bytes at a time
                left = self.size[text] - done
                mask = self.mask[np.minimum(left, 8)]
                same = ((word[start + done] ^ self.word[self.begin[text] + done]) & mask) == 0
                whole = same & (left <= 8)
                out.append(np.unique(line[which[whole]] * len(self.number) + self.number[text[whole]]))
                on = same & (left > 8)
                which, text, start = which[on], text[on], start[on]
                done += 8
            a = b
        return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def holding(texts: list[bytes], codes: list[int]):
    """Arrow UDF: the numbers of the texts that each line holds. Each text is looked up by its trigram in `codes`."""

    @F.arrow_udf("array<int>")
    def hold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Texts(texts, codes)
        for batch in batches:
            keys = [known.within(offsets, data) + first * len(texts) for first, offsets, data in slices(batch)]
            yield lists(keys, len(batch), len(texts))

    return hold


def counting(bits: bytes):
    """mapInArrow function over one column of text: how often the trigrams of a set stand in it."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = of_bits(bits)
        known = np.flatnonzero(wanted)
        total = np.zeros(len(known), dtype=np.int64)
        for batch in source:
            for _, offsets, data in slices(batch.column(0)):
                at = found_in(offsets, data, wanted)[1]
                if len(at):
                    total += np.bincount(np.searchsorted(known, trigrams(data)[at]), minlength=len(known))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[met], pa.int32()), pa.array(total[met], pa.int64())], names=["code", "n"])

    return count


def size_of(patterns: DataFrame) -> int:
    return patterns.agg(F.sum(F.octet_length("java") + F.octet_length("needed") + 64)).first()[0] or 0


def matches(text: Column, p: Column) -> Column:
    return F.contains(text, p["needed"]) & F.rlike(text, p["java"])


def find_in_pack(lines: DataFrame, rules: DataFrame, language: str | None = None, sent: int = SENT) -> DataFrame:
    """The events of find_events, without rule_idx, for rules that are rows: id, severity, patterns (an array).

    One event for a rule and line, at the leftmost match of the first of its patterns that matches. A rule's other fields
    don't count here. Ids are unique. Null lines match nothing but are no error; a rule without patterns has no events. A
    pattern that can't be used stops the job. Of patterns with a text that they can't do without up to `sent` bytes go to all
    tasks, more are joined by trigram.
    """
    patterns = rules.select(F.col("id").alias("rule_id"), "severity", (F.size("patterns") > 1).alias("several"), F.posexplode("patterns").alias("n", "pattern"))
    patterns = patterns.select("rule_id", "severity", "several", "n", compiler()("pattern").alias("c")).select("rule_id", "severity", "several", "n", "c.*")
    rows = lines.where("content is not null").select("diff_id", "path", F.col("idx").alias("at"), "line", "content")

    # The rarest of each pattern's trigrams in the lines, worked out once.
    every = patterns.select("rule_id", "n", F.explode("codes").alias("code"))
    counts = rows.select("content").mapInArrow(counting(bit_set(every.select("code"))), "code int, n long").groupBy("code").agg(F.sum("n").alias("times"))
    rarest = every.join(counts, "code", "left").groupBy("rule_id", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "code")).alias("least"))
    index = held(patterns.join(rarest.where("least.times > 0"), ["rule_id", "n"]).withColumn("code", F.col("least.code")).drop("codes", "least"))
    if size_of(index) <= sent:
        # Lines meet just the patterns whose text they hold.
        known = index.collect()
        numbered = lines.sparkSession.createDataFrame([(k, r.rule_id, r.severity, r.several, r.n, r.java) for k, r in enumerate(known)], "k int, rule_id string, severity string, several boolean, n int, java string")
        texts = holding([r.needed.encode() for r in known], [r.code for r in known])
        met = rows.withColumn("k", F.explode(texts("content"))).join(F.broadcast(numbered), "k")
    else:
        probed = rows.withColumn("code", F.explode(held_by(bit_set(index.select("code")))("content")))
        met = probed.join(index, "code").where(F.contains("content", F.col("needed")))
    found = [met.where(F.rlike(F.col("content"), F.col("java"))).select(*LINE, "rule_id", "severity", "several", "n", "java")]

    broad = patterns.where(F.size("codes") == 0)
    size = size_of(broad)
    blocks = size // SENT + 1 if size else 0
    for b in range(blocks):
        own = broad.where(F.pmod(F.xxhash64("rule_id", "n"), F.lit(blocks)) == b)
        pack = own.agg(F.collect_list(F.struct("rule_id", "severity", "several", "n", "java", "needed")).alias("p")).scalar()
        hit = F.inline(F.filter("pack", lambda p: matches(F.col("content"), p)))
        found.append(rows.select(*LINE, pack.alias("pack")).select(*LINE, hit).drop("needed"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # Of several patterns of one rule the first that matches; a sole one matches a line once, and goes into no shuffle.
    first = hits.where("not several").select("diff_id", "at", "rule_id", "path", "line", "content", "severity", "java")
    if patterns.where("several").first() is not None:
        of_several = hits.where("several").groupBy("diff_id", "at", "rule_id").agg(F.min_by(F.struct("path", "line", "content", "severity", "java"), "n").alias("e"))
        first = first.unionByName(of_several.select("diff_id", "at", "rule_id", "e.*"))
    part = lambda shape: F.call_function("regexp_extract", F.col("content"), shape, F.lit(1))
    before = part(F.concat(F.lit(r"\A((?s:.*?))(?:"), "java", F.lit(")")))
    text = part(F.concat(F.lit(r"\A(?s:.*?)("), "java", F.lit(")")))
    events = first.withColumns({"start": F.length(before), "match_text": text}).drop("java")
    # Events of diffs without a directive go into no shuffle.
    near = may_be_in(lines.where(F.contains(F.lower("content"), F.lit(DIRECTIVE))).select("diff_id"), "diff_id")
    told = events.where(near).join(suppressions(lines, language), ["diff_id", "at"], "left")
    suppressed = F.coalesce(F.col("suppress_all") | F.array_contains("suppress_ids", F.col("rule_id")), F.lit(False))
    told = told.withColumn("suppressed", suppressed).drop("suppress_all", "suppress_ids")
    return events.where(~near).withColumn("suppressed", F.lit(False)).unionByName(told)


def closure_table(rules: DataFrame) -> DataFrame:
    """(rule_id, needs): all rules that a rule depends on, in turn, without itself. rules: id, depends_on (null: none).

    Each round joins what is known with itself, so chains double their length; it ends when nothing is new, cycles or not.
    A dependency that isn't there is an error.
    """
    direct = rules.select(F.col("id").alias("rule_id"), F.explode("depends_on").alias("needs")).distinct()
    lost = direct.join(rules.select(F.col("id").alias("needs")), "needs", "left_anti").first()
    if lost is not None:
        raise RuleError(f"rule {lost.rule_id} depends on {lost.needs}, which isn't there")
    known = held(direct)
    n = known.count()
    while True:
        step = known.select("rule_id", F.col("needs").alias("over")).join(known.select(F.col("rule_id").alias("over"), "needs"), "over").select("rule_id", "needs")
        known = held(known.unionByName(step).distinct())
        more = known.count()
        if more == n:
            return known.where("rule_id <> needs")
        n = more


def gate(events: DataFrame, needs: DataFrame) -> DataFrame:
    """The events of rules whose needs (rule_id, needs) have all matched in the same file of the same diff, suppressed or not."""
    met = held(events.select("diff_id", "path", "rule_id").distinct())
    wanted = met.join(needs, "rule_id")
    missing = wanted.join(met.withColumnRenamed("rule_id", "needs"), ["diff_id", "path", "needs"], "left_anti").select("diff_id", "path", "rule_id").distinct()
    return events.join(missing, ["diff_id", "path", "rule_id"], "left_anti")


def self_test_pack(rules: DataFrame) -> DataFrame:
    """(rule_id, case, should_match, matched, passed) of each test case of rules that are rows: id, patterns, test_cases."""
    cases = rules.select("id", F.posexplode("test_cases").alias("case", "c"), "patterns")
    each = cases.select("id", "case", "c.input", "c.should_match", F.explode_outer("patterns").alias("pattern"))
    told = each.withColumn("java", compiler()(F.coalesce("pattern", F.lit("")))["java"])
    hit = F.bool_or(F.col("pattern").isNotNull() & F.coalesce(F.rlike(F.col("input"), F.col("java")), F.lit(False)))
    out = told.groupBy(F.col("id").alias("rule_id"), "case").agg(F.first("should_match").alias("should_match"), hit.alias("matched"))
    return out.withColumn("passed", F.col("should_match") == F.col("matched"))
