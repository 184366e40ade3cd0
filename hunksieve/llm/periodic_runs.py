"""Maximal runs of repeated word sequences, by a suffix tree whose smaller leaf lists are walked (Stoye and Gusfield, 2002).

A branching tandem repeat is two equal neighbours, of `period` words each, that another word follows than the one which
begins the second. It shows in the suffix tree as two leaves, `period` apart, whose paths part at depth `period`. At each
inner node all leaves but those of the largest child look for their partners, so a leaf is looked at log n times at most.
A run ends with one branching repeat; rotating that to the left, as long as the words allow, gives where the run begins.

The tree is the suffix array with its intervals of equal prefixes, in numpy, over one batch of texts at a time. Words in
no repeated sequence of half the least length lie in no run, so just the stretches of the others are put into a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words of a tree, unless one stretch is longer, and leaves looked at in one step.
TREE, STEP = 1 << 18, 1 << 20
#: Words of an Arrow batch that are looked at in one step, or one text.
SLICE = 1 << 19
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RESULTS = ("words", "n_words", "runs", "kept")


def words(text: Column) -> Column:
    """Runs of other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def prefix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words the rank of what begins at each place, until all differ. The end counts as a least word."""
    n = len(codes)
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    while (last := levels[-1]).max() < n - 1:
        size = 1 << (len(levels) - 1)
        key = last.astype(np.int64) * (n + 1)
        key[: n - size] += last[size:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        levels.append(rank)
    return levels


def alike(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words are equal from the places a and b on (step 1), or before them (step -1)."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    total, n = np.zeros(len(a), dtype=np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        low, high = (np.minimum(a, b), np.maximum(a, b)) if step > 0 else (np.minimum(a, b) - size, np.maximum(a, b) - size)
        fits = np.flatnonzero((low >= 0) & (high < n))
        same = fits[levels[k][low[fits]] == levels[k][high[fits]]]
        total[same] += size
        a[same] += step * size
        b[same] += step * size
    return total


def inner_nodes(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place between neighbours of the suffix array the node that parts them: its leaves are left to right - 1."""
    h = shared.tolist()
    left, right, stack = [0] * len(h), [len(h)] * len(h), [0]
    for k in range(1, len(h)):
        x = h[k]
        while h[stack[-1]] > x:
            right[stack.pop()] = k
        top = stack[-1]
        left[k] = left[top] if h[top] == x else top
        stack.append(k)
    for k in stack:
        right[k] = len(h)
    right = np.array(right)
    return np.array(left), right


def branching_repeats(levels: list[np.ndarray]) -> np.ndarray:
    """(place, period) of all branching tandem repeats."""
    rank = levels[-1].astype(np.int64)
    n = len(rank)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    shared = np.append(-1, alike(levels, order[:-1], order[1:], 1))
    left, right = inner_nodes(shared)
    parts = np.flatnonzero(shared > 0)
    parts = parts[np.lexsort((parts, right[parts], left[parts]))]
    lo, hi, depth = left[parts], right[parts], shared[parts]
    first = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[: len(parts)]
    last = np.append(first[1:], True)[: len(parts)]
    # Children: one before the first parting of a node, one from each parting to the next.
    begin = np.concatenate([lo[first], parts])
    end = np.concatenate([parts[first], np.where(last, hi, np.append(parts[1:], 0)[: len(parts)])])
    node = np.concatenate([np.flatnonzero(first), np.maximum.accumulate(np.where(first, np.arange(len(parts)), 0))])
    by_node = np.lexsort((begin, begin - end, node))  # of each node the largest child first, which is left out
    largest = np.append(True, node[by_node][1:] != node[by_node][:-1])[: len(by_node)]
    small = by_node[~largest]
    begin, end, node = begin[small], end[small], node[small]
    found = [np.zeros((0, 2), dtype=np.int64)]
    sizes = end - begin
    total = np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(STEP, (total[-1] if len(total) else 0) + STEP, STEP)), len(sizes)))
    for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
        size = sizes[a:b]
        own = np.repeat(np.arange(a, b), size)
        leaf = order[begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)]
        period = depth[node[own]]
        for other, at in ((leaf + period, leaf), (leaf - period, leaf - period)):
            fits = np.flatnonzero((other >= 0) & (other < n))
            r, o = rank[other[fits]], own[fits]
            met = fits[(r >= lo[node[o]]) & (r < hi[node[o]]) & ((r < begin[o]) | (r >= end[o]))]
            found.append(np.stack([at[met], period[met]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def maximal_runs(codes: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of the runs of at least `least` words and two periods, whose period is the smallest, in order."""
    levels = prefix_ranks(codes)
    place, period = branching_repeats(levels).T
    before = alike(levels, place, place + period, -1)
    start, length = place - before, before + 2 * period
    rows = np.stack([start, length, period], axis=1)[length >= least]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)  # multiples of a run's period
    return rows[np.append(True, ~same)[: len(rows)]]


def stretches(codes: np.ndarray, own: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of `least` words or more that repeated sequences of k words of one text cover.

    Sequences are compared by 64-bit hashes: a clash makes a stretch longer, and changes no run.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = own[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        h = (h ^ codes[i : i + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    inside = np.flatnonzero(own[:n] == own[k - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = np.append(False, h[order][1:] == h[order][:-1])[: len(order)]
    hit = order[same | np.append(same[1:], False)[: len(order)]]
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    edge[hit] += 1
    np.add.at(edge, hit + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    starts = np.flatnonzero(covered & (np.append(True, ~covered[:-1]) | np.append(True, own[1:] != own[:-1])))
    ends = np.flatnonzero(covered & (np.append(~covered[1:], True) | np.append(own[1:] != own[:-1], True))) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def runs_of_batch(codes: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """(text, start, length, period) of all runs of a batch, in order. offsets: where each text's words begin, and the end."""
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts, ends = stretches(codes, own, max(1, (least + 1) // 2), least)
    found = [np.zeros((0, 3), dtype=np.int64)]
    total = np.cumsum(ends - starts)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TREE, side="right")))
        size = ends[a:b] - starts[a:b]
        first = np.cumsum(size) - size
        places = np.repeat(starts[a:b] - first, size) + np.arange(size.sum())
        marks = np.arange(1, b - a)  # a word of its own between two stretches
        tree = np.insert(codes[places].astype(np.int64), first[1:], -marks)
        runs = maximal_runs(tree, least)
        back = np.insert(places, first[1:], -1)
        runs[:, 0] = back[runs[:, 0]]
        found.append(runs)
        a = b
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = own[runs[:, 0]] if len(runs) else runs[:, 0]
    return np.column_stack([text, runs[:, 0] - offsets[text], runs[:, 1:]])


def kept_parts(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, start, length) of the words of each text that no run holds after its first period."""
    n = offsets[-1] - offsets[0]
    edge = np.zeros(n + 1, dtype=np.int64)
    at = offsets[runs[:, 0]] - offsets[0] + runs[:, 1]
    np.add.at(edge, at + runs[:, 3], 1)
    np.add.at(edge, at + runs[:, 2], -1)
    kept = np.cumsum(edge[:-1]) == 0
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.append(True, own[1:] != own[:-1])[:n]
    starts = np.flatnonzero(kept & (new | np.append(True, ~kept[:-1])[:n]))
    ends = np.flatnonzero(kept & (np.append(new[1:], True)[:n] | np.append(~kept[1:], True)[:n])) + 1
    text = own[starts]
    return np.column_stack([text, starts - (offsets[text] - offsets[0]), ends - starts])


def listed(text: np.ndarray, rows: dict[str, np.ndarray], n: int) -> pa.Array:
    """A list of structs for each of n texts."""
    offsets = np.append(0, np.cumsum(np.bincount(text, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], names=list(rows)))


def finder(least: int):
    """Arrow UDF: runs and kept parts of each array of words."""

    part = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kind = pa.struct([("runs", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), ("parts", part)])

    @F.arrow_udf(f"runs array<{RUN}>, parts array<struct<start: bigint, length: bigint>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for flat, offsets in slices(batch, SLICE):
                runs = runs_of_batch(flat.dictionary_encode().indices.to_numpy(zero_copy_only=False), offsets, least)
                parts, n = kept_parts(runs, offsets), len(offsets) - 1
                columns = [listed(runs[:, 0], {"start": runs[:, 1], "length": runs[:, 2], "period": runs[:, 3]}, n), listed(parts[:, 0], {"start": parts[:, 1], "length": parts[:, 2]}, n)]
                out.append(pa.StructArray.from_arrays(columns, names=["runs", "parts"]))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    return find


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12, sequence: Column | None = None) -> DataFrame:
    """All rows and columns of `docs` with words, n_words, runs (start, length, period; by start, then period) and kept.

    A run is a stretch of at least `least` words and two periods, whose smallest period it is, that no neighbouring word
    extends; `kept` is the words that no run holds after its first period. Words are runs of other than ASCII white space,
    as they stand, or `sequence` (an array of strings without nulls) in their place. Null and empty texts have none, and so
    no runs. Repeated rows get equal results; runs may overlap; an empty table stays empty. Columns named like the
    results are replaced. Texts are read whole, one pass, no shuffle; a task holds one Arrow batch, and the trees of its
    repeated stretches one after the other.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    told = docs.select(F.struct(*names).alias("row"), (words(F.col(text_col)) if sequence is None else sequence).alias("words"))
    told = told.withColumn("found", finder(least)("words"))
    kept = F.when(F.size("found.runs") == 0, F.col("words")).otherwise(F.flatten(F.transform("found.parts", lambda p: F.slice("words", (p["start"] + 1).cast("int"), p["length"].cast("int")))))
    return told.select("row.*", "words", F.size("words").cast("long").alias("n_words"), F.col("found.runs").alias("runs"), kept.alias("kept"))
