"""Licence passages: spans of a text's word sequence against whole licence texts and notices, wherever lines break.

A span's coefficient is largest where it begins and ends with bigrams of the template that don't recur inside it, so
those spans are all that is tried. A text without two thirds of a template's bigrams has none of Dice 0.8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key
from .licenses import TEMPLATES

#: Public notices besides those of single lines.
NOTICES = [
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
WORD = re.compile(r"[a-z0-9]+")
COLUMNS = "doc_id, key, license, dice, word, n_words, licenses"


def whole_texts() -> list[tuple[str, str]]:
    """Licence and text of each file beside this module; the driver reads them."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def best_span(grams: np.ndarray, inside: np.ndarray, size: int, least: float) -> tuple[float, int, int] | None:
    """Dice, first and last bigram of the best span, if it has `least`; of equal ones the shortest, then the earliest.

    grams: a number for each bigram of the text; inside: whether the template has it; size: the template's bigrams.
    """
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    prev, after = np.full(n, -1), np.full(n, n)
    prev[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    most, best = size * (2 - least) / least, None
    for i in np.flatnonzero(inside):
        end = min(after[i], i + int(most) + 2)
        while True:  # repeated bigrams take room without adding to the set
            new = prev[i:end] < i
            distinct = np.cumsum(new)
            if end == after[i] or distinct[-1] > most:
                break
            end = min(after[i], i + 2 * (end - i))
        dice = np.where(inside[i:end] & new, 2.0 * np.cumsum(new & inside[i:end]) / (distinct + size), 0.0)
        j = int(dice.argmax())
        if dice[j] >= least and (best is None or (dice[j], best[2] - best[1]) > (best[0], j)):
            best = (float(dice[j]), int(i), int(i) + j)
    return best


def find_passages(docs: DataFrame, rows: list[tuple[str, str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, key, license and dice of the best passage, its first word (from 0) and length, all licenses found.

    Words are runs of ASCII letters and digits, lower-cased. Templates (`rows`, of two words at least) are the whole
    texts and the notices, if none are given. Of equal coefficients the smaller template number, then the shorter, then the
    earlier passage wins;
    without a match license, dice, word and n_words are null and licenses is empty.
    """
    known = rows if rows is not None else whole_texts() + TEMPLATES + NOTICES
    pairs = [set(zip(w, w[1:], strict=False)) for w in (words_of(t) for _, t in known)]
    ids = {p: i for i, p in enumerate(sorted(set().union(*pairs)))}
    has = np.zeros((len(known), len(ids) + 1), dtype=bool)  # the last column: bigrams of no template
    for t, own in enumerate(pairs):
        has[t, [ids[p] for p in own]] = True
    sizes = has.sum(1)
    need = np.maximum(1, sizes * least / (2 - least) - 1e-9)
    held = has.T.astype(np.int32)

    def found(text: str | None) -> tuple:
        words = words_of(text or "")
        here = [*map(ids.get, zip(words, words[1:], strict=False))]
        some = list({*here} - {None})
        might = np.flatnonzero(held[some].sum(0) >= need) if some else ()
        if not len(might):
            return None, None, None, None, ""
        marks = np.array([len(ids) if x is None else x for x in here])
        numbers: dict = {}
        grams = np.array([numbers.setdefault(p, len(numbers)) for p in zip(words, words[1:], strict=False)])
        spans = [(-s[0], int(t), s[1], s[2]) for t in might if (s := best_span(grams, has[t, marks], int(sizes[t]), least))]
        if not spans:
            return None, None, None, None, ""
        less, t, first, last = min(spans)
        return known[t][0], -less, first, last - first + 2, ",".join(sorted({known[s[1]][0] for s in spans}))

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = list(zip(*(found(t.as_py()) for t in part.column(2)), strict=True))
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=COLUMNS.split(", "))

    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"doc_id {kind}, key string, license string, dice double, word long, n_words long, licenses string")
