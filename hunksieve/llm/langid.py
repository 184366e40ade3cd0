"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_bucket

#: Words are runs of letters. n-grams have up to three, a space standing for either end of a word.
OTHER = re.compile(r"[\W\d_]+")
#: Numerals that are neither letters nor decimal digits separate words too. They are rare: looked up in what OTHER leaves.
NUMERALS = dict.fromkeys((i for i in range(sys.maxunicode + 1) if (c := chr(i)).isalnum() and not (c.isalpha() or c.isdecimal())), " ")
IS_NUMERAL = np.zeros(sys.maxunicode + 1, dtype=bool)
IS_NUMERAL[list(NUMERALS)] = True
SPACE = 32
#: n-grams of a profile, and documents to learn from for each language.
RANKS, TRAINING = 400, 1000
HELD_OUT_PARTS, HELD_OUT = 3, 1


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, each packed into 63 bits, and how often each occurs."""
    words = OTHER.sub(" ", text.lower()).strip()
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not words.isascii() and IS_NUMERAL[c].any():
        return count_grams(words.translate(NUMERALS))
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = (c[:-1] << 21) | c[1:]
    inside = c[1:-1] != SPACE
    return np.unique(np.concatenate([c[1:-1][inside], pairs, ((pairs[:-1] << 21) | c[2:])[inside]]), return_counts=True)


def top_grams(text: str, ranks: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by the n-gram."""
    grams, n = count_grams(text)
    if len(grams) > 2 * ranks:  # leave out what is surely below
        keep = n >= np.partition(n, len(n) - ranks)[len(n) - ranks]
        grams, n = grams[keep], n[keep]
    return grams[np.lexsort((grams, -n))[:ranks]]


@dataclass
class Profiles:
    """n-grams that some language ranks, and each language's rank of them (`ranks` if it has none)."""

    langs: list[str]
    grams: np.ndarray
    places: np.ndarray
    ranks: int

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Sum over a document's n-grams of how far each is out of place, for each language."""
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        found = self.grams[at] == top
        own = np.arange(len(top))
        there = np.where(found[None, :], self.places[:, at], self.ranks)
        return np.where(there < self.ranks, np.abs(there - own[None, :]), self.ranks).sum(1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAINING, ranks: int = RANKS) -> Profiles:
    """Profiles of the languages in the documents whose crc32(id as text) mod 3 isn't 1.

    Each language learns from at most `per_lang` documents, those of the smallest id hashes, texts whole; rows of null
    language or text are left out. Only the profiles (languages x ranks) reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (in_bucket("id", HELD_OUT_PARTS) != HELD_OUT))
    order = F.xxhash64(F.lit(11), "id", "lang")
    # The k-th smallest hash of each language bounds its sample; a mergeable sketch of the k smallest would do no better.
    share = rows.groupBy("lang").agg(F.count("*").alias("n"))
    likely = F.least(F.lit(1.0), (1.5 * per_lang + 100) / F.col("n"))  # a window so large holds per_lang all but surely
    some = rows.join(F.broadcast(share), "lang").where(F.pmod(order, F.lit(1 << 30)) < likely * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))
    chosen = cut(some.select("lang", "id", order.alias("order")).withColumn("_place", place).where(F.col("_place") <= per_lang).select("lang", "id").distinct())

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in source:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in count_grams(text)), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    texts = some.join(F.broadcast(chosen), ["lang", "id"], "left_semi").select("lang", "text")
    sums = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= ranks).select("lang", "gram", "rank").collect()
    langs = sorted({r.lang for r in best})
    grams = np.unique(np.array([r.gram for r in best], dtype=np.int64))
    places = np.full((len(langs), max(1, len(grams))), ranks, dtype=np.int64)
    for r in best:
        places[langs.index(r.lang), np.searchsorted(grams, r.gram)] = r["rank"] - 1
    return Profiles(langs, grams if len(grams) else np.array([-1]), places, ranks)


def identifier(profiles: Profiles):
    """Pandas UDF: (lang_pred, score) of each text."""

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                top = top_grams(text or "", profiles.ranks)
                if not len(top) or not profiles.langs:
                    out.append(("und", 0.0))
                    continue
                d = profiles.distances(top)
                best = int(np.argmin(d))
                out.append((profiles.langs[best], 1 - float(d[best]) / (profiles.ranks * len(top))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return identify


def identify_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score: one less the out-of-place distance, as a share of the greatest possible.

    A null text or one without a letter is `und` with score 0, as is every text without profiles; of equal distances
    the first language in order wins. Repeated rows get equal results, an empty table stays empty. One pass, no shuffle. Columns of those names are replaced.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    told = docs.select(F.struct(*names).alias("row"), identifier(profiles)(F.col(text_col)).alias("told"))
    return told.select("row.*", "told.lang_pred", "told.score")
