"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) of a linear numpy classifier.

Confirmed toxic examples stand against unlabelled text. The risk estimator takes the share of toxic text (the class
prior) off the unlabelled risk and never lets what is left fall below zero. Features are words and their first
letters, hashed; those that set the positives apart are chosen over the whole training sample by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_bucket

WORD = re.compile(r"\w+")
#: Bounds of the training sample and of the model, and words a worker remembers.
POSITIVES, UNLABELLED, FEATURES, REMEMBERED = 3000, 9000, 4096, 300_000
HELD_OUT_PARTS = 5


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first four and five letters."""
    return tuple(crc32(f"{kind}{x}".encode("utf-8", "replace")) for kind, x in (("w", word), ("4", word[:4]), ("5", word[:5])))


@dataclass
class Model:
    """Weights of chosen features; a text counts each of its features once."""

    index: dict[int, int]
    weights: np.ndarray
    bias: float

    def scores(self, batches: Iterator[list[str]]) -> Iterator[list[float]]:
        known: dict[str, tuple[int, ...]] = {}
        index, weights = self.index, self.weights.tolist()
        for texts in batches:
            out = []
            for text in texts:
                if len(known) > REMEMBERED:
                    known.clear()
                own: set[int] = set()
                for word in {*WORD.findall(text.lower())}:
                    if (found := known.get(word)) is None:
                        found = known[word] = tuple(index[f] for f in features_of(word) if f in index)
                    if found:
                        own.update(found)
                z = self.bias + sum(weights[i] for i in own)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
            yield out


def fit(x: list[np.ndarray], positive: np.ndarray, prior: float, width: int, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam over the whole sample with the sigmoid loss.

    x: distinct features of each text; positive: which texts are confirmed toxic, the others are unlabelled.
    """
    sizes = np.array([len(i) for i in x])
    cols = np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(len(x)), sizes)
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = -1.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], minlength=len(x)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))  # the loss of calling a text toxic if it isn't; 1 - p the other way
        slope = p * (1 - p)
        negative = (share * p)[~positive].sum() - prior * (share * p)[positive].sum()
        if negative >= 0:
            pull = np.where(positive, -2 * prior * share * slope, share * slope)
        else:  # the unlabelled risk has been overfitted: step back on it alone
            pull = np.where(positive, prior * share * slope, -share * slope)
        grad = np.append(np.bincount(cols, pull[rows], minlength=width), pull.sum()) + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """A model from the documents whose crc32(id as text) mod 5 isn't 0.

    The sample takes at most `positives` confirmed toxic documents, and at most `unlabelled` of all documents without a
    look at their labels, those of the smallest id hashes; its texts are whole. The class prior is the share of toxic among all labels outside the held-out part.
    Without positives or distinguishing features the model gives every text a constant low score.
    """
    order = F.xxhash64(F.lit(7), "id")
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (in_bucket("id", HELD_OUT_PARTS) != 0))
    marked = labels.select(F.col(id_col).alias("id"), F.col("toxic").alias("toxic")).where(in_bucket("id", HELD_OUT_PARTS) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    prior = marked.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    known = marked.where("toxic = 1").select("id")
    pos = known.orderBy(order, "id").limit(positives).withColumn("positive", F.lit(True))
    others = ids.select("id").distinct().orderBy(order, "id").limit(unlabelled).withColumn("positive", F.lit(False))  # of all text, toxic or not
    chosen = cut(pos.unionByName(others))  # at most positives + unlabelled ids

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [sorted({f for w in {*WORD.findall((t or "").lower())} for f in features_of(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["positive", "found"])

    sample = cut(ids.join(F.broadcast(chosen), "id").select("positive", "text").mapInArrow(read, "positive boolean, found array<long>"))
    n = {r[0]: r[1] for r in sample.groupBy("positive").count().collect()}
    np_, nu = n.get(True, 0), n.get(False, 0)
    if not np_ or not nu:
        return Model({}, np.zeros(0), -4.0)
    seen = sample.select("positive", F.explode("found").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    rate = (F.col("u") + 1) / (nu + 2)
    gain = (F.col("p") / np_ - rate) / F.sqrt(rate * (1 - rate) / np_)
    least = max(4, np_ // 50)
    best = [r.f for r in seen.where(F.col("p") >= least).select("f", gain.alias("gain")).where("gain >= 5").orderBy(F.desc("gain"), "f").limit(features).collect()]
    index = {f: i for i, f in enumerate(best)}

    def pick(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [[index[f] for f in fs if f in index] for fs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "found"])

    rows = sample.mapInArrow(pick, "positive boolean, found array<int>").collect()  # bounded by the sample
    weights, bias = fit([np.array(r.found) for r in rows], np.array([r.positive for r in rows]), min(max(prior, 0.001), 0.5), len(index))
    return Model(index, weights, bias)


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for out in model.scores([t or "" for t in texts] for texts in batches):
            yield pd.Series(out, dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts get the score of no features.

    One pass, no shuffle; repeated rows get equal scores. Columns of those names are replaced.
    """
    out = docs.withColumn("score", scorer(model)(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model doesn't reject, columns unchanged."""
    return docs.where(scorer(model)(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)
