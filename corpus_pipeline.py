"""A cleaning pipeline over `documents`: each stage takes all rows that the one before kept, written and read again.

All stages but the last return the columns of their input, whatever they are called, and none adds a row. An empty table
stays empty. Ids are whole numbers; a null id is the smallest. Texts may be of any length and are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hunksieve.llm import decontaminate, near_copies, packing, substring_dedup, toxicity
from hunksieve.llm.common import shared_dir
from hunksieve.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the stage's input and the labels, and leaves out what the model rejects.

    Null and empty texts score as texts without words; rows that repeat a text stay or go together.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near-duplicates.

    Fingerprints link at three bits, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Null and empty texts are near-duplicates of each other, as they have the same fingerprint; of repeated rows one stays.
    """
    return near_copies.keep_one(docs, distance=3, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of 20 words and more that an earlier document, or the same before, has as well.

    Every row stays, with a text that may have become empty; null texts stay null. Rows that repeat id and text are one
    document and are cut alike. n_chars follows the text.
    """
    return substring_dedup.dedup_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents of which windows of the benchmark cover a twentieth of the words or more.

    Null and empty texts are clean, and so is everything beside an empty benchmark.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, a row for each piece; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
