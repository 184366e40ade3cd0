"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; without one a temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: it is computed once, and lost executors cost nothing.

    The shuffle files behind it aren't needed any more. Spark deletes them once the driver has collected the plan that
    owns them, which is asked for here: they would fill the disks long before a large driver heap does. The folders of
    the written tables `instead_of`, which nothing else reads, are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    for old in instead_of:
        where = spark._jvm.org.apache.hadoop.fs.Path(old.cut_path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a row, as text: its id and a 128-bit hash of its text. Rows that repeat both share it and get equal results."""
    own, text = F.col(id_col).cast("string"), F.col(text_col)
    digest = F.concat_ws(":", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))
    return F.concat(F.coalesce(F.concat(own, F.lit(":")), F.lit("?")), F.when(text.isNull(), "").otherwise(digest))


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes; null has none."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")


def in_bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def slices(lists: pa.ListArray, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Stretches of a list array of at most `most` values or one list: the values, and where each list begins and the last ends."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lists.values.slice(offsets[lo], offsets[hi] - offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
        lo = hi
