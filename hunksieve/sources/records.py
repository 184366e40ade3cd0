"""Readers of what runs leave behind: receipts, baselines, histories, and blame output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BASELINE_SCHEMA, CHECK_SCHEMA, TREND_SCHEMA
from ..schemas import FP_ENTRY, RECEIPT, TREND_RUN


class RecordError(ValueError):
    """A file that isn't what it should be."""


def _struct(ddl: str) -> str:
    """A table schema as one of array elements."""
    out, level = "", 0
    for word in ddl.split(", "):
        name, rest = word.split(" ", 1) if level == 0 else ("", word)
        level += rest.count("<") - rest.count(">")
        out += (", " if out else "") + (f"{name}: {rest}" if name else rest)
    return out


def is_missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing is at `path`, in the file system that Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts, one row for each file."""
    return spark.read.schema(RECEIPT).json(path, multiLine=True)


def receipt_findings(receipts: DataFrame) -> DataFrame:
    """The findings of receipts in order, with their place (from 1) as n."""
    return receipts.select(F.posexplode("findings").alias("n", "f")).select((F.col("n") + 1).alias("n"), "f.*")


def read_baseline_receipt(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, path, line) of an old receipt; an error if it's missing or of another schema."""
    if is_missing(spark, path):
        raise RecordError(f"no baseline at {path}")
    receipts = read_receipts(spark, path)
    _expect(receipts, CHECK_SCHEMA, path)
    return receipt_findings(receipts).select("rule_id", "path", "line").distinct()


def _expect(frame: DataFrame, schema: str, path: str) -> None:
    if other := [r[0] for r in frame.where(~F.col("schema").eqNullSafe(schema)).select("schema").limit(1).collect()]:
        raise RecordError(f"{path} has schema {other[0]}, not {schema}")


def _read_list(spark: SparkSession, path: str, name: str, element: str, schema: str) -> DataFrame:
    if is_missing(spark, path):
        return spark.createDataFrame([], element)
    frame = spark.read.schema(f"schema string, {name} array<struct<{_struct(element)}>>").json(path, multiLine=True)
    _expect(frame, schema, path)
    return frame.select(F.posexplode(name).alias("_at", "x")).select("_at", "x.*")


def read_acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """FP_ENTRY of an acknowledged-findings file; none if it's missing."""
    return _read_list(spark, path, "entries", FP_ENTRY, BASELINE_SCHEMA).drop("_at")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """TREND_RUN of a history file, numbered in order; none if it's missing."""
    runs = _read_list(spark, path, "runs", TREND_RUN, TREND_SCHEMA)
    return runs.withColumn("seq", F.col("_at").cast("long")).drop("_at") if "_at" in runs.columns else runs


def parse_blame(raw: DataFrame) -> DataFrame:
    """BLAME of porcelain output. raw: (path, pos, raw), a row for each line of output.

    A record begins with a header of hash, old line, new line and perhaps a count; it ends with a line that starts with
    a tab, and stands for as many lines as the count says. Headers of fewer than four fields go on with the next line
    of the record before and are left out.
    """
    r = F.col("raw")
    fields = F.split(r, " ")
    header = r.rlike(r"^[0-9a-f]{8,64} \d+ \d+( \d+)?$")
    order = Window.partitionBy("path").orderBy("pos")
    rows = raw.withColumn("record", F.sum(F.when(header, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda name: F.max(F.when(F.startswith(r, F.lit(f"{name} ")), F.substr(r, F.lit(len(name) + 2))))
    first = F.max(F.when(header, F.get(fields, F.lit(2)).cast("long")))
    count = F.max(F.when(header, F.get(fields, F.lit(3)).cast("long")))
    out = rows.where("record > 0").groupBy("path", "record").agg(first.alias("line"), count.alias("n"), pick("author").alias("author"), pick("author-mail").alias("author_mail"), pick("author-time").cast("long").alias("author_time"))
    out = out.where("n > 0").select("path", F.explode(F.sequence("line", F.col("line") + F.col("n") - 1)).alias("line"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("author_mail", F.lit("")).alias("author_mail"), F.coalesce("author_time", F.lit(0)).alias("author_time"))
    return out
