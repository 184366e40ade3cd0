"""Unified diffs as tables of lines, parsed block by block."""

from __future__ import annotations

import subprocess

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sets import may_be_in
from ..schemas import LINES, RAW_DIFF
from . import parser

SCOPES = ("added", "changed", "modified", "deleted")


def split_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """RAW_DIFF of whole texts; a carriage return before a line feed belongs to the line end."""
    lines = texts.select(F.col(id_col).cast("string").alias("diff_id"), F.posexplode(F.split(F.regexp_replace(F.col(text_col), r"\n\z", ""), "\n")).alias("pos", "raw"))
    return lines.select("diff_id", F.col("pos").cast("long"), F.regexp_replace("raw", r"\r\z", "").alias("raw"))


def read_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """RAW_DIFF of diff files; the file name is the diff id."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), "value")
    return split_lines(files, "diff_id", "value")


def raw_diff(spark: SparkSession, text: str, diff_id: str = "(stdin)") -> DataFrame:
    """RAW_DIFF of one text that the driver has."""
    return split_lines(spark.createDataFrame([(diff_id, text)], "diff_id string, text string"), "diff_id", "text")


def base_label(diff_id: Column) -> Column:
    """What stands for the base of a diff that isn't from git: `(file:...)` with the path of a file that was read, a label in brackets as it is."""
    decoded = F.url_decode(F.replace(diff_id, F.lit("+"), F.lit("%2B")))
    path = F.when(F.startswith(diff_id, F.lit("file:")), F.regexp_replace(decoded, r"\Afile:/*(?=/)", "")).otherwise(diff_id)
    return F.when(F.startswith(diff_id, F.lit("(")), diff_id).otherwise(F.concat(F.lit("(file:"), path, F.lit(")")))


def git_diff(repo: str, base: str | None = None, head: str | None = None, context: int = 0, staged: bool = False, path: str | None = None, timeout: float | None = None) -> str:
    """Output of `git diff` for base...head, the index, or the working tree; an error if git fails."""
    what = ["--cached"] if staged else [f"{base}...{head}"] if base else []
    done = subprocess.run(["git", "-C", repo, "diff", f"--unified={context}", *what, *(["--", path] if path else [])], capture_output=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


def git_changes(repo: str, path: str | None = None, timeout: float = 10) -> str:
    """What an editor sees as changed: the diff of the working tree, then that of the index."""
    both = [git_diff(repo, staged=staged, path=path, timeout=timeout) for staged in (False, True)]
    return "".join(t if t.endswith("\n") else t + "\n" for t in both if t)


def union_bases(diffs: list[DataFrame], label: str) -> DataFrame:
    """The diffs against several bases as one, in the order given."""
    out = None
    for seq, d in enumerate(diffs):
        one = d.withColumn("pos", F.col("pos") + (seq << 48)).withColumn("diff_id", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


#: A block, which is parsed in one task, is 2 to this power places of a diff.
BLOCK_BITS = 17


def parse_unified_diffs(raw: DataFrame, scope: str = "added", bits: int = BLOCK_BITS) -> DataFrame:
    """LINES of the diffs in `raw` that are in scope; idx is the place in the diff.

    Added takes every added line; changed and modified those that follow a removed line since the last context line
    of their hunk; deleted the removed ones, with their old numbers. Binary files and submodules are left out, deleted
    files too but for scope deleted. A malformed hunk header skips its hunk. Null lines count as empty.

    Lines are dealt by diff and block of 2 ** bits places. Diffs of several blocks are read twice: their blocks are first
    reduced to maps of the parser's state (see `parser`), whose composition tells in which state each block begins.
    """
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    keys = ("diff_id", "block")
    keyed = raw.select("diff_id", F.shiftright("pos", bits).alias("block"), "pos", "raw")
    dealt = keyed.repartition(*(F.col(c) for c in keys))
    several = keyed.groupBy("diff_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi")
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    told = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", map string"
    maps = dealt.where(may_be_in(several, "diff_id")).sortWithinPartitions(*keys, "pos").mapInArrow(parser.summarise(scope == "deleted"), told)
    begins = maps.repartition("diff_id").sortWithinPartitions(*keys).mapInArrow(parser.carry, told)
    rows = dealt.join(begins.hint("shuffle_hash"), [*keys], "left").select(*keys, "pos", "raw", "map").sortWithinPartitions(*keys, "pos")
    return rows.mapInArrow(parser.emit(scope), f"diff_id {kinds['diff_id']}, idx {kinds['pos']}, path string, line long, content string, kind string")


def sql_parser(scope: str = "added"):
    """The parser as a table function for SQL, to be registered: `parse_diff(TABLE(raw) PARTITION BY diff_id ORDER BY pos)`.

    Its rows are those of `parse_unified_diffs`; what SQL puts into one partition goes through one task, an Arrow batch at
    a time.
    """
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")

    class Parser:
        def __init__(self):
            self.emitter = parser.Emitter(scope)

        def eval(self, rows: pa.RecordBatch):
            n = rows.num_rows
            columns = [rows.column("diff_id"), pa.array(np.zeros(n, np.int64)), rows.column("pos").cast(pa.int64()), rows.column("raw"), pa.nulls(n, pa.string())]
            found = self.emitter.of(pa.RecordBatch.from_arrays(columns, names=["diff_id", "block", "pos", "raw", "map"]))
            if found.num_rows:
                yield found

    return F.arrow_udtf(Parser, returnType=LINES)


def empty_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINES)


def stats(lines: DataFrame) -> DataFrame:
    """Files and lines of each diff."""
    return lines.groupBy("diff_id").agg(F.count_distinct("path").alias("files"), F.count("*").alias("lines"))


__all__ = ["RAW_DIFF", "empty_lines", "git_diff", "parse_unified_diffs", "raw_diff", "read_diff_files", "split_lines", "sql_parser", "stats", "union_bases"]
