"""Receipts of runs that couldn't check anything, where files go by default, and the schemas of the records."""

from __future__ import annotations

import hashlib
import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BASELINE_SCHEMA, CHECK_SCHEMA, SENSOR_SCHEMA, TOOL, TREND_SCHEMA, VERSION
from ..operators import history
from ..operators.rules import Rule
from ..schemas import FP_ENTRY, RECEIPT, TREND_RUN
from ..sources import records

INTERNAL, RUNTIME_ERROR = f"{TOOL}.internal", "tool.runtime_error"
#: File names by format. Those of the second table stay where they are beside a sensor report.
MOVED = {"sarif": "report.sarif.json", "junit": "report.xml", "csv": "report.csv", "tsv": "report.tsv", "rule-stats": "rule-stats.json", "false-positives": "false-positives.json", "trend-history": "trend-history.json"}
FIXED = {"receipt": "report.json", "markdown": "comment.md", "sensor": "report.json", "gitlab": "gl-code-quality-report.json", "checkstyle": "checkstyle.xml"}


def _receipt(spark: SparkSession, base: str, head: str, scope: str, context: int, findings: list, status: str, errors: int, reason: str) -> DataFrame:
    row = (CHECK_SCHEMA, (TOOL, VERSION), (base, head, context, scope, 0, 0), findings, (status, (0, 0, errors, None), [reason]), None)
    return spark.createDataFrame([row], RECEIPT)


def skip_receipt(spark: SparkSession, reason: str, base: str = "origin/main", head: str = "HEAD", scope: str = "added", context: int = 0) -> DataFrame:
    """The receipt of a check that had nothing to work on: no_diff_input, missing_base or git_unavailable."""
    return _receipt(spark, base, head, scope, context, [], "skip", 0, reason)


def tool_error_receipt(spark: SparkSession, detail: str, base: str = "origin/main", head: str = "HEAD", scope: str = "added", context: int = 0) -> DataFrame:
    """The receipt of a check that broke off, whose one finding is the error."""
    return _receipt(spark, base, head, scope, context, [(INTERNAL, "error", detail, "", 0, None, "", "")], "fail", 1, "tool_error")


def tool_error_report(spark: SparkSession, detail: str, started_at: str, ended_at: str, base: str = "origin/main", head: str = "HEAD", duration_ms: int = 0) -> DataFrame:
    """(page): the same as a sensor report. What the tool would have told of git is not to be had."""
    mark = hashlib.sha256(f"{INTERNAL}:{RUNTIME_ERROR}:{detail}".encode()).hexdigest()
    finding = {"check_id": INTERNAL, "code": RUNTIME_ERROR, "severity": "error", "message": detail, "location": {"path": "", "line": 0}, "fingerprint": mark, "data": {"error": detail}}
    able = {"status": "unavailable", "reason": "tool_error", "detail": detail}
    doc = {"schema": SENSOR_SCHEMA, "tool": {"name": TOOL, "version": VERSION}, "run": {"started_at": started_at, "ended_at": ended_at, "duration_ms": duration_ms, "capabilities": {"git": able}}, "verdict": {"status": "fail", "counts": {"info": 0, "warn": 0, "error": 1}, "reasons": ["tool_error"]}, "findings": [finding], "data": {"diff": {"base": base, "head": head}}}
    return spark.createDataFrame([(json.dumps(doc),)], "page string")


def default_path(kind: str, beside_sensor: bool = False) -> Path:
    """Where a format goes by default; beside a sensor report most move to a folder of extras."""
    base = Path("artifacts") / TOOL
    if beside_sensor and kind == "receipt":
        return base / "extras/check.json"
    if kind in MOVED:
        return base / "extras" / MOVED[kind] if beside_sensor else base / MOVED[kind]
    return base / FIXED[kind]


def write_page(pages: DataFrame, path: str | Path) -> None:
    """The one page of `pages` to a file, in the file system that Spark reads the path from; folders are made, an older file is replaced.

    An error if there are more pages or none: `write_pages` is for many.
    """
    spark, rows = pages.sparkSession, pages.select("page").take(2)
    if len(rows) != 1:
        raise ValueError(f"one page was expected for {path}, not {'more' if rows else 'none'}")
    text = rows[0][0]
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.getScheme() == "file":  # without the checksum file that Hadoop puts beside
        path = Path(files.makeQualified(where).toUri().getPath())
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_pages(pages: DataFrame, folder: str) -> None:
    """The pages (diff_id, page) of any number of diffs, written by the tasks that hold them: a file in a folder diff_id=... for each.

    Files show only once all tasks are done; a task that fails leaves none. What the folder held before goes. Pages end in one
    line feed.
    """
    pages.select("diff_id", F.regexp_replace("page", r"\n\z", "").alias("page")).write.mode("overwrite").partitionBy("diff_id").text(folder)


def _listed(rows: DataFrame, name: str, schema: str, element: str, *order: str) -> DataFrame:
    """(page): one document of all rows in order, as the readers of records take it."""
    fields_ = T._parse_datatype_string(element).names
    key = F.struct(*order, F.struct(*fields_).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(key)), lambda r: r["x"])
    return rows.agg(F.to_json(F.struct(F.lit(schema).alias("schema"), listed.alias(name)), {"pretty": "true"}).alias("page"))


def write_acknowledged(entries: DataFrame, path: str) -> None:
    """Adds `entries` (FP_ENTRY) to the file of acknowledged findings at `path`, which is made if it's missing.

    The file is one document, which a person reads and edits; notes that it has stay.
    """
    old = records.read_acknowledged(entries.sparkSession, path)
    write_page(_listed(history.merge_baselines(old, entries), "entries", BASELINE_SCHEMA, FP_ENTRY, "rule_id", "path", "line", "fingerprint"), path)


def append_history(run: DataFrame, path: str, most: int | None = None) -> None:
    """Adds `run` (one row of TREND_RUN) to the history at `path`, which is made if it's missing, and keeps the newest `most`."""
    runs = history.append_run(records.read_history(run.sparkSession, path), run, most)
    write_page(_listed(runs, "runs", TREND_SCHEMA, TREND_RUN, "seq"), path)


#: The words of some fields of the records, those that may be missing, and those of these that may be null.
WORDS = {"scope": ["added", "changed", "modified", "deleted"], "severity": ["info", "warn", "error"], "status": ["pass", "warn", "fail", "skip"]}
OPTIONAL, NULLABLE = {"seq", "column", "note", "suppressed", "timing"}, {"column", "note", "timing"}


def _schema(kind: T.DataType, name: str = "") -> dict:
    if isinstance(kind, T.StructType):
        out = {"type": "object", "required": [f.name for f in kind if f.name not in OPTIONAL], "properties": {f.name: _schema(f.dataType, f.name) for f in kind}}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": _schema(kind.elementType)}
    elif isinstance(kind, T.StringType):
        out = {"type": "string"} | ({"enum": WORDS[name]} if name in WORDS else {})
    else:
        out = {"type": "boolean"} if isinstance(kind, T.BooleanType) else {"type": "integer", "minimum": 0}
    return out | ({"type": [out["type"], "null"]} if name in NULLABLE else {})


def json_schemas() -> dict[str, dict]:
    """JSON Schemas of the five records."""
    table = lambda ddl: _schema(T._parse_datatype_string(ddl))
    listed = lambda name, ddl, schema: {"type": "object", "required": ["schema"], "properties": {"schema": {"type": "string", "const": schema}, name: {"type": "array", "items": table(ddl)}}}
    kinds = {"str": "string", "bool": "boolean", "int | None": "integer", "str | None": "string"}
    rule = {f.name: {"type": kinds[f.type]} if f.type in kinds else {"type": "array"} for f in fields(Rule)}
    config = {"type": "object", "properties": {"includes": {"type": "array", "items": {"type": "string"}}, "defaults": {"type": "object"}, "rule": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": rule}}}}
    run = {"type": "object", "required": ["started_at", "ended_at", "duration_ms"], "properties": {"started_at": {"type": "string"}, "ended_at": {"type": "string"}, "duration_ms": {"type": "integer", "minimum": 0}, "capabilities": {"type": "object"}}}
    sensor = {"type": "object", "required": ["schema", "tool", "run", "verdict", "findings"], "properties": {"schema": {"const": SENSOR_SCHEMA}, "tool": {"type": "object"}, "run": run, "verdict": table(RECEIPT)["properties"]["verdict"], "findings": {"type": "array"}, "artifacts": {"type": "array"}, "data": {"type": "object"}}}
    receipt = table(RECEIPT)
    receipt["properties"]["schema"]["const"] = CHECK_SCHEMA
    return {"check": receipt, "config": config, "false-positive-baseline": listed("entries", FP_ENTRY, BASELINE_SCHEMA), "trend-history": listed("runs", TREND_RUN, TREND_SCHEMA), "sensor": sensor}
