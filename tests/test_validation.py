"""Records against their schemas: places and errors, and records that the package writes itself."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunksieve.constants import BASELINE_SCHEMA, CHECK_SCHEMA
from hunksieve.operators.rules import Rule
from hunksieve.plans.check import Plan, run_sensor
from hunksieve.sinks import encoders, outcomes
from hunksieve.sources import diffs, validation

RUN = {"started_at": "s", "ended_at": "e", "duration_ms": 1, "base": "b", "head": "h", "scope": "added", "status": "pass", "counts": {"info": 0, "warn": 0, "error": 0}, "files_scanned": 1, "lines_scanned": 1, "findings": 0}
ENTRY = {"fingerprint": "f", "rule_id": "r", "path": "p", "line": 3}


def found(spark, schema, *docs):
    rows = [(i, d if isinstance(d, str | None) else json.dumps(d)) for i, d in enumerate(docs)]
    out = validation.record_errors(spark.createDataFrame(rows, "n int, text string"), outcomes.json_schemas()[schema])
    return Counter(tuple(r) for r in out.collect())


def test_baseline_records(spark):
    base = lambda *e, **k: {"schema": BASELINE_SCHEMA, "entries": list(e)} | k
    good = [base(), {"schema": BASELINE_SCHEMA}, base(ENTRY, ENTRY | {"note": None, "more": [1]}), base(ENTRY | {"note": "é"})]
    bad = [None, "", "{", "[]", "null", "{}", base(schema="x"), base(entries=None), base(entries={}), base(None), base(ENTRY, {**ENTRY, "line": -1, "note": 5}), base({"line": "3", "path": None}), base(ENTRY | {"line": 1.5})]
    at = len(good)
    assert found(spark, "false-positive-baseline", *good, *bad) == Counter(
        [
            (at, "$", "is no JSON"), (at + 1, "$", "is no JSON"), (at + 2, "$", "is no JSON"), (at + 3, "$", "is no object"), (at + 4, "$", "is no object"),
            (at + 5, "$.schema", "is missing"), (at + 6, "$.schema", f"is none of {BASELINE_SCHEMA}"), (at + 7, "$.entries", "is no array"), (at + 8, "$.entries", "is no array"), (at + 9, "$.entries[0]", "is no object"),
            (at + 10, "$.entries[1].line", "is less than 0"), (at + 10, "$.entries[1].note", "is no string or null"),
            (at + 11, "$.entries[0].fingerprint", "is missing"), (at + 11, "$.entries[0].rule_id", "is missing"), (at + 11, "$.entries[0].path", "is no string"), (at + 11, "$.entries[0].line", "is no integer"),
            (at + 12, "$.entries[0].line", "is no integer"),
        ]
    )


def test_receipts_and_histories(spark, tmp_path):
    made = [outcomes.skip_receipt(spark, "missing_base"), outcomes.tool_error_receipt(spark, "boom")]
    pages = [encoders.receipt_json(r.withColumn("diff_id", F.lit("d"))).first().page for r in made]
    worse = json.loads(pages[1])
    worse["verdict"]["status"], worse["diff"]["scope"] = "ok", "all"
    worse["findings"][0]["severity"] = "fatal"
    del worse["verdict"]["counts"]["warn"]
    want = [("$.verdict.status", "is none of pass, warn, fail, skip"), ("$.diff.scope", "is none of added, changed, modified, deleted"), ("$.findings[0].severity", "is none of info, warn, error"), ("$.verdict.counts.warn", "is missing")]
    assert found(spark, "check", *pages, worse) == Counter((2, *x) for x in want)
    assert found(spark, "trend-history", {"schema": "hunksieve.trend_history.v1", "runs": [RUN, RUN | {"counts": 3}]}) == Counter([(0, "$.runs[1].counts", "is no object")])
    for i, text in enumerate([*pages, json.dumps(worse)]):
        (tmp_path / f"{i}.json").write_text(text)
    got = validation.file_errors(spark, str(tmp_path), outcomes.json_schemas()["check"]).collect()
    assert Counter((r["at"], r.error) for r in got) == Counter(want) and {r.file.rsplit("/", 1)[1] for r in got} == {"2.json"}
    assert json.loads(pages[0])["schema"] == CHECK_SCHEMA


def test_reports_and_labels(spark, tmp_path):
    """Reports keep to their schema; diffs that are files name themselves."""
    page = outcomes.tool_error_report(spark, "boom", "t0", "t1", duration_ms=7).first().page
    assert json.loads(page)["run"] == {"started_at": "t0", "ended_at": "t1", "duration_ms": 7, "capabilities": {"git": {"status": "unavailable", "reason": "tool_error", "detail": "boom"}}}
    (tmp_path / "a b+c.diff").write_text("diff --git a/f b/f\n+++ b/f\n@@ -0,0 +1 @@\n+x\n")
    lines = diffs.parse_unified_diffs(diffs.read_diff_files(spark, str(tmp_path)).unionByName(diffs.raw_diff(spark, "diff --git a/g b/g\n+++ b/g\n@@ -0,0 +1 @@\n+x\n")))
    done, reports = run_sensor(lines, [Rule("r", "warn", "m", patterns=("x",))], Plan(base=None))
    pages = [r.page for r in reports.collect()]
    assert sorted(json.loads(p)["data"]["diff"]["base"] for p in pages) == ["(file:" + str(tmp_path / "a b+c.diff") + ")", "(stdin)"]
    assert found(spark, "sensor", page, *pages) == Counter()
    worse = json.loads(page)
    del worse["run"]["duration_ms"]
    assert found(spark, "sensor", worse) == Counter([(0, "$.run.duration_ms", "is missing")])


@pytest.mark.parametrize("schema", ["check", "config", "false-positive-baseline", "trend-history", "sensor"])
def test_all_schemas(spark, schema):
    assert found(spark, schema, "3") == Counter([(0, "$", "is no object")])
    assert found(spark, schema).total() == 0


def test_each_value_is_read_once(spark):
    """The expression grows with the depth of a schema, not with a power of it."""

    def size(depth):
        schema = {"type": "integer", "minimum": 0}
        for _ in range(depth):
            schema = {"type": "object", "required": ["a"], "properties": {"a": schema}}
        return str(validation.errors_of(F.col("v"), schema, F.lit("$"))).count("try_variant_get")

    assert size(6) <= 2 * size(3)
