"""Configuration, records, sinks and the editor stream."""

import json
import subprocess
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from hunksieve.constants import BASELINE_SCHEMA, CHECK_SCHEMA, CONFIG_FILE
from hunksieve.operators import history
from hunksieve.operators.rules import Rule, TestCase, self_test, self_test_totals
from hunksieve.plans.check import Plan, run_check, run_sensor
from hunksieve.schemas import LINES, TREND_RUN
from hunksieve.sinks import encoders, outcomes
from hunksieve.sources import config, diffs, records
from hunksieve.streaming import editor


def test_config(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/base.toml").write_text('[defaults]\nscope = "changed"\nbase = "${BASE:-main}"\n[[rule]]\nid = "a"\nseverity = "warn"\npatterns = ["x"]\n')
    (tmp_path / "main.toml").write_text('includes = ["sub/base.toml", "sub/base.toml"]\n[defaults]\nfail_on = "warn"\n[[rule]]\nid = "b"\npatterns = ["${P}"]\n')
    got = config.load_config(tmp_path / "main.toml", {"P": "y"})
    assert [(r.id, r.patterns) for r in got.rules] == [("a", ("x",)), ("b", ("y",))]
    assert got.defaults == config.Defaults("main", "HEAD", "changed", "warn", 200, 0)
    with pytest.raises(config.ConfigError, match="P is not set"):
        config.load_config(tmp_path / "main.toml", {})
    (tmp_path / "loop.toml").write_text('includes = ["loop.toml"]')
    (tmp_path / "bad.toml").write_text("[[rule]]\nid = 'a'\nnope = 1")
    for name in ("loop.toml", "bad.toml", "none.toml"):
        with pytest.raises(config.ConfigError):
            config.load_config(tmp_path / name)
    for i in range(12):
        (tmp_path / f"d{i}.toml").write_text(f'includes = ["d{i + 1}.toml"]' if i < 11 else "")
    with pytest.raises(config.ConfigError, match="levels"):
        config.load_config(tmp_path / "d0.toml")
    assert len(config.effective(got).rules) == 10 and [r.id for r in config.effective(got, False).rules] == ["a", "b"]
    assert len(config.preset("secrets").rules) == 7
    assert config.expand_env("${A:-x}", {"A": ""}) == ""


def test_overrides_of_directories(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / CONFIG_FILE).write_text('[[rule]]\nid = "r"\nseverity = "info"\n')
    (tmp_path / "a/b" / CONFIG_FILE).write_text('[[rule]]\nid = "r"\nenabled = false\nexclude_paths = ["x/**"]\n')
    lines = spark.createDataFrame([("d", 0, "a/b/c.py", 1, "x", "added")], LINES)
    assert config.load_overrides(lines, tmp_path) == [
        {"directory": "", "rule_id": "r", "enabled": None, "severity": "info", "exclude_paths": []},
        {"directory": "a/b", "rule_id": "r", "enabled": False, "severity": None, "exclude_paths": ["x/**"]},
    ]


@pytest.mark.parametrize("name", sorted(config.PRESETS))
def test_preset_texts(tmp_path, name):
    (tmp_path / "c.toml").write_text(config.config_text(config.preset(name)), encoding="utf-8")
    assert config.load_config(tmp_path / "c.toml", {}) == config.preset(name)


def test_config_text(spark, tmp_path):
    rule = Rule("a", patterns=('say "é\\d" 😀\t\x7f',), test_cases=(TestCase("é1", True, language="py"), TestCase("b\n", False)), multiline_window=0)
    made = config.Config(config.STANDARD, (rule,))
    (tmp_path / "c.toml").write_text(config.config_text(made), encoding="utf-8")
    assert config.load_config(tmp_path / "c.toml", {}) == made
    with pytest.raises(config.ConfigError):
        config.config_text(config.Config(rules=(Rule("a", patterns=("${HOME}",)),)))
    tested = self_test(spark, [Rule("a", patterns=("x",), test_cases=(TestCase("x", True), TestCase("x", False), TestCase("y", False)))])
    assert self_test_totals(tested).first()[:] == (2, 1) and self_test_totals(tested.limit(0)).first()[:] == (0, 0)


def test_git(tmp_path, spark):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "f.py").write_text("a\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "f.py").write_text("a\nb\n")
    (tmp_path / "g.py").write_text("n\n")
    git("add", ".")
    (tmp_path / "f.py").write_text("a\nb\nc\n")
    seen = diffs.parse_unified_diffs(diffs.raw_diff(spark, diffs.git_changes(str(tmp_path), "f.py"))).orderBy("idx").collect()
    assert [(r.path, r.line, r.content) for r in seen] == [("f.py", 3, "c"), ("f.py", 2, "b")]
    (tmp_path / "f.py").write_text("a\nb\n")
    git("rm", "-qf", "g.py")
    staged = diffs.parse_unified_diffs(diffs.raw_diff(spark, diffs.git_diff(str(tmp_path), staged=True)))
    assert [(r.path, r.line, r.content) for r in staged.collect()] == [("f.py", 2, "b")]
    git("commit", "-qm", "two")
    assert "+b" in diffs.git_diff(str(tmp_path), "HEAD~1", "HEAD") and diffs.git_diff(str(tmp_path)) == ""
    with pytest.raises(RuntimeError):
        diffs.git_diff(str(tmp_path), "nope", "HEAD")
    (tmp_path / "x.diff").write_text(diffs.git_diff(str(tmp_path), "HEAD~1", "HEAD"))
    one = diffs.read_diff_files(spark, str(tmp_path / "x.diff"))
    both = diffs.union_bases([one, one], "two bases")
    assert diffs.parse_unified_diffs(both).count() == 2 and diffs.stats(diffs.parse_unified_diffs(both)).first()[:] == ("two bases", 1, 2)


def test_blame(spark):
    sha = "a" * 40
    text = [f"{sha} 1 5 2", "author Ann", "author-mail <ann@x>", "author-time 100", "\tcode", f"{sha} 2 6", "\tcode", f"{'b' * 40} 9 7 1", "author Bob", "author-mail <b@x>", "author-time 0", "\t" + f"{sha} 1 1 1"]
    raw = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, pos long, raw string")
    got = sorted(tuple(r) for r in records.parse_blame(raw).collect())
    assert got == [("f", 5, "Ann", "<ann@x>", 100), ("f", 6, "Ann", "<ann@x>", 100), ("f", 7, "Bob", "<b@x>", 0)]


@pytest.fixture(scope="module")
def run(spark):
    pack = [Rule("a.b", "error", 'say "<x>" & y', patterns=("p",), tags=("t",), help="h"), Rule("c", "info", "m", patterns=("q|",), match_mode="absent", paths=("*.go",)), Rule("d", "warn", "w, v", patterns=("é",))]
    rows = [("d", 0, "f<1>.py", 1, "  p  ", "added"), ("d", 1, "f<1>.py", 2, "😀é", "added"), ("d", 2, "z.py", 1, "p|", "added")]
    return pack, run_check(spark.createDataFrame(rows, LINES), pack, Plan())


def test_sinks(spark, run, tmp_path):
    from hunksieve.operators.rules import rules_table

    pack, done = run
    page = lambda df: df.first().page
    sarif = json.loads(page(encoders.sarif(done.findings)))
    assert sarif["version"] == "2.1.0" and [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["a.b", "d"]
    assert sarif["$schema"].endswith("sarif-schema-2.1.0.json") and "informationUri" not in sarif["runs"][0]["tool"]["driver"]
    assert [json.loads(r.issue) for r in encoders.gitlab(done.findings).orderBy("n").collect()] == json.loads(page(encoders.gitlab_page(done.findings)))
    assert [r["level"] for r in sarif["runs"][0]["results"]] == ["error", "warning", "error"]
    suites = ET.fromstring(page(encoders.junit(done.findings)).replace("File: f<1>.py", "").encode())
    assert (suites.get("tests"), suites.get("failures")) == ("3", "3") and [s.get("name") for s in suites] == ["a.b", "d"]
    style = ET.fromstring(page(encoders.checkstyle(done.findings)).encode())
    assert [(f.get("name"), len(f)) for f in style] == [("f<1>.py", 2), ("z.py", 1)]
    issues = [json.loads(r.issue) for r in encoders.gitlab(done.findings).orderBy("n").collect()]
    assert issues[0]["severity"] == "major" and issues[0]["location"] == {"path": "f<1>.py", "lines": {"begin": 1}} and issues[0]["content"] == {"body": "  p"}
    assert page(encoders.csv_page(done.findings)).splitlines()[1] == 'f<1>.py,1,a.b,error,"say ""<x>"" & y",  p'
    assert page(encoders.tsv_page(done.findings)).splitlines()[2] == "f<1>.py\t2\td\twarn\tw, v\t😀é"
    assert [r.row for r in encoders.annotations(done.findings).orderBy("n").collect()][1] == "::warning file=f<1>.py,line=2::d w, v"
    report = json.loads(page(encoders.sensor_report(done.summary, done.findings, rules_table(spark, pack), "t0", "t1")))
    assert report["data"]["hunksieve"] == {"suppressed_count": 0, "truncated_count": 0, "rules_matched": 2, "rules_total": 3, "tags_matched": {"t": 2}}
    assert report["findings"][0]["help"] == "h" and len(report["findings"][0]["fingerprint"]) == 64
    assert json.loads(page(encoders.rule_stats(done.rule_hits)))[0] == {"rule_id": "a.b", "total": 2, "emitted": 2, "suppressed": 0, "counts": {"info": 0, "warn": 0, "error": 2}}
    marks = [tuple(r)[2:5] for r in encoders.diagnostics(done.findings).collect()]
    assert marks == [(0, 2, 3), (1, 2, 3), (0, 0, 1)]
    classed = done.findings.withColumn("class", F.when(F.col("n") == 3, "baseline").otherwise("new"))
    marked = [r.row for r in encoders.baseline_rows(classed).orderBy("n").collect()]
    told = page(encoders.baseline_page(done.summary, classed))
    assert told.index(marked[0]) < told.index(marked[1]) < told.index(marked[2]) and told.startswith("## ")
    assert "\\[BASELINE\\]" in marked[0] and len(marked) == 3 and encoders.baseline_rows(classed, True).count() == 2


def test_pages_without_findings(spark, run):
    diffs_ = run[1].summary.withColumn("diff_id", F.lit("none"))
    found = run[1].findings
    junit = [r.page for r in encoders.junit(found, diffs_).collect()]
    assert len(junit) == 1 and 'name="no_findings"' in junit[0] and 'tests="0"' in junit[0]
    assert encoders.csv_page(found, diffs_).first().page == "file,line,rule_id,severity,message,snippet\n"
    assert len(ET.fromstring(encoders.checkstyle(found, diffs_).first().page.encode())) == 0
    (sarif,) = json.loads(encoders.sarif(found, diffs_, "https://example.org").first().page)["runs"]
    assert sarif["results"] == [] and sarif["tool"]["driver"]["informationUri"] == "https://example.org" and "rules" not in sarif["tool"]["driver"]
    assert encoders.gitlab_page(found, diffs_).first().page == "[]"
    assert "No findings." in encoders.baseline_page(diffs_, found.withColumn("class", F.lit("new"))).first().page


def test_run_sensor(spark, run):
    pack, done = run
    again, reports = run_sensor(done.lines, pack, Plan(), {"git": ("available", None)}, [("a.json", "sarif")])
    report = json.loads(reports.first().page)
    assert again.findings.count() == 3 == len(report["findings"]) and report["run"]["duration_ms"] >= 0 and report["run"]["started_at"].endswith("Z")
    assert report["run"]["capabilities"] == {"git": {"status": "available"}} and report["artifacts"] == [{"path": "a.json", "format": "sarif"}]


def test_outcomes(spark, tmp_path):
    skipped = outcomes.skip_receipt(spark, "missing_base", base="b")
    assert skipped.first().verdict.status == "skip" and skipped.first().verdict.reasons == ["missing_base"]
    failed = outcomes.tool_error_receipt(spark, "boom")
    assert failed.first().findings[0].message == "boom" and failed.first().verdict.counts.error == 1
    report = json.loads(outcomes.tool_error_report(spark, "boom", "t0", "t1").first().page)
    assert report["findings"][0]["data"] == {"error": "boom"} and len(report["findings"][0]["fingerprint"]) == 64
    assert str(outcomes.default_path("sarif")) == "artifacts/hunksieve/report.sarif.json"
    assert str(outcomes.default_path("sarif", True)) == "artifacts/hunksieve/extras/report.sarif.json"
    assert str(outcomes.default_path("gitlab", True)) == "artifacts/hunksieve/gl-code-quality-report.json"
    outcomes.write_page(failed.withColumn("page", F.lit("x")), tmp_path / "a/b.txt")
    many = spark.createDataFrame([(f"d{i}", f"page {i}\nend\n") for i in range(9)], "diff_id string, page string")
    for wrong in (many, many.limit(0)):
        with pytest.raises(ValueError, match="one page"):
            outcomes.write_page(wrong, tmp_path / "c.txt")
    for some in (many, many.where("diff_id < 'd5'")):  # the second takes the place of the first
        outcomes.write_pages(some.repartition(3), str(tmp_path / "pages"))
    assert {p.parent.name: p.read_text() for p in (tmp_path / "pages").glob("*/part-*")} == {f"diff_id=d{i}": f"page {i}\nend\n" for i in range(5)}
    with pytest.raises(Exception, match="broken"):
        outcomes.write_pages(many.withColumn("page", F.when(F.col("diff_id") == "d7", F.raise_error(F.lit("broken"))).otherwise(F.col("page"))), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*/part-*"))
    assert (tmp_path / "a/b.txt").read_text() == "x"
    schemas_ = outcomes.json_schemas()
    assert set(schemas_) == {"check", "config", "false-positive-baseline", "trend-history", "sensor"} and schemas_["check"]["properties"]["verdict"]["properties"]["reasons"]["type"] == "array"


def test_records(spark, run, tmp_path):
    _, done = run
    (tmp_path / "r.json").write_text(encoders.receipt_json(done.receipt()).first().page)
    back = records.read_receipts(spark, str(tmp_path / "r.json"))
    assert records.receipt_findings(back).drop("n").collect() == done.findings.orderBy("n").select(*encoders.FIELDS).collect()
    assert back.first().schema == CHECK_SCHEMA and records.read_baseline_receipt(spark, str(tmp_path / "r.json")).count() == 3
    with pytest.raises(records.RecordError):
        records.read_baseline_receipt(spark, str(tmp_path / "none.json"))
    assert records.read_acknowledged(spark, str(tmp_path / "none.json")).count() == 0 == records.read_history(spark, str(tmp_path / "none.json")).count()
    (tmp_path / "b.json").write_text(json.dumps({"schema": BASELINE_SCHEMA, "entries": [{"fingerprint": "f", "rule_id": "r", "path": "p", "line": 3}]}))
    assert records.read_acknowledged(spark, str(tmp_path / "b.json")).first()[:] == ("f", "r", "p", 3, None)
    (tmp_path / "b.json").write_text(json.dumps({"schema": "other", "entries": []}))
    with pytest.raises(records.RecordError):
        records.read_acknowledged(spark, str(tmp_path / "b.json"))


def test_records_elsewhere(spark, tmp_path):
    """Paths belong to Spark's file systems, not to the driver's disk."""
    (tmp_path / "b.json").write_text(json.dumps({"schema": BASELINE_SCHEMA, "entries": [{"fingerprint": "f", "rule_id": "r", "path": "p", "line": 3}]}))
    spark.conf.set("fs.viewfs.mounttable.t.link./there", f"file:{tmp_path}")
    assert records.read_acknowledged(spark, "viewfs://t/there/b.json").count() == 1
    assert records.read_acknowledged(spark, "viewfs://t/there/none.json").count() == 0
    spark.conf.set("fs.defaultFS", "viewfs://t/")
    try:
        assert records.read_acknowledged(spark, "/there/b.json").count() == 1
        outcomes.write_acknowledged(records.read_acknowledged(spark, "/there/b.json"), "/there/c.json")
        assert records.read_acknowledged(spark, "/there/c.json").count() == 1
    finally:
        spark.conf.unset("fs.defaultFS")
        spark.conf.unset("fs.viewfs.mounttable.t.link./there")
    assert records.read_acknowledged(spark, str(tmp_path / "c.json")).first()[:] == ("f", "r", "p", 3, None)


def test_record_writers(spark, run, tmp_path):
    path = str(tmp_path / "made/b.json")
    entries = history.entries_of(run[1].findings)
    outcomes.write_acknowledged(entries.limit(1).withColumn("note", F.lit("why")), path)
    outcomes.write_acknowledged(entries, path)
    got = records.read_acknowledged(spark, path).collect()
    assert len(got) == 3 and [(r.rule_id, r.path, r.line) for r in got] == sorted((r.rule_id, r.path, r.line) for r in got) and sum(r.note == "why" for r in got) == 1
    path = str(tmp_path / "h.json")
    for k in range(4):
        one = spark.createDataFrame([(0, f"s{k}", "e", 1, "b", "h", "added", "pass", (0, k, 0, 0), 1, 2, k)], TREND_RUN)
        outcomes.append_history(one, path, 3)
    runs = records.read_history(spark, path).orderBy("seq").collect()
    assert [r.started_at for r in runs] == ["s1", "s2", "s3"] and [r.counts.warn for r in runs] == [1, 2, 3]


def test_editor_texts():
    assert editor.changed_lines("a\nb\n", "a\nc\nd") == [(2, "c"), (3, "d")] and editor.changed_lines("a\nb", "a") == []
    edit = lambda *a: dict(zip(("sl", "sc", "el", "ec", "text"), a, strict=True))
    assert editor.apply_edits("a😀b\nc", [edit(0, 3, 0, 4, "X"), edit(1, 0, 9, 0, "Y")]) == "a😀X\nY"
    assert editor.apply_edits("ab", [edit(0, 2, 0, 1, "-")]) == "ab-"
    state, changed = editor.step(None, {"kind": "open", "text": "a\nb", "version": 1, "edits": None})
    state, changed = editor.step(state, {"kind": "change", "text": None, "version": 2, "edits": [edit(1, 0, 1, 1, "z")]})
    assert state == ("a\nb", "a\nz", 2) and changed == [(2, "z")]
    state, changed = editor.step(state, {"kind": "save", "text": None, "version": None, "edits": None})
    assert state == ("a\nz", "a\nz", 2) and changed == []
    assert editor.step(state, {"kind": "close", "text": None, "version": None, "edits": None}) == (None, []) == editor.step(None, {"kind": "change", "text": "x", "version": 1, "edits": None})


def test_editor_stream(spark, tmp_path):
    schema = "uri string, version int, kind string, text string, edits array<struct<sl: int, sc: int, el: int, ec: int, text: string>>, seq long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    published = {}

    def publish(rows, number):
        for r in rows.collect():
            published[r.uri] = (r.version, [(d.line, d.code) for d in r.diagnostics or []])

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        writer = editor.diagnose_batches(stream, lambda: [Rule("r", "warn", "m", patterns=("bad",))], publish)
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    feed("1", [("a.py", 1, "open", "x\ny", None, 1), ("b.py", 1, "open", "bad", None, 1)])
    assert published == {"a.py": (1, []), "b.py": (1, [])}
    feed("2", [("a.py", 2, "change", "x\nbad\nbad", None, 2)])
    assert published["a.py"] == (2, [(1, "r"), (2, "r")])
    feed("3", [("a.py", None, "save", None, None, 3), ("b.py", None, "close", None, None, 2)])
    assert published == {"a.py": (2, []), "b.py": (0, [])}


def test_editor_reload_and_replay(spark, tmp_path):
    """Changed rules reach every open document, a bad file brings the built-in ones, the diff stands in, and a batch counts once."""
    schema = "uri string, version int, kind string, text string, edits array<struct<sl: int, sc: int, el: int, ec: int, text: string>>, seq long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, state, said, word = str(tmp_path / "out"), str(tmp_path / "state"), [], ["bad"]
    diff = spark.createDataFrame([("w", 1, "c.py", 7, "worse in the diff", "added"), ("w", 2, "z.py", 1, "worse", "added")], "diff_id string, idx long, path string, line long, content string, kind string")
    batches = []

    def rules_of():
        if word[0] is None:
            raise ValueError("line 3: no value")
        return [Rule("r", "warn", "m", patterns=(word[0],))]

    def publish(rows, number):
        batches.append((number, [r.uri for r in rows.collect()]))
        editor.publish_into(out)(rows, number)

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        editor.diagnose_batches(stream, rules_of, publish, state, lambda: diff, said.append).trigger(availableNow=True).start().awaitTermination()
        return {r.uri: (r.version, [(d.line + 1, d.code) for d in r.diagnostics]) for r in editor.published(spark, out).collect()}

    feed("1", [("b.py", 1, "open", "x", None, 1), ("a.py", 1, "open", "x", None, 1), ("c.py", 1, "open", "x", None, 1), ("d.py", 1, "open", "x", None, 1)])
    got = feed("2", [("b.py", 2, "change", "worse", None, 2), ("a.py", 2, "change", "bad", None, 2), ("d.py", None, "close", None, None, 2)])
    assert got == {"a.py": (2, [(1, "r")]), "b.py": (2, []), "c.py": (1, []), "d.py": (0, [])}
    word[0] = "worse"
    got = feed("3", [("config:", None, "config", None, None, 1), ("a.py", 3, "change", "worse", None, 3)])
    assert batches[-1] == (2, ["a.py", "b.py", "c.py"])
    assert got == {"a.py": (3, [(1, "r")]), "b.py": (2, [(1, "r")]), "c.py": (1, [(7, "r")]), "d.py": (0, [])}
    word[0] = None
    got = feed("4", [("config:", None, "config", None, None, 2)])
    assert got == {"a.py": (3, []), "b.py": (2, []), "c.py": (1, []), "d.py": (0, [])} and "line 3" in said[-1]
    rows = spark.createDataFrame([("a.py", 9, [])], editor.published(spark, out).schema)
    editor.publish_into(out)(rows, 3)
    assert {r.uri: r.version for r in editor.published(spark, out).collect()} == {u: v for u, (v, _) in got.items()}
    editor.publish_into(out)(rows, 4)
    assert {r.uri: r.version for r in editor.published(spark, out).collect()}["a.py"] == 9
