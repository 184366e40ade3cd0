"""Parsing of unified diffs, against a line-by-line reading and by single cases."""

import random

import pyarrow as pa
import pytest

from hunksieve import tables
from hunksieve.schemas import RAW_DIFF
from hunksieve.sources import diffs, parser

CASES = {
    "addition": ("diff --git a/a.rs b/a.rs\n--- a/a.rs\n+++ b/a.rs\n@@ -1,1 +1,2 @@\n one\n+two\n", [("a.rs", 2, "two", "added")]),
    "replacement": ("diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -5 +7 @@\n-x\n+y\n", [("a", 7, "y", "changed")]),
    "hunks": ("diff --git a/a b/a\n+++ b/a\n@@ -1 +1,2 @@\n x\n+p\n@@ -9,0 +12 @@\n+q\n", [("a", 2, "p", "added"), ("a", 12, "q", "added")]),
    "binary": ("diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\ndiff --git a/t b/t\n+++ b/t\n@@ -0,0 +1 @@\n+z\n", [("t", 1, "z", "added")]),
    "deleted": ("diff --git a/o b/o\ndeleted file mode 100644\n--- a/o\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n", []),
    "rename": ("diff --git a/old.rs b/x.rs\nrename from old.rs\nrename to new.rs\n--- a/old.rs\n+++ b/x.rs\n@@ -1 +1,2 @@\n a\n+b\n", [("new.rs", 2, "b", "added")]),
    "mode": ("diff --git a/s b/s\nold mode 100644\nnew mode 100755\ndiff --git a/t b/t\n+++ b/t\n@@ -0,0 +1 @@\n+k\n", [("t", 1, "k", "added")]),
    "submodule": ("diff --git a/m b/m\n--- a/m\n+++ b/m\n@@ -1 +1 @@\n-Subproject commit aa\n+Subproject commit bb\n+no\ndiff --git a/t b/t\n+++ b/t\n@@ -0,0 +1 @@\n+k\n", [("t", 1, "k", "added")]),
    "malformed": ("diff --git a/a b/a\n+++ b/a\n@@ nonsense @@\n+x\n@@ -1 +99999999999 @@\n+x\ndiff --git a/t b/t\n+++ b/t\n@@ -0,0 +3 @@\n+k\n", [("t", 3, "k", "added")]),
    "quoted": ('diff --git "a/sp ace.rs" "b/sp ace.rs"\n+++ "b/caf\\303\\251 \\"x\\".rs"\n@@ -0,0 +1 @@\n+v\n', [('café "x".rs', 1, "v", "added")]),
    "quoted_header": ('diff --git "a/sp ace.rs" "b/sp\\tace.rs"\n@@ -0,0 +1 @@\n+v\n', [("sp\tace.rs", 1, "v", "added")]),
    "marks": ("diff --git a/q b/q\n+++ b/q\n@@ -1,9 +1,9 @@\n---x\n+++y\n+++ b/other\n\n\\ No newline at end of file\n+z\r\n", [("other", 1, "z", "added")]),
    "no_path": ("@@ -1 +1 @@\n+lost\n", []),
    "empty": ("", []),
    "unicode": ("diff --git a/u b/u\n+++ b/u\n@@ -0,0 +1,2 @@\n+é😀\n+ü\n", [("u", 1, "é😀", "added"), ("u", 2, "ü", "added")]),
    "odd_names": ("diff --git a/x//y/./z/ b/x//y/./z/\n@@ -0,0 +1 @@\n+v\n", [("x/y/z", 1, "v", "added")]),
}


@pytest.fixture(scope="module")
def parsed(spark):
    frame = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "diff_id string, text string")
    raw = diffs.split_lines(frame, "diff_id", "text")
    return {s: diffs.parse_unified_diffs(raw, s).orderBy("diff_id", "idx").collect() for s in diffs.SCOPES}


@pytest.mark.parametrize("name", CASES)
def test_cases(parsed, name):
    assert [(r.path, r.line, r.content, r.kind) for r in parsed["added"] if r.diff_id == name] == CASES[name][1]


def test_scopes(parsed):
    deleted = [(r.diff_id, r.path, r.line, r.content, r.kind) for r in parsed["deleted"]]
    assert deleted == [("deleted", "o", 1, "a", "deleted"), ("deleted", "o", 2, "b", "deleted"), ("replacement", "a", 5, "x", "deleted")]
    assert [(r.diff_id, r.content) for r in parsed["changed"]] == [("replacement", "y")] == [(r.diff_id, r.content) for r in parsed["modified"]]


def read(text, scope):
    """The same, by one pass over the lines with the state at hand."""
    out, path, inside, removed, skip, new_name, old_no, new_no = [], None, False, False, False, None, 0, 0
    for raw in text.split("\n"):
        if raw.startswith("diff --git "):
            inside, removed, skip, new_name = False, False, False, None
            parts = raw[11:].split()
            path = parts[1].removeprefix("b/") if len(parts) > 1 else path
        elif raw.startswith("Binary files ") and " differ" in raw or raw.startswith("Subproject commit "):
            skip = True
        elif raw.startswith("deleted file mode "):
            skip = scope != "deleted"
        elif raw.startswith(("old mode ", "new mode ")):
            pass
        elif raw.startswith("rename to ") and raw[10:].strip():
            new_name = raw[10:].strip()
        elif raw.startswith("rename from ") and raw[12:].strip():
            pass
        elif raw.startswith("+++ "):
            if new_name:
                path, new_name = new_name, None
            elif raw[4:].strip() and raw[4:] != "/dev/null":
                path = raw[4:].split()[0].removeprefix("b/")
        elif raw.startswith("@@"):
            if not skip:
                try:
                    _, a, b, *_ = raw.split()
                    assert a[0] == "-" and b[0] == "+"
                    old_no, new_no, inside, removed = int(a[1:].split(",")[0]), int(b[1:].split(",")[0]), True, False
                except (ValueError, AssertionError):
                    inside = False
        elif not inside or skip or path is None or raw.startswith(("+++", "---", "\\")):
            pass
        elif raw[:1] in ("+", "-") and raw[1:].startswith("Subproject commit "):
            skip, inside = True, False
        elif raw[:1] == "+":
            if scope == "added" or scope in ("changed", "modified") and removed:
                out.append((path, new_no, raw[1:], "changed" if removed else "added"))
            new_no += 1
        elif raw[:1] == "-":
            if scope == "deleted":
                out.append((path, old_no, raw[1:], "deleted"))
            removed, old_no = True, old_no + 1
        elif raw[:1] == " ":
            removed, old_no, new_no = False, old_no + 1, new_no + 1
    return out


POOL = ["diff --git a/f{} b/f{}", "diff --git a/f{}", "Binary files a and b differ", "Subproject commit x", "deleted file mode 1", "old mode 1", "rename to r{}", "rename to ", "rename from q", "+++ b/p{}", "+++ /dev/null", "+++ ", "@@ -{} +{} @@ x", "@@ -{},3 +{},4 @@", "@@ bad", "@@ -x +1 @@", "+++more", "---", "\\ No newline", "+add {}", "-del {}", " ctx", "+Subproject commit y", "", "junk", "+", "-"]
WEIGHTS = [6, 1, 1, 1, 1, 1, 1, 1, 1, 6, 1, 1, 8, 8, 1, 1, 1, 1, 1, 25, 18, 18, 1, 1, 1, 2, 2]


def random_lines(rng, n):
    return [x.replace("{}", str(rng.randrange(1, 9))) for x in rng.choices(POOL, WEIGHTS, k=n)]


@pytest.mark.parametrize("bits", [diffs.BLOCK_BITS, 2, 0])
def test_random(spark, bits):
    """Diffs in blocks of any size, down to single lines."""
    rng = random.Random(1)
    texts = [(str(i), "\n".join(random_lines(rng, rng.choice([5, 30, 60])))) for i in range(200)]
    raw = diffs.split_lines(spark.createDataFrame(texts, "diff_id string, text string"), "diff_id", "text")
    for scope in diffs.SCOPES:
        got: dict = {}
        for r in diffs.parse_unified_diffs(raw, scope, bits).orderBy("diff_id", "idx").collect():
            got.setdefault(r.diff_id, []).append((r.path, r.line, r.content, r.kind))
        for i, t in texts:
            assert got.get(i, []) == read(t, scope), (scope, t)


def test_cut_at_every_line():
    """What lies before a cut as a map, composed with what lies behind, gives the rows and the state of the whole."""
    rng = random.Random(3)
    for _ in range(60):
        lines = random_lines(rng, rng.choice([3, 8, 30]))
        for scope in ("added", "changed", "deleted"):
            gone = scope == "deleted"
            whole, end = parser.parse_lines(lines, scope)
            assert [r[1:] for r in whole] == read("\n".join(lines), scope)
            for cut in range(len(lines) + 1):
                before, behind = parser.map_lines(lines[:cut], gone), parser.map_lines(lines[cut:], gone)
                state = before[parser.START.kind()].after(parser.START)
                first, same = parser.parse_lines(lines[:cut], scope)
                more, done = parser.parse_lines(lines[cut:], scope, state)
                assert same == state and done == end and first + [(i + cut, *r) for i, *r in more] == whole
                assert parser.then(before, behind) == parser.map_lines(lines, gone)
                assert parser.unpacked(parser.packed(before)) == before


def test_no_diff_is_one_task(spark):
    """A diff of many blocks is dealt over many tasks."""
    raw = spark.range(64).selectExpr("'d' AS diff_id", "id AS pos", "'+x' AS raw")
    rows = diffs.parse_unified_diffs(spark.createDataFrame([("d", -2, "+++ b/f"), ("d", -1, "@@ -1 +1 @@")], raw.schema).unionByName(raw).selectExpr("diff_id", "pos + 2 AS pos", "raw"), bits=1)
    assert [r.line for r in rows.orderBy("idx").collect()] == list(range(1, 65))
    assert "Window" not in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("scope", diffs.SCOPES)
def test_block_goes_on_in_a_batch_where_others_begin(scope):
    whole = ["diff --git a/a b/a", "+++ b/a", "@@ -3 +5 @@", "-x", "+y", "+z", "-w", "+v"]
    rows = [("a", 0, i, raw, None) for i, raw in enumerate(whole)] + [("b", 0, i, raw.replace("/a", "/b"), None) for i, raw in enumerate(whole)]
    schema = pa.schema([("diff_id", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("raw", pa.string()), ("map", pa.string())])
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    told = lambda size: [tuple(r.values()) for b in parser.emit(scope)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    expected = [(d, i, d, n, content, kind) for d in "ab" for i, _, n, content, kind in parser.parse_lines(whole, scope)[0]]
    for size in range(1, len(rows) + 1):
        assert told(size) == expected


def test_table_function_takes_batches(spark):
    """Partitions that begin and end inside batches of a few lines, and go on over several."""
    whole = ["diff --git a/a b/a", "+++ b/a", "@@ -3 +5 @@", "-x", "+y", None, "+z", "-w", "+v"]
    rows = [(d, i, raw and raw.replace("/a", f"/{d}")) for d in "abc" for i, raw in enumerate(whole)]
    spark.udtf.register("parse_few", diffs.sql_parser("modified"))
    spark.createDataFrame(rows, RAW_DIFF).createOrReplaceTempView("few_lines")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = spark.sql("SELECT * FROM parse_few(TABLE(few_lines) PARTITION BY diff_id ORDER BY pos)")
        assert "ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString()
        expected = [(d, i, d, n, content, kind) for d in "abc" for i, _, n, content, kind in parser.parse_lines([x or "" for x in whole], "modified")[0]]
        assert sorted((r.diff_id, r.idx, r.path, r.line, r.content, r.kind) for r in found.collect()) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_documents_are_read_once_for_a_diff(spark):
    plan = tables.diff_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
