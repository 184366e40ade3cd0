"""Line sources over the test tables, for the queries; each has its SQL twin in `oracles`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import DIRECTIVE
from .operators.rules import Rule

EXTENSIONS = ("rs", "py", "js", "sql", "go", "sh", "html", "txt")
LINES_OF_A_TEXT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES of all documents: a source is a diff, a document a file whose extension goes by its id."""
    ext = F.element_at(F.array(*(F.lit(x) for x in EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("diff_id"), path.alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
    line = (F.col("at") + 1).cast("long")
    return rows.select("diff_id", (F.col("doc_id") * LINES_OF_A_TEXT + line).alias("idx"), "path", line.alias("line"), "content", F.lit("added").alias("kind"))


#: Marks around a comment that ends with its line, by extension: `//` for all others.
LINE_MARKS = {"py": ("# ", ""), "sh": ("# ", ""), "sql": ("-- ", ""), "html": ("<!-- ", " -->")}
PLAIN = "\"'`/*#\\-<$"


def by_extension(values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for ext, value in values.items():
        out = F.when(F.endswith("path", F.lit(f".{ext}")), value).otherwise(out)
    return out


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_lines as code: of five lines one is a comment, a quoted string, holds a directive for itself or the next, or is plain.

    Quotes and comment marks inside the texts become blanks, so that the masks can be told from the line's number.
    """
    lines = doc_lines(spark, sf_dir).withColumn("content", F.translate("content", PLAIN, " " * len(PLAIN)))
    mark, end = (by_extension({e: m[i] for e, m in LINE_MARKS.items()}, ("// ", "")[i]) for i in (0, 1))
    n, text = F.col("line") % 5, F.col("content")
    quote = by_extension({"sql": "'"}, '"')
    made = (
        F.when(n == 1, F.concat(mark, text, end))
        .when(n == 2, F.concat(F.lit("x = "), quote, text, quote, F.lit(";")))
        .when(n == 3, F.concat(text, F.lit(" "), mark, F.lit(f"{DIRECTIVE.upper()} ignore word.the, other"), end))
        .when(n == 4, F.concat(text, F.lit(" "), mark, F.lit(f"{DIRECTIVE} ignore-next-line"), end))
        .otherwise(text)
    )
    return lines.withColumn("content", made)


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_lines as code: of four lines a comment begins in the first, goes on in the second and ends in the third; none in Python and shell."""
    lines = doc_lines(spark, sf_dir).withColumn("content", F.translate("content", PLAIN, " " * len(PLAIN)))
    start, end = by_extension({"html": "<!--", "py": "", "sh": ""}, "/*"), by_extension({"html": "-->", "py": "", "sh": ""}, "*/")
    n, text = F.col("line") % 4, F.col("content")
    made = F.when(n == 1, F.concat(text, F.lit(" "), start, text)).when(n == 3, F.concat(text, end, F.lit(" "), text)).otherwise(text)
    return lines.withColumn("content", made)


def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_DIFF of all documents: hunks of ten lines, whose marker goes by the line's number modulo four."""
    n, path = F.col("line"), F.col("path")
    start = n.cast("string")
    row = lambda pos, raw: F.struct(pos.cast("long").alias("pos"), raw.alias("raw"))
    head = [F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path)]
    heads = [row(F.lit(i), raw) for i, raw in enumerate(head)]
    hunk = row(n * 10 - 1, F.concat(F.lit("@@ -"), start, F.lit(" +"), start, F.lit(",9 @@")))
    mark = F.element_at(F.array(F.lit(" x"), F.lit("-x"), F.lit("+x"), F.lit("+x")), (n % 4 + 1).cast("int"))
    body = row(n * 10, F.concat(mark, "content"))
    rows = F.when(n == 1, F.array(*heads, hunk, body)).when(n % 10 == 1, F.array(hunk, body)).otherwise(F.array(body))
    return doc_lines(spark, sf_dir).select(path.alias("diff_id"), F.inline(rows))


#: Header lines of a file section by the document's id modulo seven; ~ stands for the id.
SECTIONS = (
    ("diff --git a/old_~ b/new_~", "similarity index 90%", "rename from old_~", "rename to named_~.txt", "--- a/old_~", "+++ b/new_~", "@@ -1 +1,9 @@"),
    ("diff --git a/i_~.png b/i_~.png", "Binary files a/i_~.png and b/i_~.png differ", "@@ -1 +1 @@"),
    ("diff --git a/gone_~ b/gone_~", "deleted file mode 100644", "--- a/gone_~", "+++ /dev/null", "@@ -1,2 +0,0 @@"),
    ("diff --git a/mode_~ b/mode_~", "old mode 100644", "new mode 100755", "@@ -0,0 +5 @@"),
    ('diff --git "a/s p_~" "b/s p_~"', '+++ "b/caf\\303\\251_~.rs"', "@@ -0,0 +1 @@"),
    ("diff --git a/m_~ b/m_~", "+++ b/m_~", "@@ no @@", "+lost", "@@ -3 +10 @@", " kept"),
    ("diff --git a/sub_~ b/sub_~", "+++ b/sub_~", "@@ -1 +1 @@", "-Subproject commit a", "+Subproject commit b"),
)


def special_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_DIFF of all documents: a source is one diff, a document a file section with special headers, all of its lines added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("diff_id"), F.split("text", "\n").alias("lines"))
    heads = F.array(*(F.array(*(F.lit(x) for x in section)) for section in SECTIONS))
    head = F.transform(F.get(heads, (F.col("doc_id") % len(SECTIONS)).cast("int")), lambda x: F.replace(x, F.lit("~"), F.col("doc_id").cast("string")))
    rows = docs.select("diff_id", "doc_id", F.posexplode(F.concat(head, F.transform("lines", lambda x: F.concat(F.lit("+x"), x)))).alias("at", "raw"))
    return rows.select("diff_id", (F.col("doc_id") * LINES_OF_A_TEXT + F.col("at")).alias("pos"), "raw")


def pack_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each benchmark item, which looks for its first long word as the beginning of a longer one; the item is its test case."""
    n, text = F.col("item_id"), F.col("text")
    tags = F.array(F.concat(F.lit("len"), (F.length(text) % 5).cast("string")), F.when(n % 2 == 1, "Odd").otherwise("even"))
    severity = F.get(F.array(F.lit("info"), F.lit("warn"), F.lit("error")), (n % 3).cast("int"))
    pattern = F.concat(F.regexp_extract(text, "[a-z]{4,}", 0), F.lit("[a-z]+ [^a-z]"))
    cases = F.array(F.struct(text.alias("input"), F.lit(True).alias("should_match")), F.struct(F.upper(text).alias("input"), F.lit(False).alias("should_match")))
    items = table(spark, sf_dir, "benchmark")
    return items.select(n.alias("rule_idx"), F.concat(F.lit("b."), n.cast("string")).alias("id"), severity.alias("severity"), tags.alias("tags"), F.array(pattern).alias("patterns"), cases.alias("test_cases"))


#: What the queries look for. Patterns mean the same in RE2.
RULES = [
    Rule("pii.email", "warn", "address in text", patterns=(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+",), tags=("pii", "Mail"), help="remove it"),
    Rule("pii.ipv4", "info", "IP address", patterns=(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",), tags=("pii",), url="https://example.org/ip"),
    Rule("secret.token", "error", "token <in> text & more", patterns=(r"token = .[0-9a-f]{8,}", r"[0-9a-f]{24,}"), tags=("secret",)),
    Rule("text.licence", "warn", "licence, notice", patterns=(r"[Ll]icensed under", r"Released under"), tags=()),
]
WORD_RULE = Rule("word.the", "warn", "a word", patterns=(r"the",), ignore_comments=True, ignore_strings=True)
