"""Findings in the formats that other tools read. Rows are made by expressions; a page is joined from its rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHECK_SCHEMA, SENSOR_SCHEMA, TOOL, VERSION
from ..functions.text import called, escape_markdown, escape_tsv, escape_xml, fingerprint, gitlab_fingerprint, quote_csv

FIELDS = ["rule_id", "severity", "message", "path", "line", "column", "match_text", "snippet"]
CSV_COLUMNS = ["path", "line", "rule_id", "severity", "message", "snippet"]
#: Fixed value: the column names of CSV and TSV files.
CSV_HEADER = ["file", "line", "rule_id", "severity", "message", "snippet"]
#: Reasons that a summary names.
META_REASONS = ("truncated", "missing_base", "no_diff_input", "git_unavailable", "tool_error")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def page(rows: DataFrame, line: str, order: str, header: str = "", footer: str = "", diffs: DataFrame | None = None, empty: str = "") -> DataFrame:
    """(diff_id, page): the column `line` of each diff's rows in order. Rows are capped before, so a page is small.

    diffs: (diff_id) of all diffs, so that those without rows get a page as well, with `empty` for its rows.
    """
    rows = rows.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "").alias("page"))
    rows = diffs.select("diff_id").distinct().join(rows, "diff_id", "left") if diffs is not None else rows
    return rows.select("diff_id", F.concat(F.lit(header), F.coalesce("page", F.lit(empty)), F.lit(footer)).alias("page"))


def csv_rows(findings: DataFrame) -> DataFrame:
    line = _text(*[x for c in CSV_COLUMNS for x in (",", quote_csv(F.col(c).cast("string")))][1:], "\n")
    return findings.select("diff_id", "n", line.alias("row"))


def tsv_rows(findings: DataFrame) -> DataFrame:
    line = _text(*[x for c in CSV_COLUMNS for x in ("\t", escape_tsv(F.col(c).cast("string")))][1:], "\n")
    return findings.select("diff_id", "n", line.alias("row"))


def csv_page(findings: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    return page(csv_rows(findings), "row", "n", ",".join(CSV_HEADER) + "\n", diffs=diffs)


def tsv_page(findings: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    return page(tsv_rows(findings), "row", "n", "\t".join(CSV_HEADER) + "\n", diffs=diffs)


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, nothing escaped."""
    row = _text("::", called(F.col("severity"), "annotation"), " file=", F.col("path"), ",line=", F.col("line"), "::", F.col("rule_id"), " ", F.col("message"))
    return findings.select("diff_id", "n", row.alias("row"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    cells = (F.col("severity"), escape_markdown(F.col("rule_id")), _text(escape_markdown(F.col("path")), ":", F.col("line")), escape_markdown(F.col("message")), escape_markdown(F.col("snippet")))
    row = _text("| ", cells[0], " | `", cells[1], "` | `", cells[2], "` | ", cells[3], " | `", cells[4], "` |\n")
    return findings.select("diff_id", "n", row.alias("row"))


MARKDOWN_TABLE = "| Severity | Rule | Location | Message | Snippet |\n|---|---|---|---|---|\n"


def markdown_page(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """One summary page a diff. summary: diff_id, scope, base, head, status, counts by severity, suppressed, reasons, files and lines scanned."""
    return _markdown(summary, markdown_rows(findings))


def _markdown(summary: DataFrame, rows: DataFrame) -> DataFrame:
    rows = page(rows, "row", "n", MARKDOWN_TABLE, "\n")
    said = F.filter("reasons", lambda x: x.isin(*META_REASONS))
    head = _text("## ", TOOL, " — ", F.upper("status"), "\n\nScanned **", F.col("files_scanned"), "** file(s), **", F.col("lines_scanned"), "** line(s) (scope: `", F.col("scope"), "`, base: `", F.col("base"), "`, head: `", F.col("head"), "`)\n\n")
    why = F.when(F.size(said) > 0, _text("**Verdict reasons:**\n", F.array_join(F.transform(said, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), "\n")).otherwise("")
    off = F.when(F.col("suppressed") > 0, _text("**Note:** ", F.col("suppressed"), " finding(s) suppressed via inline directives.\n\n")).otherwise("")
    return summary.join(rows, "diff_id", "left").select("diff_id", F.concat(head, why, off, F.coalesce("page", F.lit("No findings.\n"))).alias("page"))


def baseline_rows(classed: DataFrame, new_only: bool = False) -> DataFrame:
    """Markdown rows marked as old or new, old ones first."""
    old = F.col("class") == "baseline"
    rows = classed.where(~old) if new_only else classed
    order = Window.partitionBy("diff_id").orderBy("class", "n")
    marked = rows.withColumn("message", F.concat(F.when(old, "[BASELINE] ").otherwise("[NEW] "), "message")).withColumn("n", F.row_number().over(order))
    return markdown_rows(marked)


def baseline_page(summary: DataFrame, classed: DataFrame, new_only: bool = False) -> DataFrame:
    """The summary page of `markdown_page` with `baseline_rows`, and what was known before told from what is new."""
    return _markdown(summary, baseline_rows(classed, new_only))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Rules of the findings by id, each as its first finding has it."""
    first = F.min_by(F.struct("message", "severity"), "n")
    out = findings.groupBy("diff_id", "rule_id").agg(first.alias("x"))
    return out.select("diff_id", "rule_id", escape_xml(F.col("x.message")).alias("text"), called(F.col("x.severity"), "sarif").alias("level"))


def sarif_results(findings: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "rule_id", "path", F.col("line").cast("string"))
    return findings.select("diff_id", "n", F.col("rule_id").alias("ruleId"), called(F.col("severity"), "sarif").alias("level"), escape_xml(F.col("message")).alias("text"), escape_xml(F.col("path")).alias("uri"), F.col("line").alias("startLine"), F.col("column").alias("startColumn"), escape_xml(F.col("snippet")).alias("snippet"), key.alias("fingerprint"))


#: Fixed value: where the schema of SARIF 2.1.0 lies.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def sarif(findings: DataFrame, diffs: DataFrame | None = None, information_uri: str | None = None) -> DataFrame:
    """(diff_id, page): SARIF 2.1.0. diffs: (diff_id) of all diffs, so that those without findings get a page as well."""
    rules = sarif_rules(findings).groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct("text").alias("shortDescription"), F.struct("level").alias("defaultConfiguration")))).alias("rules"))
    place = F.struct(F.struct(F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct("startLine", "startColumn", F.struct(F.col("snippet").alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"))
    one = F.struct("n", F.struct("ruleId", "level", F.struct("text").alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints")).alias("r"))
    results = sarif_results(findings).groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("results"))
    rows = rules.join(results, "diff_id")
    rows = diffs.select("diff_id").distinct().join(rows, "diff_id", "left") if diffs is not None else rows
    uri = [F.lit(information_uri).alias("informationUri")] if information_uri else []
    tool = F.struct(F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), *uri, "rules").alias("driver"))
    none = F.array().cast(results.schema["results"].dataType)
    run = F.struct(tool.alias("tool"), F.coalesce("results", none).alias("results"))
    doc = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rows.select("diff_id", F.to_json(doc).alias("page"))


def junit_suites(findings: DataFrame) -> DataFrame:
    """(diff_id, rule_id, tests, failures, cases): suites by rule; warnings and errors fail. The failure's body is not escaped."""
    fails = F.col("severity") != "info"
    kind = F.when(F.col("severity") == "error", "error").otherwise("warning")
    name = escape_xml(_text(F.col("path"), ":", F.col("line")))
    body = _text('      <failure type="', kind, '" message="', escape_xml(F.col("message")), '">\n', "Rule: ", F.col("rule_id"), "\nFile: ", F.col("path"), "\nLine: ", F.col("line"), "\nSnippet: ", F.col("snippet"), "\n      </failure>\n")
    case = _text('    <testcase classname="', escape_xml(F.col("path")), '" name="', name, '">\n', F.when(fails, body).otherwise(""), "    </testcase>\n")
    rows = findings.withColumn("case", case).groupBy("diff_id", "rule_id")
    cases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "case"))), lambda x: x["case"]), "")
    return rows.agg(F.count("*").alias("tests"), F.count_if(fails).alias("failures"), cases.alias("cases"))


def junit(findings: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    suite = _text('  <testsuite name="', escape_xml(F.col("rule_id")), '" tests="', F.col("tests"), '" failures="', F.col("failures"), '" errors="0">\n', F.col("cases"), "  </testsuite>\n")
    rows = junit_suites(findings).withColumn("row", suite)
    totals = rows.groupBy("diff_id").agg(F.sum("tests").alias("tests"), F.sum("failures").alias("failures"))
    count = lambda c: F.coalesce(c, F.lit(0))
    head = _text('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="', TOOL, '" tests="', count("tests"), '" failures="', count("failures"), '" errors="0">\n')
    none = f'  <testsuite name="{TOOL}" tests="1" failures="0" errors="0">\n    <testcase classname="{TOOL}" name="no_findings">\n    </testcase>\n  </testsuite>\n'
    pages = page(rows, "row", "rule_id", diffs=diffs, empty=none)
    return pages.join(totals, "diff_id", "left").select("diff_id", F.concat(head, "page", F.lit("</testsuites>\n")).alias("page"))


def checkstyle_files(findings: DataFrame) -> DataFrame:
    """(diff_id, path, errors, elements): error elements by file."""
    column = F.when(F.col("column").isNotNull(), _text(' column="', F.col("column"), '"')).otherwise("")
    element = _text('    <error line="', F.col("line"), '"', column, ' severity="', called(F.col("severity"), "checkstyle"), '" message="', escape_xml(F.col("message")), '" source="', escape_xml(F.col("rule_id")), '"/>\n')
    elements = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "element"))), lambda x: x["element"]), "")
    return findings.withColumn("element", element).groupBy("diff_id", "path").agg(F.count("*").alias("errors"), elements.alias("elements"))


def checkstyle(findings: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    row = _text('  <file name="', escape_xml(F.col("path")), '">\n', F.col("elements"), "  </file>\n")
    return page(checkstyle_files(findings).withColumn("row", row), "row", "path", '<?xml version="1.0" encoding="UTF-8"?>\n<checkstyle version="5.0">\n', "</checkstyle>\n", diffs)


def gitlab(findings: DataFrame) -> DataFrame:
    """(diff_id, n, fingerprint, issue): Code Quality issues as JSON."""
    mark = gitlab_fingerprint(*(F.col(c) for c in ("rule_id", "path", "line", "column", "match_text")))
    content = F.when(F.col("snippet") != "", F.struct(F.col("snippet").alias("body")))
    place = F.struct("path", F.struct(F.col("line").alias("begin")).alias("lines"))
    issue = F.struct(F.col("message").alias("description"), F.col("rule_id").alias("check_name"), mark.alias("fingerprint"), called(F.col("severity"), "gitlab").alias("severity"), place.alias("location"), content.alias("content"))
    return findings.select("diff_id", "n", mark.alias("fingerprint"), F.to_json(issue).alias("issue"))


def gitlab_page(findings: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """(diff_id, page): the issues as one JSON array."""
    line = F.concat(F.when(F.col("n") > F.min("n").over(Window.partitionBy("diff_id")), ",\n").otherwise(""), "issue")
    return page(gitlab(findings).withColumn("line", line), "line", "n", "[", "]", diffs)


def rule_stats(hits: DataFrame) -> DataFrame:
    """(diff_id, page): rule hits as JSON."""
    row = F.struct("rule_id", "total", "emitted", "suppressed", *(["false_positive"] if "false_positive" in hits.columns else []), F.struct("info", "warn", "error").alias("counts"))
    return hits.groupBy("diff_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("page"))


def sensor_findings(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with fingerprint, and help and url of their rules (id, help, url)."""
    meta = rules.select(F.col("id").alias("rule_id"), "help", "url")
    mark = fingerprint(*(F.col(c) for c in ("rule_id", "path", "line", "match_text")))
    return findings.join(meta, "rule_id", "left").select("diff_id", "n", F.lit(f"{TOOL}.pattern").alias("check_id"), F.col("rule_id").alias("code"), "severity", "message", "path", "line", "column", mark.alias("fingerprint"), "help", "url", "match_text", "snippet")


def receipt(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of RECEIPT a diff."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*FIELDS).alias("f")))), lambda x: x["f"])
    rows = summary.join(findings.groupBy("diff_id").agg(own.alias("findings")), "diff_id", "left")
    none = F.array().cast(findings.limit(0).groupBy().agg(F.collect_list(F.struct(*FIELDS)).alias("x")).schema["x"].dataType)
    diff = F.struct("base", "head", "context_lines", "scope", "files_scanned", "lines_scanned")
    counts = F.struct("info", "warn", "error", F.when(F.col("suppressed") > 0, F.col("suppressed")).alias("suppressed"))
    return rows.select("diff_id", F.lit(CHECK_SCHEMA).alias("schema"), F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version")).alias("tool"), diff.alias("diff"), F.coalesce("findings", none).alias("findings"), F.struct("status", counts.alias("counts"), "reasons").alias("verdict"))


def receipt_json(receipts: DataFrame) -> DataFrame:
    return receipts.select("diff_id", F.to_json(F.struct("schema", "tool", "diff", "findings", "verdict"), {"pretty": "true"}).alias("page"))


def sensor_report(summary: DataFrame, findings: DataFrame, rules: DataFrame, started_at: str, ended_at: str, capabilities: dict[str, tuple[str, str | None]] | None = None, artifacts: list[tuple[str, str]] | None = None, duration_ms: int | None = None) -> DataFrame:
    """(diff_id, page): the envelope for dashboards, with matched rules and tags and what the cap left out.

    capabilities: status and reason by name; artifacts: path and format.
    """
    from ..operators.verdict import rules_matched, tags_matched

    rows = sensor_findings(findings, rules)
    fields = F.struct("check_id", "code", "severity", "message", F.struct("path", "line", "column").alias("location"), "fingerprint", "help", "url", F.struct("match_text", "snippet").alias("data"))
    listed = rows.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", fields.alias("f")))), lambda x: x["f"]).alias("findings"))
    tags = tags_matched(findings, rules).groupBy("diff_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "findings")))).alias("tags_matched"))
    out = summary.join(listed, "diff_id", "left").join(rules_matched(findings), "diff_id", "left").join(tags, "diff_id", "left")
    diff = F.struct("base", "head", "context_lines", "scope", "files_scanned", "lines_scanned")
    own = F.struct(F.col("suppressed").alias("suppressed_count"), F.col("truncated").alias("truncated_count"), F.coalesce("rules_matched", F.lit(0)).alias("rules_matched"), F.lit(rules.count()).alias("rules_total"), "tags_matched")
    able = [x for k, (status, why) in (capabilities or {}).items() for x in (F.lit(k), F.struct(F.lit(status).alias("status"), F.lit(why).alias("reason")))]
    run = F.struct(F.lit(started_at).alias("started_at"), F.lit(ended_at).alias("ended_at"), *([F.lit(duration_ms).alias("duration_ms")] if duration_ms is not None else []), *([F.create_map(*able).alias("capabilities")] if able else []))
    files = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(kind).alias("format")) for p, kind in artifacts or [])).alias("artifacts")
    verdict = F.struct("status", F.struct("info", "warn", "error").alias("counts"), "reasons")
    data = F.struct(diff.alias("diff"), own.alias(TOOL))
    doc = F.struct(F.lit(SENSOR_SCHEMA).alias("schema"), F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version")).alias("tool"), run.alias("run"), verdict.alias("verdict"), "findings", *([files] if artifacts else []), data.alias("data"))
    return out.select("diff_id", F.to_json(doc).alias("page"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Editor diagnostics: lines and UTF-16 columns from 0, in order of place and message."""
    from ..functions.text import utf16_length

    head = F.substr(F.col("snippet"), F.lit(1), F.coalesce(F.col("column") - 1, F.lit(0)).cast("int"))
    start = F.coalesce(utf16_length(head), F.lit(0))
    end = start + F.greatest(utf16_length(F.col("match_text")), F.lit(1))
    out = findings.select("diff_id", "path", (F.greatest(F.col("line"), F.lit(1)) - 1).alias("line"), start.alias("start_char"), F.when(F.col("column").isNull(), 1).otherwise(end).alias("end_char"), called(F.col("severity"), "editor").cast("int").alias("severity"), F.col("rule_id").alias("code"), "message")
    return out.orderBy("path", "line", "start_char", "message")
