"""Schemas of the tables, as Spark DDL."""

RAW_DIFF = "diff_id string, pos long, raw string"
LINES = "diff_id string, idx long, path string, line long, content string, kind string"
FINDING = "rule_id string, severity string, message string, path string, line long, column long, match_text string, snippet string"
OVERRIDE = "seq int, directory string, rule_id string, enabled boolean, severity string, exclude_paths array<string>"
COUNTS = "info: long, warn: long, error: long, suppressed: long"
FP_ENTRY = "fingerprint string, rule_id string, path string, line long, note string"
TREND_RUN = f"seq long, started_at string, ended_at string, duration_ms long, base string, head string, scope string, status string, counts struct<{COUNTS}>, files_scanned long, lines_scanned long, findings long"
BLAME = "path string, line long, author string, author_mail string, author_time long"
EDITOR_EVENT = "uri string, version int, kind string, text string, edits array<struct<sl: int, sc: int, el: int, ec: int, text: string>>"
_FIELDS = FINDING.replace(" string", ": string").replace(" long", ": long")
RECEIPT = (
    "schema string, tool struct<name: string, version: string>, "
    "diff struct<base: string, head: string, context_lines: long, scope: string, files_scanned: long, lines_scanned: long>, "
    f"findings array<struct<{_FIELDS}>>, verdict struct<status: string, counts: struct<{COUNTS}>, reasons: array<string>>, "
    "timing struct<total_ms: long, diff_parse_ms: long, rule_compile_ms: long, evaluation_ms: long>"
)
