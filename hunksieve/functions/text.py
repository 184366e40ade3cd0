"""Scalar functions of findings: fingerprints, snippets, escapes, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the encoders call a severity.
VOCABULARY = {
    "annotation": {"info": "notice", "warn": "warning", "error": "error"},
    "sarif": {"info": "note", "warn": "warning", "error": "error"},
    "junit": {"info": "info", "warn": "warning", "error": "error"},
    "checkstyle": {"info": "info", "warn": "warning", "error": "error"},
    "gitlab": {"info": "info", "warn": "minor", "error": "major"},
    "editor": {"info": "3", "warn": "2", "error": "1"},
}
RANKS = {"info": 0, "warn": 1, "error": 2}


def called(severity: Column, by: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in VOCABULARY[by].items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warn", 1).otherwise(0)


def higher(a: Column, b: Column) -> Column:
    """The higher of two severities; the first if they are equal."""
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def snippet(content: Column, most: int = 240) -> Column:
    """The line without white space at its end, at most `most` code points and an ellipsis."""
    cut = F.regexp_replace(content, r"(?U)\s+\z", "")
    return F.when(F.length(cut) > most, F.concat(F.left(cut, F.lit(most)), F.lit("…"))).otherwise(cut)


def fingerprint(rule_id: Column, path: Column, line: Column, match_text: Column) -> Column:
    """SHA-256 of the four, joined by colons."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in (rule_id, path, line, match_text))), 256)


def gitlab_fingerprint(rule_id: Column, path: Column, line: Column, column: Column, match_text: Column) -> Column:
    """SHA-256 of the five without separators, the column left out if null."""
    return F.sha2(F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c in (rule_id, path, line, column, match_text))), 256)


def normal_path(path: Column) -> Column:
    """Forward slashes, no `./` or slashes in front."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A\./", ""), r"\A/+", "")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def escape_markdown(text: Column) -> Column:
    """Backslashes before the eight special characters, line ends as words."""
    out = F.regexp_replace(text, r"[|`#*_\[\]>]", r"\\$0")
    return F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def escape_xml(text: Column) -> Column:
    """The five entities; control characters that XML doesn't allow as numbers."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    bad = [*range(9), 11, 12, *range(14, 32)]
    rare = out
    for code in bad:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"&#x{code:X};"))
    return F.when(out.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), rare).otherwise(out)


def quote_csv(text: Column) -> Column:
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escape_tsv(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
