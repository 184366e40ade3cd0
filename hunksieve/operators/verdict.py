"""Counts, hits and verdicts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("info", "warn", "error")


def level_counts(live: Column | None = None) -> list[Column]:
    live = F.lit(True) if live is None else live
    return [F.count_if((F.col("severity") == s) & live).alias(s) for s in LEVELS]


def verdict_counts(events: DataFrame, most: int = 200) -> DataFrame:
    """info, warn, error of all unsuppressed events of a diff, suppressed ones, and how many the cap leaves out."""
    live = ~F.col("suppressed")
    dropped = F.greatest(F.count_if(live) - most, F.lit(0)).alias("truncated")
    return events.groupBy("diff_id").agg(*level_counts(live), F.count_if("suppressed").alias("suppressed"), dropped)


def rule_hits(events: DataFrame) -> DataFrame:
    """Per rule with an event: total, emitted, suppressed, and emitted ones by severity."""
    live = ~F.col("suppressed")
    return events.groupBy("diff_id", "rule_id").agg(F.count("*").alias("total"), F.count_if(live).alias("emitted"), F.count_if("suppressed").alias("suppressed"), *level_counts(live))


def rule_hits_without(hits: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Rule hits less the acknowledged findings (diff_id, rule_id, severity), which are counted as false_positive."""
    off = acknowledged.groupBy("diff_id", "rule_id").agg(F.count("*").alias("false_positive"), *(c.alias(f"off_{s}") for c, s in zip(level_counts(), LEVELS, strict=True)))
    out = hits.join(off, ["diff_id", "rule_id"], "left")
    less = lambda a, b: F.greatest(F.col(a) - F.coalesce(b, F.lit(0)), F.lit(0)).alias(a)
    return out.select("diff_id", "rule_id", "total", less("emitted", "false_positive"), "suppressed", *(less(s, f"off_{s}") for s in LEVELS), F.coalesce("false_positive", F.lit(0)).alias("false_positive"))


def scanned(lines: DataFrame) -> DataFrame:
    return lines.groupBy("diff_id").agg(F.count_distinct("path").alias("files_scanned"), F.count("*").alias("lines_scanned"))


def status() -> Column:
    return F.when(F.col("error") > 0, "fail").when(F.col("warn") > 0, "warn").otherwise("pass")


def reasons() -> Column:
    return F.array_compact(F.array(F.when(F.col("truncated") > 0, "truncated")))


def exit_code(fail_on: Column | str) -> Column:
    """0 if nothing may fail; 2 for errors; 3 for warnings where they fail; else 0."""
    fail_on = F.lit(fail_on) if isinstance(fail_on, str) else fail_on
    return F.when(fail_on == "never", 0).when(F.col("error") > 0, 2).when((F.col("warn") > 0) & (fail_on == "warn"), 3).otherwise(0)


def baseline_exit_code(fail_on: Column | str) -> Column:
    """By new findings alone: 2 for new errors, whatever may fail; 3 for new warnings where they fail; else 0."""
    fail_on = F.lit(fail_on) if isinstance(fail_on, str) else fail_on
    return F.when(F.col("error") > 0, 2).when((F.col("warn") > 0) & (fail_on == "warn"), 3).otherwise(0)


def rules_matched(findings: DataFrame) -> DataFrame:
    return findings.groupBy("diff_id").agg(F.count_distinct("rule_id").alias("rules_matched"))


def tags_matched(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of each tag, for tags with any. rules: (id, tags)."""
    tags = rules.select(F.col("id").alias("rule_id"), F.explode("tags").alias("tag"))
    return findings.groupBy("diff_id", "rule_id").agg(F.count("*").alias("n")).join(tags, "rule_id").groupBy("diff_id", "tag").agg(F.sum("n").alias("findings"))
