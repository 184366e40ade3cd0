"""Baselines, acknowledged findings and trends: what runs say about each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from .verdict import LEVELS, level_counts

KEY = ["rule_id", "path", "line"]


def with_fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(*(F.col(c) for c in ("rule_id", "path", "line", "match_text"))))


def acknowledged(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline lists."""
    return with_fingerprints(findings).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi").drop("fingerprint")


def unacknowledged(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return with_fingerprints(findings).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti").drop("fingerprint")


def known_and_new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """`findings` with class: baseline for those whose rule, path and line the old receipt has, else new."""
    old = baseline.select(*KEY).distinct().withColumn("_old", F.lit(True))
    return findings.join(old, KEY, "left").withColumn("class", F.when(F.col("_old"), "baseline").otherwise("new")).drop("_old")


def new_counts(classed: DataFrame) -> DataFrame:
    return classed.where(F.col("class") == "new").agg(*level_counts())


def normalise_baseline(entries: DataFrame) -> DataFrame:
    """The first entry of each fingerprint by rule, path and line."""
    first = Window.partitionBy("fingerprint").orderBy("rule_id", "path", "line", F.col("note").asc_nulls_last())
    return entries.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def merge_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by fingerprint; the new entry wins, but takes what it lacks (note, rule, path, line) from the old one."""
    a, b = normalise_baseline(old).alias("a"), normalise_baseline(new).alias("b")
    pick = lambda c, empty=None: F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit(empty)) if empty is not None else F.col(f"b.{c}"), F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    return a.join(b, F.col("a.fingerprint") == F.col("b.fingerprint"), "full").select(pick("fingerprint"), pick("rule_id", ""), pick("path", ""), pick("line", 0), pick("note"))


def entries_of(findings: DataFrame) -> DataFrame:
    """Baseline entries for findings."""
    return normalise_baseline(with_fingerprints(findings).select("fingerprint", "rule_id", "path", "line", F.lit(None).cast("string").alias("note")))


def latest_runs(runs: DataFrame, most: int) -> DataFrame:
    """The newest `most` runs by seq."""
    if most < 1:
        raise ValueError("at least one run must be kept")
    return runs.orderBy(F.desc("seq")).limit(most)


def append_run(runs: DataFrame, run: DataFrame, most: int | None = None) -> DataFrame:
    last = runs.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    out = runs.unionByName(run.drop("seq").crossJoin(last).withColumn("seq", F.col("_last") + 1).drop("_last"))  # one row on either side
    return latest_runs(out, most) if most else out


def trend_totals(runs: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(F.col("counts")[c]), F.lit(0)).alias(c) for c in (*LEVELS, "suppressed")]
    return runs.agg(F.count("*").alias("run_count"), *sums, F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))


def trend_delta(runs: DataFrame) -> DataFrame:
    """The newest run less the one before it; no row for fewer than two."""
    two = latest_runs(runs, 2)
    before = Window.orderBy("seq")  # of two rows
    diff = lambda c: (c - F.lag(c).over(before))
    fields: dict[str, Column] = {c: diff(F.col("counts")[c]) for c in (*LEVELS, "suppressed")} | {"findings": diff(F.col("findings"))}
    return two.select("seq", *(v.alias(k) for k, v in fields.items())).where("findings is not null").orderBy(F.desc("seq")).limit(1)


def blame_allowed(blame: DataFrame, now: int, authors: list[str] | None = None, max_age_days: int | None = None) -> DataFrame:
    """(path, line) of blamed lines by some author (part of name or address, in any case) and not older than so many days."""
    who = F.lower(F.concat_ws(" ", "author", "author_mail"))
    cond = F.lit(True)
    if authors:
        hit = F.lit(False)
        for a in authors:
            hit = hit | F.contains(who, F.lit(a.lower()))
        cond = cond & hit
    if max_age_days is not None:
        age = F.expr(f"({int(now)} - author_time) div 86400")
        cond = cond & (F.col("author_time") > 0) & (age <= max_age_days)
    return blame.where(cond).select("path", "line").distinct()
