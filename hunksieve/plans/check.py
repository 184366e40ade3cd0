"""A whole check: from scoped lines to findings, verdict and exit code."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, history, verdict
from ..operators.rules import Rule, rules_table, select_by_tags
from ..sinks import encoders
from ..sources.diffs import base_label


@dataclass(frozen=True)
class Plan:
    """What to check, and how strictly. Without a base the diffs are files, or a text, and name themselves."""

    base: str | None = "origin/main"
    head: str = "HEAD"
    scope: str = "added"
    diff_context: int = 0
    fail_on: str = "error"
    max_findings: int = 200
    path_filters: tuple[str, ...] = ()
    only_tags: tuple[str, ...] = ()
    enable_tags: tuple[str, ...] = ()
    disable_tags: tuple[str, ...] = ()
    language: str | None = None


@dataclass(frozen=True)
class Run:
    """The tables of a run, all from events that are computed once. summary has a row for each diff with a line in scope."""

    lines: DataFrame
    events: DataFrame
    findings: DataFrame
    acknowledged: DataFrame
    rule_hits: DataFrame
    summary: DataFrame

    def receipt(self) -> DataFrame:
        return encoders.receipt(self.summary, self.findings)

    def markdown(self) -> DataFrame:
        return encoders.markdown_page(self.summary, self.findings)


def run_check(lines: DataFrame, rules: list[Rule], plan: Plan | None = None, allowed: DataFrame | None = None, overrides: list[dict] | None = None, baseline: DataFrame | None = None) -> Run:
    """Filters by path and allowed lines, drops repeated lines, evaluates, caps, and takes acknowledged findings out.

    lines: LINES in scope. allowed: (path, line). baseline: FP_ENTRY; its findings leave the counts, but those that the
    cap has left out already stay in them.
    """
    plan = plan or Plan()
    lines = evaluate.filter_paths(lines, list(plan.path_filters))
    lines = evaluate.keep_allowed(lines, allowed) if allowed is not None else lines
    lines = evaluate.first_of_each(lines)
    rules = select_by_tags(rules, plan.only_tags, plan.enable_tags, plan.disable_tags)
    events = evaluate.held(evaluate.find_events(lines, rules, plan.language, overrides))
    found = evaluate.findings(events, rules, plan.max_findings)
    counts = verdict.verdict_counts(events, plan.max_findings)
    hits = verdict.rule_hits(events)
    known = found.limit(0)
    if baseline is not None:
        known, found = history.acknowledged(found, baseline), history.unacknowledged(found, baseline)
        hits = verdict.rule_hits_without(hits, known)
        off = known.groupBy("diff_id").agg(*(c.alias(f"off_{s}") for c, s in zip(verdict.level_counts(), verdict.LEVELS, strict=True)))
        counts = counts.join(off, "diff_id", "left")
        counts = counts.withColumns({s: F.greatest(F.col(s) - F.coalesce(f"off_{s}", F.lit(0)), F.lit(0)) for s in verdict.LEVELS}).drop(*(f"off_{s}" for s in verdict.LEVELS))
    summary = verdict.scanned(lines).join(counts, "diff_id", "left").fillna(0, ["info", "warn", "error", "suppressed", "truncated"])
    told = {"base": base_label(F.col("diff_id")) if plan.base is None else F.lit(plan.base), "head": F.lit(plan.head), "scope": F.lit(plan.scope), "context_lines": F.lit(plan.diff_context).cast("long")}
    summary = summary.withColumns({**told, "status": verdict.status(), "reasons": verdict.reasons(), "exit_code": verdict.exit_code(plan.fail_on)})
    return Run(lines, events, found, known, hits, summary)


def run_sensor(lines: DataFrame, rules: list[Rule], plan: Plan | None = None, capabilities: dict[str, tuple[str, str | None]] | None = None, artifacts: list[tuple[str, str]] | None = None, **how) -> tuple[Run, DataFrame]:
    """`run_check` with the sensor reports (diff_id, page) of its diffs. The time told is that of the evaluation, which ends here."""
    began = datetime.now(UTC)
    done = run_check(lines, rules, plan, **how)
    ended = datetime.now(UTC)
    took = int((ended - began).total_seconds() * 1000)
    stamp = lambda t: t.isoformat(timespec="seconds").replace("+00:00", "Z")
    return done, encoders.sensor_report(done.summary, done.findings, rules_table(lines.sparkSession, rules), stamp(began), stamp(ended), capabilities, artifacts, took)
