"""Rules as data: their fields, merging, selection, validation and self-tests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import FLAGS, PatternError, check_pattern, glob_regex, java_pattern


class RuleError(ValueError):
    """A set of rules that can't be used."""


@dataclass(frozen=True)
class TestCase:
    """An input that a rule should or shouldn't match; matched as it stands, whatever else the case says."""

    __test__ = False  # not a case for pytest

    input: str
    should_match: bool
    ignore_comments: bool | None = None
    ignore_strings: bool | None = None
    language: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str = "error"
    message: str = ""
    description: str = ""
    languages: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    ignore_comments: bool = False
    ignore_strings: bool = False
    match_mode: str = "any"
    multiline: bool = False
    multiline_window: int | None = None
    context_patterns: tuple[str, ...] = ()
    context_window: int | None = None
    escalate_patterns: tuple[str, ...] = ()
    escalate_window: int | None = None
    escalate_to: str | None = None
    depends_on: tuple[str, ...] = ()
    help: str | None = None
    url: str | None = None
    tags: tuple[str, ...] = ()
    test_cases: tuple[TestCase, ...] = field(default=())

    @classmethod
    def of(cls, data: dict) -> Rule:
        """A rule of a configuration table; unknown keys are an error."""
        known = {f.name for f in fields(cls)}
        if unknown := data.keys() - known:
            raise RuleError(f"rule {data.get('id')}: unknown fields {sorted(unknown)}")
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
        values["test_cases"] = tuple(TestCase(**x) for x in data.get("test_cases", ()))
        return cls(**values)

    @property
    def window(self) -> int:
        """Lines that a multi-line rule joins."""
        return max(2, 2 if self.multiline_window is None else self.multiline_window)

    @property
    def context(self) -> int:
        return 3 if self.context_window is None else self.context_window

    @property
    def escalation(self) -> int:
        return self.escalate_window or 0


def merge(base: Iterable[Rule], own: Iterable[Rule]) -> list[Rule]:
    """Both sets by id, where the later rule wins, in order of id."""
    merged = {r.id: r for r in (*base, *own)}
    return [merged[k] for k in sorted(merged)]


def merge_tables(base: DataFrame, own: DataFrame) -> DataFrame:
    """The same for rules that are rows: those of `base` whose ids `own` lacks, and those of `own`. Ids are unique in each."""
    return base.join(own.select("id"), "id", "left_anti").select(*base.columns).unionByName(own)


def lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def select_by_tags(rules: list[Rule], only: Iterable[str] = (), enable: Iterable[str] = (), disable: Iterable[str] = ()) -> list[Rule]:
    """Rules with a tag of `only` or `enable` (all, if `only` is empty) and none of `disable`; tags in any case."""
    only, enable, disable = ({lower(t) for t in x} for x in (only, enable, disable))
    tags = lambda r: {lower(t) for t in r.tags}
    return [r for r in rules if (not only or tags(r) & (only | enable)) and not tags(r) & disable]


def tag_condition(tags: Column, only: Iterable[str] = (), enable: Iterable[str] = (), disable: Iterable[str] = ()) -> Column:
    """The same as a condition on an array column."""
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    among = lambda names: F.arrays_overlap(own, F.array(*(F.lit(lower(n)) for n in names))) if names else F.lit(False)
    only, enable, disable = list(only), list(enable), list(disable)
    return (among(only + enable) if only else F.lit(True)) & ~among(disable)


def closure(rules: list[Rule]) -> dict[str, set[str]]:
    """For each rule the rules that must have matched in a file for it to count there: all that it depends on, in turn."""
    deps = {r.id: set(r.depends_on) for r in rules}
    for r in rules:
        for d in r.depends_on:
            if d not in deps:
                raise RuleError(f"rule {r.id} depends on {d}, which isn't there")
    out = {}
    for r in rules:
        seen, left = set(), [*deps[r.id]]
        while left:
            if (d := left.pop()) not in seen:
                seen.add(d)
                left += deps[d]
        out[r.id] = seen - {r.id}
    return out


def check(rules: list[Rule], spark: SparkSession | None = None) -> None:
    """Raises for what no run can use: missing patterns, bad patterns or globs, unknown dependencies. With a session patterns are compiled."""
    for r in rules:
        if not r.patterns:
            raise RuleError(f"rule {r.id} has no patterns")
        try:
            for p in (*r.patterns, *r.context_patterns, *r.escalate_patterns):
                java_pattern(p)
                if spark is not None and (wrong := check_pattern(spark, p)):
                    raise PatternError(f"pattern {p!r}: {wrong}")
            for g in (*r.paths, *r.exclude_paths):
                glob_regex(g)
        except PatternError as e:
            raise RuleError(f"rule {r.id}: {e}") from e
    closure(rules)


def validate(spark: SparkSession, rules: list[Rule], strict: bool = False) -> list[tuple[str, str, str]]:
    """(rule id, error or warning, text) of all that is wrong with a set of rules."""
    out = [(k, "error", f"id is used {n} times") for k, n in Counter(r.id for r in rules).items() if n > 1]
    ids = {r.id for r in rules}
    for r in rules:
        if not r.patterns:
            out.append((r.id, "error", "no patterns"))
        for p in (*r.patterns, *r.context_patterns, *r.escalate_patterns):
            if wrong := check_pattern(spark, p):
                out.append((r.id, "error", f"pattern {p!r}: {wrong}"))
        for g in (*r.paths, *r.exclude_paths):
            try:
                glob_regex(g)
            except PatternError as e:
                out.append((r.id, "error", str(e)))
        if r.multiline and r.multiline_window is not None and r.multiline_window < 2:
            out.append((r.id, "error", "multiline_window is below 2"))
        out += [(r.id, "error", f"unknown dependency {d}") for d in r.depends_on if d not in ids]
        if strict:
            for missing, text in ((not r.message.strip(), "no message"), (not r.description, "no description"), (not r.help, "no help"), (not r.paths and not r.languages, "applies to all files")):
                if missing:
                    out.append((r.id, "warning", text))
    return out


FIELDS = {"rule_idx": "int"} | {f.name: "string" for f in fields(Rule)}
FIELDS |= dict.fromkeys(("languages", "patterns", "paths", "exclude_paths", "context_patterns", "escalate_patterns", "depends_on", "tags"), "array<string>")
FIELDS |= dict.fromkeys(("ignore_comments", "ignore_strings", "multiline"), "boolean") | dict.fromkeys(("multiline_window", "context_window", "escalate_window"), "int")
FIELDS["test_cases"] = "array<struct<input: string, should_match: boolean, ignore_comments: boolean, ignore_strings: boolean, language: string, description: string>>"
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows, in order."""
    rows = [(i, *(asdict(r)[f.name] for f in fields(Rule))) for i, r in enumerate(rules)]
    rows = [tuple([tuple(c.values()) for c in v] if k == "test_cases" else v for k, v in zip(FIELDS, row, strict=True)) for row in rows]
    return spark.createDataFrame(rows, SCHEMA)


def self_test(spark: SparkSession, rules: list[Rule], id_prefix: str = "") -> DataFrame:
    """(rule_id, case, should_match, matched, passed) of each test case of the rules whose ids start so."""
    cases = rules_table(spark, [r for r in rules if r.test_cases]).where(F.startswith("id", F.lit(id_prefix)))
    cases = cases.select("id", F.posexplode("test_cases").alias("case", "c"))
    matched = F.lit(False)
    for r in rules:
        if r.test_cases:
            hit = F.lit(False)
            for p in r.patterns:
                hit = hit | F.col("c.input").rlike(FLAGS + java_pattern(p))
            matched = F.when(F.col("id") == r.id, hit).otherwise(matched)
    out = cases.select(F.col("id").alias("rule_id"), "case", F.col("c.should_match").alias("should_match"), matched.alias("matched"))
    return out.withColumn("passed", F.col("should_match") == F.col("matched"))


def self_test_totals(results: DataFrame) -> DataFrame:
    """(passed, failed): how many cases of `self_test` went each way; one row, of zeros without cases."""
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def suggest(rules: DataFrame, wanted: str, most: int = 5) -> DataFrame:
    """The ids of `rules` (rule_idx, id) nearest to a mistyped one: by beginning, inclusion, or up to three edits."""
    a, b = F.lower("id"), F.lit(wanted.lower())
    distance = F.levenshtein(a, b)
    score = F.when(F.startswith(a, b) | F.startswith(b, a), 0).when(F.contains(a, b) | F.contains(b, a), 1).when(distance <= 3, distance + 2)
    return rules.select("rule_idx", "id", score.alias("score")).where("score is not null").orderBy("score", "rule_idx").limit(most)


def explain(rule: Rule) -> str:
    """A rule in words."""
    lines = [f"Rule: {rule.id}", f"Severity: {rule.severity}", f"Message: {rule.message}"]
    for name in ("description", "languages", "patterns", "paths", "exclude_paths", "context_patterns", "escalate_patterns", "depends_on", "tags", "help", "url"):
        value = getattr(rule, name)
        if value:
            lines.append(f"{name.replace('_', ' ').capitalize()}: {', '.join(value) if isinstance(value, tuple) else value}")
    return "\n".join([*lines, f"Ignores comments: {rule.ignore_comments}", f"Ignores strings: {rule.ignore_strings}"])


__all__ = ["Rule", "RuleError", "TestCase", "replace"]
