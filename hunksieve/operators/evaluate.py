"""Rules against scoped lines.

Lines come as LINES (diff_id, idx, path, line, content); each diff is evaluated by itself. Rules are compiled to
expressions with literal patterns, so one pass over the lines, without a shuffle, tests all of them. What is dearer is
for what needs it: masks for rules that ignore comments or strings, windows over a file's lines for rules that look at
neighbours, a join by path for rules with path or language conditions, directives for the files that hold one.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DIRECTIVE
from ..functions.lang import language_of, parse_language
from ..functions.masking import MASKED, mask_begins, mask_maps, mask_stream
from ..functions.patterns import FLAGS, finds, first_match, java_pattern, matches_any, required_text
from ..functions.sets import may_be_in
from ..functions.text import higher, normal_path, snippet
from .rules import Rule, check, closure

FILE = ("diff_id", "path")
EVENT = "struct<rule_idx: int, severity: string, at: bigint, line: bigint, content: string, start: int, match_text: string>"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share. A cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """`df`, computed once, in the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def filter_paths(lines: DataFrame, globs: list[str]) -> DataFrame:
    """Lines of paths that some glob matches; all, without globs."""
    return lines.where(matches_any(F.col("path"), globs)) if globs else lines


def keep_allowed(lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Lines that `allowed` (path, line) lists."""
    return lines.join(allowed.select("path", "line").distinct(), ["path", "line"], "left_semi").select(*lines.columns)


def first_of_each(lines: DataFrame) -> DataFrame:
    """Of lines of the same path, number and content the first in the order of the diff."""
    same = Window.partitionBy("diff_id", "path", "line", "content").orderBy("idx")
    return lines.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


#: Lines of a run are masked in blocks of 2 to this power places, files are put in order in ranges of 2 to that power places.
BLOCK_BITS, RANGE_BITS = 17, 30


def file_table(lines: DataFrame) -> DataFrame:
    """A row for each file of a diff: diff_id, path, its first and last place (lo, hi), tangled (others' lines lie between its own).

    Files are in the order of their first lines inside ranges of places; what lies before and after a range comes from
    a table of the ranges, so that no diff is put in order as a whole.
    """
    files = lines.groupBy(*FILE).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).withColumn("range", F.shiftright("lo", RANGE_BITS))
    across = Window.partitionBy("diff_id").orderBy("range")
    ranges = files.groupBy("diff_id", "range").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = ranges.select("diff_id", "range", F.max("hi").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("reached"), F.lead("lo").over(across).alias("next"))
    order = Window.partitionBy("diff_id", "range").orderBy("lo", "path")
    before, after = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lead("lo").over(order)
    placed = files.select("*", before.alias("before"), after.alias("after")).join(ranges, ["diff_id", "range"])
    tangled = F.coalesce(F.greatest("before", "reached") > F.col("lo"), F.lit(False)) | F.coalesce(F.col("hi") > F.coalesce("after", "next"), F.lit(False))
    return placed.select(*FILE, "lo", "hi", tangled.alias("tangled"))


def with_runs(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`lines` (of `files`) with the run that they lie in: a stretch of lines of one path in a diff, numbered in each file.

    A file whose lines lie together is one run. Only the lines of tangled files are put in order, in blocks; a table of
    the blocks tells how many runs lie before each.
    """
    zero = F.lit(0).cast("long").alias("run")
    wanted = file_table(lines).where("tangled") if files is None else files
    near = may_be_in(wanted, *FILE)
    rows = lines.where(near).join(wanted.select(*FILE, "tangled"), [*FILE], "left" if files is None else "inner")
    whole = rows.where(~F.coalesce("tangled", F.lit(False))).select(*lines.columns, zero)
    mixed = rows.where("tangled").select(*lines.columns, F.shiftright("idx", BLOCK_BITS).alias("_block"))
    here, across = Window.partitionBy("diff_id", "_block").orderBy("idx"), Window.partitionBy("diff_id").orderBy("_block")
    mixed = mixed.withColumn("_new", F.coalesce((F.col("path") != F.lag("path").over(here)).cast("int"), F.lit(0)))
    blocks = mixed.groupBy("diff_id", "_block").agg(F.sum("_new").alias("n"), F.min_by("path", "idx").alias("first"), F.max_by("path", "idx").alias("last"))
    blocks = blocks.withColumn("opens", F.coalesce((F.col("first") != F.lag("last").over(across)).cast("int"), F.lit(0)))
    so_far = F.sum(F.col("n") + F.col("opens")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = blocks.select("diff_id", "_block", so_far.alias("_before"))
    run = F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    out = whole.unionByName(mixed.join(blocks, ["diff_id", "_block"]).select(*lines.columns, run.alias("run")))
    return lines.where(~near).select(*lines.columns, zero).unionByName(out) if files is None else out


def mask_table(lines: DataFrame, language: str | None = None, files: DataFrame | None = None, strings: bool = True) -> DataFrame:
    """`lines` (of `files`) with run and MASKED, where masks are null for lines without anything to mask, no_strings without `strings`.

    Blocks of lines are scanned side by side. Those of files of several blocks are scanned twice: first for what each does
    to what is open before it, which composed tells how each block begins (see `masking`).
    """
    lang = F.lit(parse_language(language)) if language else F.coalesce(language_of(F.col("path")), F.lit("unknown"))
    head = ("diff_id", "path", "run", "block")
    own = [c for c in lines.columns if c not in (*FILE, "content")]
    rows = with_runs(lines, files).withColumns({"block": F.shiftright("idx", BLOCK_BITS), "lang": lang})
    long = (file_table(lines) if files is None else files).where(F.shiftright("lo", BLOCK_BITS) < F.shiftright("hi", BLOCK_BITS))
    dealt = lambda df, *by: df.repartition(*(F.col(c) for c in by))
    told = "diff_id string, path string, run long, block long"
    maps = dealt(rows.where(may_be_in(long, *FILE)).select(*head, "lang", "idx", "content"), *head).sortWithinPartitions(*head, "idx")
    maps = maps.mapInArrow(mask_maps(strings), f"{told}, lang string, begin string")
    begins = dealt(maps, *head[:3]).sortWithinPartitions(*head).mapInArrow(mask_begins, f"{told}, begin string")
    rows = dealt(rows, *head).join(begins.hint("shuffle_hash"), [*head], "left").select(*head, "lang", "begin", *own, "content").sortWithinPartitions(*head, "idx")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(mask_stream(strings), ", ".join([*(f"{c} {t}" for c, t in kinds.items()), MASKED])).drop("lang", "begin", "block")


def masked(lines: DataFrame, language: str | None = None) -> DataFrame:
    """`lines` with run, no_comments, no_strings, no_both, and suppress_all and suppress_ids by the directives in comments.

    Masks carry over inside a run, as does a directive for the next line.
    """
    return mask_table(lines, language).withColumns({c: F.coalesce(c, "content") for c in MASKS})


def suppressions(lines: DataFrame, language: str | None = None) -> DataFrame:
    """(diff_id, at, suppress_all, suppress_ids) of the lines where some rule is suppressed.

    Only files with a directive are scanned, and tangled ones of their diffs, whose lines part the runs. Lines of diffs
    without a directive, by a bit set, go into no shuffle.
    """
    told = lines.where(F.contains(F.lower("content"), F.lit(DIRECTIVE))).select(*FILE).distinct()
    near = lines.where(may_be_in(told, "diff_id"))
    files = file_table(near.select(*FILE, "idx")).join(told.withColumn("told", F.lit(True)), [*FILE], "left")
    some = files.where(F.col("told") | F.col("tangled"))
    rows = mask_table(near, language, some, strings=False).where(F.col("suppress_all") | (F.size("suppress_ids") > 0))
    return rows.select("diff_id", F.col("idx").alias("at"), "suppress_all", "suppress_ids")


def applies(rule: Rule, path: Column, lang: Column) -> Column:
    """Include globs, no exclude glob, and one of the rule's languages; a file without language fails a list of them."""
    out = F.lit(True)
    if rule.paths:
        out = out & matches_any(path, list(rule.paths))
    if rule.exclude_paths:
        out = out & ~matches_any(path, list(rule.exclude_paths))
    if rule.languages:
        out = out & F.coalesce(lang.isin(*(x.lower() for x in rule.languages)), F.lit(False))
    return out


def override_specs(overrides: list[dict]) -> list[dict]:
    """Overrides in the order they apply: by depth, then directory, then as given."""
    out = []
    for i, o in enumerate(overrides):
        folder = o["directory"].replace("\\", "/").removeprefix("./").lstrip("/").rstrip("/")
        folder = "" if folder == "." else folder
        globs = []
        for g in o.get("exclude_paths") or ():
            g = g.replace("\\", "/").removeprefix("./")
            globs.append(g.lstrip("/") if not folder or g.startswith("/") else f"{folder}/{g}")
        out.append({"seq": i, "directory": folder, "rule_id": o["rule_id"], "enabled": o.get("enabled"), "severity": o.get("severity"), "globs": globs})
    return sorted(out, key=lambda o: (len([x for x in o["directory"].split("/") if x]), o["directory"], o["seq"]))


def resolve_overrides(path: Column, rule_id: str, specs: list[dict]) -> tuple[Column, Column]:
    """(enabled, severity or null) of a rule for a path, from the shallowest directory to the deepest."""
    path = normal_path(path)
    enabled, severity = F.lit(True), F.lit(None).cast("string")
    for o in specs:
        if o["rule_id"] != rule_id:
            continue
        here = F.lit(True) if not o["directory"] else (path == o["directory"]) | F.startswith(path, F.lit(o["directory"] + "/"))
        if o["enabled"] is not None:
            enabled = F.when(here, F.lit(o["enabled"])).otherwise(enabled)
        if o["severity"]:
            severity = F.when(here, F.lit(o["severity"])).otherwise(severity)
        if o["globs"]:
            enabled = F.when(here & matches_any(path, o["globs"]), F.lit(False)).otherwise(enabled)
    return enabled, severity


def candidate(rule: Rule) -> Column:
    """The line as a rule sees it."""
    mask = {(True, True): "no_both", (True, False): "no_comments", (False, True): "no_strings"}.get((rule.ignore_comments, rule.ignore_strings))
    return F.coalesce(mask, "content") if mask else F.col("content")


MASKS = ("no_comments", "no_strings", "no_both")
#: What the directives of a file say of its lines.
SUPPRESSED = ("suppress_all", "suppress_ids")
#: Place of the text that a rule sees among the content and MASKS, by whether it ignores comments and strings.
MASK_OF = {(False, False): 0, (True, False): 1, (False, True): 2, (True, True): 3}


#: Rules that each get expressions of their own. Those of a larger pack are walked as one array of a literal, as the code
#: of so many expressions would be one method too large for the JVM's compiler.
FEW_RULES = 8
PACK = "array<struct<i: int, mask: int, tests: array<struct<needed: string, whole: boolean, pattern: string>>>>"


def literal(values: list, kind: str) -> Column:
    """A list as one literal of that type; Catalyst folds it."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def packed_hits(pack: list[tuple[int, Rule]], bound: bool) -> Column:
    """Numbers of the rules of a pack that match a line. Each pattern has text that it can't do without, which is looked for first."""
    told = [{"i": i, "mask": MASK_OF[r.ignore_comments, r.ignore_strings], "tests": [{"needed": n, "whole": w, "pattern": FLAGS + java_pattern(p)} for p in r.patterns for n, w in [required_text(p)]]} for i, r in pack]
    seen = F.array(F.col("content"), *(F.coalesce(c, "content") for c in MASKS))
    masks = any(x["mask"] for x in told)

    def hit(rule: Column) -> Column:
        text = F.get(seen, rule["mask"]) if masks else F.col("content")
        found = F.exists(rule["tests"], lambda t: F.contains(text, t["needed"]) & (t["whole"] | F.rlike(text, t["pattern"])))
        return F.get("severities", rule["i"]).isNotNull() & found if bound else found

    return F.transform(F.filter(literal(told, PACK), hit), lambda rule: rule["i"])


def placed(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Events of single lines with the place and text of their match, worked out for matches alone.

    The pattern that counts is the first in the rule's list that matches. Where patterns are looked up, events are
    sorted by rule in each partition, so that a pattern is compiled once there.
    """
    content, own = F.col("content"), F.col("rule_idx")
    if len(rules) <= FEW_RULES:
        start = size = F
        for i, r in enumerate(rules):  # one CASE with a branch for each rule
            if not r.multiline and r.match_mode != "absent":
                before, length = first_match(candidate(r), list(r.patterns))
                start, size = start.when(own == i, before), size.when(own == i, length)
        rows = events.withColumns({"start": start, "_size": size})
    else:
        by_rule = lambda values, kind: F.get(literal(values, f"array<{kind}>"), own)
        shapes = {name: by_rule([[FLAGS + shape.replace("@", java_pattern(p)) for p in r.patterns] for r in rules], "array<string>") for name, shape in (("_test", "@"), ("_head", r"\A((?s:.*?))(?:@)"), ("_body", r"\A(?s:.*?)(@)"))}
        mask = by_rule([MASK_OF[r.ignore_comments, r.ignore_strings] for r in rules], "int")
        rows = events.sortWithinPartitions("rule_idx").withColumn("_seen", F.get(F.array(content, *(F.coalesce(c, content) for c in MASKS)), mask))
        first = F.array_position(F.transform(shapes["_test"], lambda p: F.rlike("_seen", p)), True).cast("int")
        rows = rows.withColumn("_first", first)
        length = lambda shape: F.length(F.call_function("regexp_extract", F.col("_seen"), F.get(shapes[shape], F.col("_first") - 1), F.lit(1)))
        rows = rows.withColumns({"start": length("_head"), "_size": length("_body")}).drop("_seen", "_first")
    return rows.withColumn("match_text", F.substr(content, F.col("start") + 1, F.col("_size"))).drop("_size", *MASKS)


def applicable(paths: DataFrame, rules: list[Rule], language: str | None = None, overrides: list[dict] | None = None) -> DataFrame:
    """(path, severities): for each distinct path the severity of each rule there, null where it doesn't apply."""
    lang = F.lit(language.lower()) if language else language_of(F.col("path"))
    specs = override_specs(overrides or [])
    each = []
    for r in rules:
        enabled, severity = resolve_overrides(F.col("path"), r.id, specs)
        each.append(F.when(applies(r, F.col("path"), lang) & enabled, F.coalesce(severity, F.lit(r.severity))))
    return paths.select("path").distinct().select("path", F.array(*each).alias("severities"))


def in_windows(rows: DataFrame, i: int, patterns: list[str]) -> DataFrame:
    """`rows` with found{i}, the EVENT of the first match in the lines of next{i}, joined; null without one.

    Each step is a column of its own that the next ones refer to, so that lines are joined and searched once.
    """
    ahead, seen, before, head, target = (F.col(f"{name}{i}") for name in ("next", "seen", "before", "head", "target"))
    joined = lambda name: F.array_join(F.transform(ahead, lambda x: x[name]), "\n")
    rows = rows.withColumn(f"seen{i}", F.when(F.size(ahead) >= 2, joined("text")))
    start, length = first_match(seen, patterns)
    rows = rows.withColumns({f"before{i}": start, f"length{i}": length})
    rows = rows.withColumn(f"head{i}", F.split(F.substr(seen, F.lit(1), before), "\n"))
    rows = rows.withColumn(f"target{i}", F.when(before.isNotNull(), F.element_at(ahead, F.size(head))))
    raw = F.substr(joined("content"), before + 1, F.col(f"length{i}"))
    event = F.struct(F.lit(i), target["severity"], target["idx"], target["line"], target["content"], F.length(F.element_at(head, -1)), raw).cast(EVENT)
    return rows.withColumn(f"found{i}", F.when(target["fits"], event)).drop(*(f"{name}{i}" for name in ("next", "seen", "before", "length", "head", "target")))


def find_events(lines: DataFrame, rules: list[Rule], language: str | None = None, overrides: list[dict] | None = None) -> DataFrame:
    """All matches: diff_id, path, and the fields of EVENT; `start` counts code points from 0.

    One event at most for a rule and line, or for a place and text of a multi-line rule. Rules of mode absent give one
    event at the first line of each file they apply to where they have no match. Rules that depend on others count only
    in files where all of those have matched as well, suppressed or not.
    """
    check(rules, lines.sparkSession)
    deps = closure(rules)
    masks = any(r.ignore_comments or r.ignore_strings for r in rules)
    strings = any(r.ignore_strings and not r.ignore_comments for r in rules)
    # Where all lines are masked, and events are of the lines that they are found in, directives come with the masks.
    told = SUPPRESSED if masks and not any(r.multiline or r.match_mode == "absent" for r in rules) else ()
    rows = mask_table(lines, language, strings=strings).select(*lines.columns, *MASKS, *told) if masks else lines.withColumns({c: F.lit(None).cast("string") for c in MASKS})
    bound = bool(overrides) or any(r.paths or r.exclude_paths or r.languages for r in rules)
    if bound:
        rows = rows.join(applicable(lines, rules, language, overrides), "path")
    file = Window.partitionBy(*FILE).orderBy("idx")
    single, packed, raised, multi, absent = [], [], [], [], []

    for i, r in enumerate(rules):
        if len(rules) > FEW_RULES and r.match_mode != "absent" and not (r.multiline or r.context_patterns or r.escalate_patterns) and all(required_text(p)[0] for p in r.patterns):
            packed.append((i, r))
            continue
        base, text = F.col("severities")[i] if bound else F.lit(r.severity), candidate(r)
        applies_here = base.isNotNull() if bound else F.lit(True)
        around = lambda w: file.rowsBetween(-w, w)
        near = {}
        if r.context_patterns:
            near[f"context{i}"] = F.max(finds(text, list(r.context_patterns)).cast("int")).over(around(r.context)) == 1
        if r.escalate_patterns:
            near[f"raise{i}"] = F.max(finds(text, list(r.escalate_patterns)).cast("int")).over(around(r.escalation)) == 1
        rows = rows.withColumns(near) if near else rows
        severity = F.when(F.col(f"raise{i}"), higher(base, F.lit(r.escalate_to or "error"))).otherwise(base) if r.escalate_patterns else base
        fits = F.col(f"context{i}") if r.context_patterns else F.lit(True)

        if r.multiline:
            seen = F.struct("idx", "line", "content", severity.alias("severity"), text.alias("text"), fits.alias("fits"))
            rows = rows.withColumn(f"next{i}", F.when(applies_here, F.collect_list(seen).over(file.rowsBetween(0, r.window - 1))))
            rows = in_windows(rows, i, list(r.patterns))
            found = F.col(f"found{i}")
            where = found.isNotNull()
        else:
            where = applies_here & finds(text, list(r.patterns)) & fits
        if r.match_mode == "absent":
            absent.append((i, where, applies_here, severity))
        elif r.multiline:  # several windows see one match: it is of the first
            key = F.struct(found["at"], found["start"], found["match_text"])
            rows = rows.withColumn(f"before{i}", F.collect_list(F.when(where, key)).over(file.rowsBetween(1 - r.window, -1)))
            multi.append(F.when(where & ~F.array_contains(f"before{i}", key), found))
        else:
            single.append(F.when(where, i).otherwise(-1))
            if r.escalate_patterns:
                raised.append((i, severity))

    parts = []
    if single or packed:
        each = ([F.array_remove(F.array(*single), -1)] if single else []) + ([packed_hits(packed, bound)] if packed else [])
        hits = rows.withColumn("rule_idx", F.explode(F.concat(*each)))
        severity = F.get(F.col("severities") if bound else literal([r.severity for r in rules], "array<string>"), F.col("rule_idx"))
        for i, higher_one in raised:
            severity = F.when(F.col("rule_idx") == i, higher_one).otherwise(severity)
        parts.append(placed(hits.select(*FILE, "rule_idx", severity.alias("severity"), F.col("idx").alias("at"), "line", "content", *MASKS, *told), rules))
    if multi:
        parts.append(rows.select(*FILE, F.inline(F.array_compact(F.array(*multi)))))
    if absent:  # a row for each file: its first line, and what matched in it
        met = [F.max((F.coalesce(where, F.lit(False))).cast("int")).alias(f"met{i}") for i, where, *_ in absent]
        first = F.min_by(F.struct("line", "content", *(F.when(here, severity).alias(f"severity{i}") for i, _, here, severity in absent)), "idx").alias("first")
        files = rows.groupBy(*FILE).agg(F.min("idx").alias("at"), first, *met)
        rows_of = [F.when((F.col(f"met{i}") == 0) & F.col(f"first.severity{i}").isNotNull(), F.struct(F.lit(i), F.col(f"first.severity{i}"), F.col("at"), F.col("first.line"), F.col("first.content"), F.lit(None), F.lit("<absent>")).cast(EVENT)) for i, *_ in absent]
        parts.append(files.select(*FILE, F.inline(F.array_compact(F.array(*rows_of)))))
    events = None
    for part in parts or [rows.limit(0).select(*FILE, F.inline(F.array().cast(f"array<{EVENT}>")), *told)]:
        events = part if events is None else events.unionByName(part)
    if any(deps.values()):
        met = F.collect_set("rule_idx").over(Window.partitionBy(*FILE))
        index = {r.id: i for i, r in enumerate(rules)}
        needs = F.array(*(F.array(*(F.lit(index[d]) for d in sorted(deps[r.id]))).cast("array<int>") for r in rules))
        events = events.withColumn("_met", met).where(F.size(F.array_except(needs[F.col("rule_idx")], "_met")) == 0).drop("_met")
    events = events if told else events.join(suppressions(lines, language), ["diff_id", "at"], "left")
    events = events.withColumn("rule_id", F.get(literal([r.id for r in rules], "array<string>"), F.col("rule_idx")))
    suppressed = F.coalesce(F.col("suppress_all") | F.array_contains("suppress_ids", F.col("rule_id")), F.lit(False))
    return events.withColumn("suppressed", suppressed).drop("suppress_all", "suppress_ids")


def numbered(events: DataFrame) -> DataFrame:
    """`events` with n, their number in their diff from 1, by place, rule, start and text of the match.

    No task puts a whole diff in order: events are ranked in their block of places, what lies before a block is summed
    over the blocks of its range, and what lies before a range over the ranges. `events` is computed twice.
    """
    key = F.struct("diff_id", F.shiftright("at", BLOCK_BITS).alias("block")).alias("_key")  # null diffs are equal in it
    keyed = events.select("*", key)
    order = Window.partitionBy("_key").orderBy("at", "rule_idx", F.col("start").asc_nulls_last(), "match_text")
    before = lambda *per: F.coalesce(F.sum("n").over(Window.partitionBy(*per[:-1]).orderBy(per[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_range = F.struct("_key.diff_id", F.shiftright("_key.block", RANGE_BITS - BLOCK_BITS).alias("range")).alias("_range")
    blocks = keyed.groupBy("_key").agg(F.count("*").alias("n")).select("_key", "n", of_range)
    ranges = blocks.groupBy("_range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("_range", before("_range.diff_id", "_range.range").alias("_far"))
    blocks = blocks.select("_key", "_range", before("_range", "_key.block").alias("_near")).join(ranges, "_range").select("_key", (F.col("_near") + F.col("_far")).alias("_before"))
    ranked = keyed.withColumn("n", F.row_number().over(order)).join(blocks, "_key")
    return ranked.withColumn("n", F.col("n") + F.col("_before")).drop("_key", "_before")


#: Beyond so many findings a diff's events are numbered in blocks; below, Spark keeps only the first ones of each task.
CAP = 1000


def findings(events: DataFrame, rules: list[Rule], most: int | None = 200) -> DataFrame:
    """diff_id, n (from 1) and the finding's fields: the first `most` (all, if None) unsuppressed events of each diff in order.

    The order is that of the lines in the diff, then of the rules, then of the match in the line.
    """
    messages = literal([r.message for r in rules], "array<string>")
    order = Window.partitionBy("diff_id").orderBy("at", "rule_idx", F.col("start").asc_nulls_last(), "match_text")
    kept = events.where("not suppressed")
    kept = kept.withColumn("n", F.row_number().over(order)) if most is not None and most < CAP else numbered(kept)
    kept = kept.where(F.col("n") <= most) if most is not None else kept
    column = (F.col("start") + 1).cast("long")
    return kept.select("diff_id", "n", "rule_id", "severity", F.get(messages, F.col("rule_idx")).alias("message"), "path", "line", column.alias("column"), "match_text", snippet(F.col("content")).alias("snippet"))

