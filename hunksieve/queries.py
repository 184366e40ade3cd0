"""Queries of the rule engine over the test tables: what each operator gives on whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import TREND_SCHEMA
from .functions import text as tx
from .functions.lang import language_of
from .operators import evaluate, history, packs, rules, scopes, verdict
from .operators.rules import Rule
from .plans.check import Plan, run_check
from .schemas import FP_ENTRY
from .sinks import actions, encoders, outcomes
from .sources import diffs, records, validation
from .streaming.editor import positional_changes
from .streaming.runs import runs_kept, trends_of_runs
from .tables import RULES, WORD_RULE, block_lines, code_lines, diff_text, doc_lines, pack_of_items, special_diffs, table

KEYS = ("rule_id", "path", "line")


def events(spark, sf_dir, found=None, **how) -> DataFrame:
    return evaluate.find_events(doc_lines(spark, sf_dir), found or RULES, **how)


def found(spark, sf_dir, most=200) -> DataFrame:
    return evaluate.findings(events(spark, sf_dir), RULES, most)


def all_findings(spark, sf_dir) -> DataFrame:
    return evaluate.findings(evaluate.held(events(spark, sf_dir)), RULES, None)


def flat(df: DataFrame) -> DataFrame:
    """Events as the oracles list them."""
    return df.select("diff_id", *KEYS, "severity", (F.col("start") + 1).cast("long").alias("col"), "match_text", "suppressed")


def findings_basic(spark, sf_dir):
    """Flagship: every match of four rules with place and fingerprint."""
    return flat(events(spark, sf_dir)).withColumn("fingerprint", tx.fingerprint(*(F.col(c) for c in (*KEYS, "match_text"))))


def scoped_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).drop("kind")


def files_lines_scanned(spark, sf_dir):
    return verdict.scanned(doc_lines(spark, sf_dir))


def _diff(scope):
    def query(spark, sf_dir):
        return diffs.parse_unified_diffs(diff_text(spark, sf_dir), scope).select("path", "line", "content", "kind")

    return query


def diff_special_headers(spark, sf_dir):
    """Renamed, binary, deleted, quoted and other file sections, all documents of a source in one diff of many blocks."""
    return diffs.parse_unified_diffs(special_diffs(spark, sf_dir)).select("diff_id", "path", "line", "content", "kind")


def diff_in_sql(spark, sf_dir):
    """diff_added by the table function, in SQL."""
    spark.udtf.register("parse_diff", diffs.sql_parser())
    diff_text(spark, sf_dir).createOrReplaceTempView("hunksieve_raw_diff")
    return spark.sql("SELECT path, line, content, kind FROM parse_diff(TABLE(hunksieve_raw_diff) PARTITION BY diff_id ORDER BY pos)")


def multibase_union_dedupe(spark, sf_dir):
    """The same diff against two bases, with other line numbers in the second; of lines that are the same in both the first counts."""
    lines = doc_lines(spark, sf_dir).withColumnRenamed("idx", "pos")
    both = diffs.union_bases([lines, lines.withColumn("line", F.col("line") - F.col("line") % 2)], "bases")
    return evaluate.first_of_each(both.withColumnRenamed("pos", "idx")).select("diff_id", "idx", "path", "line", "content")


def language_detect(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("path").distinct().select("path", language_of(F.col("path")).alias("language"))


GLOB_RULES = [
    Rule("g.rust", "info", "", patterns=("x",), paths=("**/*.rs",), exclude_paths=("**/fr/**",)),
    Rule("g.any", "warn", "", patterns=("x",), paths=("src1*/*", "src2/{en,de}/doc_?.*"), languages=("Python", "go", "rust", "javascript")),
    Rule("g.class", "error", "", patterns=("x",), paths=("src[1-3]/**",)),
]


def glob_applicability(spark, sf_dir):
    each = evaluate.applicable(doc_lines(spark, sf_dir), GLOB_RULES)
    ids = F.array(*(F.lit(r.id) for r in GLOB_RULES))
    rows = each.select("path", F.posexplode("severities").alias("i", "severity")).where("severity is not null")
    return rows.select("path", F.get(ids, F.col("i")).alias("rule_id"), "severity")


def path_filter(spark, sf_dir):
    return evaluate.filter_paths(doc_lines(spark, sf_dir), ["**/*.py", "src1/**"]).select("path", "line")


def allowed_lines_semi(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    marked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    doc = F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long")
    allowed = lines.select("path", doc.alias("doc_id")).distinct().join(marked, "doc_id").select("path", F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("line"))
    return evaluate.keep_allowed(lines, allowed).select("path", "line", "content")


def tag_filter(spark, sf_dir):
    """Rules of the benchmark's items by their tags, in any case."""
    rows = pack_of_items(spark, sf_dir)
    return rows.where(rules.tag_condition(F.col("tags"), only=["LEN1", "len2"], enable=["odd"], disable=["Len3"])).select(F.col("id").alias("rule_id"), "severity")


CLASS_RULES = [Rule("c.minus", "info", "", patterns=("[a-z--aeiou]{4}",)), Rule("c.either", "info", "", patterns=("[0-9~~5-9a-z]{3}",)), Rule("c.edge", "info", "", patterns=(r"\<the\>", "zzzz"))]


def pattern_classes(spark, sf_dir):
    """Differences of character classes and edges of words."""
    return flat(events(spark, sf_dir, CLASS_RULES)).select("path", "line", "rule_id")


def first_pattern_wins(spark, sf_dir):
    rule = Rule("first", "info", "", patterns=("zzzz", "of [a-z]+", "the [a-z]+"))
    return flat(events(spark, sf_dir, [rule])).select("path", "line", "col", "match_text")


def snippet_240(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("path", "line", tx.snippet(F.col("content")).alias("snippet"))


def gitlab_fingerprint(spark, sf_dir):
    return encoders.gitlab(all_findings(spark, sf_dir)).select("diff_id", "n", "fingerprint")


def _masks(column):
    def query(spark, sf_dir):
        return evaluate.masked(code_lines(spark, sf_dir)).select("path", "line", F.col(column).alias("masked"))

    return query


def mask_multiline_block(spark, sf_dir):
    """Comments that begin, go on and end on lines of their own."""
    return evaluate.masked(block_lines(spark, sf_dir)).select("path", "line", F.col("no_comments").alias("masked"))


def mask_true_texts(spark, sf_dir):
    """All masks of the documents as they stand, whose quotes and marks open and close where they happen to; no SQL."""
    return evaluate.masked(doc_lines(spark, sf_dir)).select("path", "line", "no_comments", "no_strings", "no_both")


def mask_html_blocks(spark, sf_dir):
    """Markup lines without comments that may span lines; no SQL."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("diff_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.posexplode(F.split("html", "\n")).alias("at", "content"))
    lines = pages.select("diff_id", F.col("at").cast("long").alias("idx"), "path", (F.col("at") + 1).cast("long").alias("line"), "content", F.lit("added").alias("kind"))
    return evaluate.masked(lines).select("path", "line", "no_comments")


def forced_language(spark, sf_dir):
    rule = Rule("go.only", "warn", "", patterns=("the",), languages=("go",), ignore_comments=True)
    lines = doc_lines(spark, sf_dir).withColumn("content", F.translate("content", "\"'`/*", "     "))
    lines = lines.withColumn("content", F.when(F.col("line") % 2 == 0, F.concat(F.lit("// "), "content")).otherwise(F.col("content")))
    return flat(evaluate.find_events(lines, [rule], language="Go")).select("path", "line", "col")


def multiline_match(spark, sf_dir):
    rule = Rule("multi", "info", "", patterns=(r"\.\n[A-Z]",), multiline=True, multiline_window=3)
    return flat(events(spark, sf_dir, [rule])).select("path", "line", "col", "match_text")


def absent_mode(spark, sf_dir):
    rule = Rule("absent", "warn", "", patterns=(r"the",), paths=("**/*.py", "**/*.rs"), match_mode="absent")
    return flat(events(spark, sf_dir, [rule])).select("path", "line", "col", "match_text")


def context_required(spark, sf_dir):
    rule = Rule("ctx", "info", "", patterns=(r"with the",), context_patterns=("of the",), context_window=2)
    return flat(events(spark, sf_dir, [rule])).select("path", "line", "col")


def escalate_severity(spark, sf_dir):
    rule = Rule("esc", "info", "", patterns=(r"with the",), escalate_patterns=("of the",), escalate_window=1, escalate_to="warn")
    return flat(events(spark, sf_dir, [rule])).select("path", "line", "severity")


def _dependent(*deps):
    pack = [Rule(i, "info", "", patterns=(p,), depends_on=d) for (i, p), d in zip((("d.a", "with the"), ("d.b", "of the"), ("d.c", "to the")), deps, strict=True)]

    def query(spark, sf_dir):
        return flat(events(spark, sf_dir, pack)).select("path", "line", "rule_id")

    return query


def _overridden(*specs):
    def query(spark, sf_dir):
        pack = [Rule("o.of", "warn", "", patterns=("of the",)), Rule("o.to", "info", "", patterns=("to the",))]
        return flat(events(spark, sf_dir, pack, overrides=list(specs))).select("path", "line", "rule_id", "severity")

    return query


DIRECTORY_RULES = [
    {"directory": "", "rule_id": "o.of", "severity": "info"},
    {"directory": "./src1/", "rule_id": "o.of", "severity": "error"},
    {"directory": "src1/en", "rule_id": "o.of", "enabled": False},
    {"directory": "src2", "rule_id": "o.to", "exclude_paths": ["en/**", "**/*.py"]},
]


def override_table(spark, sf_dir):
    specs = [(i, o["directory"], o["rule_id"], o.get("enabled"), o.get("severity")) for i, o in enumerate(DIRECTORY_RULES)]
    frame = spark.createDataFrame(specs, "seq int, directory string, rule_id string, enabled boolean, severity string")
    return scopes.resolve_overrides_table(doc_lines(spark, sf_dir).select("path").distinct(), frame)


def glob_table(spark, sf_dir):
    """Globs made from all documents, labels and benchmark items, and one that leaves all open, against all paths."""
    name = lambda before, n, after: F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after)).alias("glob")
    globs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), name("**/doc_", "doc_id", ".*")).alias("glob"))
    globs = globs.unionByName(table(spark, sf_dir, "labels").select(name("**/en/doc_", "doc_id", ".{py,rs}")))
    globs = globs.unionByName(table(spark, sf_dir, "benchmark").select(name("**/doc_", "item_id", "?.*")))
    globs = globs.unionByName(spark.createDataFrame([("{src1,src2}/[a-e]?/*.?s",)], "glob string"))
    return scopes.glob_matches(doc_lines(spark, sf_dir), globs)


def override_excludes(spark, sf_dir):
    """Overrides made from labels: toxic documents are left out of a rule by globs, over and under what their folders say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("source", F.lit("/"), "lang").alias("folder"), "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").join(docs, "doc_id")
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda df, seq, folder, rule, enabled, severity, globs: df.select(seq.cast("long").alias("seq"), F.col(folder).alias("directory"), rule.alias("rule_id"), enabled.alias("enabled"), severity.alias("severity"), globs.alias("exclude_paths"))
    own = F.array(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".*")))
    specs = row(toxic, F.col("doc_id"), "folder", F.concat(F.lit("q."), F.col("quality").cast("string")), null("boolean"), null("string"), own)
    specs = specs.unionByName(row(docs.select("source").distinct(), F.lit(0), "source", F.lit("q.0"), F.lit(False), F.lit("error"), null("array<string>")))
    specs = specs.unionByName(row(docs.where("lang = 'en'").select("folder").distinct(), F.lit(-1), "folder", F.lit("q.0"), F.lit(True), null("string"), null("array<string>")))
    return scopes.resolve_overrides_table(doc_lines(spark, sf_dir), specs)


def pack_in_scope(spark, sf_dir):
    """The items' rules where their paths, exclude paths and languages hold."""
    n = F.col("rule_idx")
    paths = F.array(F.concat(F.lit("src"), (n % 4 + 1).cast("string"), F.lit("/**")), F.lit("*.sql"))
    pack = pack_of_items(spark, sf_dir).withColumns({"paths": paths, "exclude_paths": F.array(F.lit("**/fr/**")), "languages": F.when(n % 2 == 1, F.array(F.lit("Python"), F.lit("sql")))})
    return scopes.in_scope(packs.find_in_pack(doc_lines(spark, sf_dir), pack), pack).select("path", "line", "rule_id")


def suppressions(spark, sf_dir):
    lines = code_lines(spark, sf_dir)
    return flat(evaluate.find_events(lines, [WORD_RULE, replace(WORD_RULE, id="word.of", patterns=("of",))])).select("path", "line", "rule_id", "suppressed")


def event_order_cap(spark, sf_dir):
    return found(spark, sf_dir, 7).select("diff_id", "n", *KEYS, "column", "match_text", "snippet")


def verdict_counts(spark, sf_dir):
    counts = verdict.verdict_counts(events(spark, sf_dir), 7)
    return counts.withColumns({"status": verdict.status(), "reason": F.array_join(verdict.reasons(), ",")})


def exit_code_matrix(spark, sf_dir):
    counts = verdict.verdict_counts(events(spark, sf_dir))
    return counts.select("diff_id", F.explode(F.array(F.lit("error"), F.lit("warn"), F.lit("never"))).alias("fail_on"), "warn", "error").select("diff_id", "fail_on", verdict.exit_code(F.col("fail_on")).alias("code"), verdict.baseline_exit_code(F.col("fail_on")).alias("baseline_code"))


def check_summary(spark, sf_dir):
    """The whole check with path and tag filters, and its summary."""
    run = run_check(doc_lines(spark, sf_dir), RULES, Plan(fail_on="warn", max_findings=5, path_filters=("**/en/**",), disable_tags=("secret",)))
    return run.summary.select("diff_id", "files_scanned", "lines_scanned", "info", "warn", "error", "suppressed", "truncated", "status", "exit_code")


def rule_hits(spark, sf_dir):
    return verdict.rule_hits(events(spark, sf_dir))


def half_acknowledged(spark, sf_dir) -> DataFrame:
    """FP_ENTRY of the findings on even lines."""
    return history.entries_of(all_findings(spark, sf_dir).where("line % 2 = 0").drop("n", "diff_id"))


def rule_hits_with_fp(spark, sf_dir):
    run = run_check(doc_lines(spark, sf_dir), RULES, Plan(max_findings=10**9), baseline=half_acknowledged(spark, sf_dir))
    return run.rule_hits


def fp_anti_join(spark, sf_dir):
    return history.unacknowledged(all_findings(spark, sf_dir), half_acknowledged(spark, sf_dir)).select("diff_id", *KEYS, "match_text")


def _entries(spark, sf_dir):
    rows = history.with_fingerprints(all_findings(spark, sf_dir)).select("fingerprint", *KEYS).distinct()
    old = rows.where("line % 3 <> 0").withColumn("note", F.concat(F.lit("old "), F.col("line").cast("string")))
    new = rows.where("line % 2 = 0").select("fingerprint", F.when(F.col("line") % 4 == 0, "").otherwise(F.col("rule_id")).alias("rule_id"), "path", F.when(F.col("line") % 4 == 0, F.lit(0)).otherwise(F.col("line")).alias("line"), F.when(F.col("line") % 5 == 0, "new").alias("note"))
    return old.to(spark.createDataFrame([], FP_ENTRY).schema), new.to(spark.createDataFrame([], FP_ENTRY).schema)


def fp_baseline_merge(spark, sf_dir):
    return history.merge_baselines(*_entries(spark, sf_dir))


def fp_normalise(spark, sf_dir):
    old, new = _entries(spark, sf_dir)
    return history.normalise_baseline(old.unionByName(new))


def _classed(spark, sf_dir):
    now = all_findings(spark, sf_dir)
    return history.known_and_new(now, now.where("line % 2 = 0"))


def baseline_classes(spark, sf_dir):
    return _classed(spark, sf_dir).select("diff_id", *KEYS, "match_text", "class")


def baseline_exit(spark, sf_dir):
    return history.new_counts(_classed(spark, sf_dir)).select("info", "warn", "error", verdict.baseline_exit_code("never").alias("code"))


NOW = 1_800_000_000


def blame_author_age(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    blame = e.select(F.concat(F.lit("f"), user).alias("path"), F.col("event_id").alias("line"), F.concat(F.lit("User "), user).alias("author"), F.concat(F.lit("<U"), user, F.lit("@x.org>")).alias("author_mail"), F.unix_timestamp("ts").alias("author_time"))
    newest = blame.agg(F.max("author_time")).first()[0]
    return history.blame_allowed(blame, newest, ["USER 1", "u7@"], 20)


def lines_of_blame(spark, sf_dir):
    """Lines of all documents whose blame names some author and isn't too old; a line's number is the day it was written."""
    lines = doc_lines(spark, sf_dir)
    parts = F.split("path", "/")
    blame = lines.select("path", "line", F.get(parts, F.lit(1)).alias("author"), F.concat(F.lit("<"), F.get(parts, F.lit(0)), F.lit("@x.org>")).alias("author_mail"), (F.col("line") * 86400).alias("author_time"))
    return evaluate.keep_allowed(lines, history.blame_allowed(blame, 30 * 86400 + 5, ["EN", "src2@"], 20)).select("path", "line", "content")


def blame_porcelain(spark, sf_dir):
    """Porcelain text of all orders' lines: the first of an order tells its author, and stands for as many lines as the order has."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("s"))
    hash_ = F.substr(F.sha1(F.col("l_orderkey").cast("string").cast("binary")), F.lit(1), F.lit(40))
    head = F.concat_ws(" ", hash_, F.lit("1"), (F.col("l_orderkey") * 10).cast("string"), F.col("n").cast("string"))
    text = F.array(head, F.concat(F.lit("author S"), F.col("s").cast("string")), F.concat(F.lit("author-mail <"), F.col("s").cast("string"), F.lit(">")), F.concat(F.lit("author-time "), (F.col("s") * 1000).cast("string")), F.lit("filename x"), F.lit("\tcode"), F.concat_ws(" ", hash_, F.lit("2"), F.lit("3")), F.lit("\tmore"))
    raw = per.select(F.concat(F.lit("p"), (F.col("l_orderkey") % 97).cast("string")).alias("path"), "l_orderkey", F.posexplode(text).alias("at", "raw")).select("path", (F.col("l_orderkey") * 10 + F.col("at")).alias("pos"), "raw")
    return records.parse_blame(raw)


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    n = lambda k: F.count_if(F.col("event_type") == k)
    counts = F.struct(n("view").alias("info"), n("click").alias("warn"), n("error").alias("error"), n("purchase").alias("suppressed"))
    return e.groupBy("day").agg(counts.alias("counts"), F.count("*").alias("findings")).select(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("seq"), "counts", "findings")


def trend_totals(spark, sf_dir):
    return history.trend_totals(_runs(spark, sf_dir))


def trend_delta(spark, sf_dir):
    return history.trend_delta(_runs(spark, sf_dir))


def trend_retention(spark, sf_dir):
    return history.latest_runs(_runs(spark, sf_dir), 3).select("seq", "findings")


def run_histories(spark, sf_dir):
    """Each event a run in its user's history, read as a stream: the newest five runs of each that its state keeps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).parquet(f"{sf_dir}/event[s].parquet")
    padded = lambda c: F.lpad(c.cast("string"), 20, "0")
    is_ = lambda k: (F.col("event_type") == k).cast("long")
    counts = F.struct(is_("view").alias("info"), is_("click").alias("warn"), is_("error").alias("error"), is_("purchase").alias("suppressed"))
    null = lambda kind: F.lit(None).cast(kind)
    told = stream.select(
        F.col("user_id").cast("string").alias("history"), padded(F.unix_micros(F.col("ts").cast("timestamp"))).alias("started_at"), padded(F.col("event_id")).alias("ended_at"), null("long").alias("duration_ms"),
        null("string").alias("base"), null("string").alias("head"), F.lit("added").alias("scope"), F.lit("pass").alias("status"), counts.alias("counts"), null("long").alias("files_scanned"), null("long").alias("lines_scanned"), F.lit(1).cast("long").alias("findings"),
    )
    state = f"{evaluate.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    writer = trends_of_runs(told, 5).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.format("noop").mode("overwrite").save())
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return runs_kept(spark, state).select("history", "seq", F.col("ended_at").cast("long").alias("event_id"), "counts.info", "counts.warn", "counts.error", "counts.suppressed")


def record_errors(spark, sf_dir):
    """A history file's text for each user, whose events are its runs, and what is wrong with it: words, numbers, gaps and types."""
    kind, n = F.col("event_type"), F.col("event_id")
    counts = F.struct(F.when(kind == "error", "none").otherwise("0").alias("info"), F.lit(0).alias("warn"), F.lit(0).alias("error"))
    status = F.when(kind == "purchase", kind).otherwise("pass")
    one = F.struct(n, F.lit("s").alias("started_at"), F.when(kind != "click", "e").alias("ended_at"), (n - 50).alias("duration_ms"), F.lit("b").alias("base"), F.lit("h").alias("head"), F.lit("added").alias("scope"), status.alias("status"), counts.alias("counts"), F.lit(1).alias("files_scanned"), F.lit(1).alias("lines_scanned"), F.lit(0).alias("findings"))
    runs = F.array_sort(F.collect_list(one)).alias("runs")
    text = F.to_json(F.struct(F.lit(TREND_SCHEMA).alias("schema"), "runs"))
    # Numbers of `info` are quoted so that one column holds both; the quotes of the good ones go again.
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(runs).select("user_id", F.replace(text, F.lit('"info":"0"'), F.lit('"info":0')).alias("text"))
    return validation.record_errors(texts, outcomes.json_schemas()["trend-history"])


def sensor_findings(spark, sf_dir):
    return encoders.sensor_findings(all_findings(spark, sf_dir), rules.rules_table(spark, RULES)).drop("check_id", "match_text", "snippet")


def code_actions(spark, sf_dir):
    """What an editor offers beside the events of each path; two rules share a page, one has none."""
    pages = {"pii.email": "https://example.org/pii", "pii.ipv4": "https://example.org/pii", "secret.token": "https://example.org/secret"}
    pack = rules.rules_table(spark, [replace(r, url=pages.get(r.id)) for r in RULES])
    marks = events(spark, sf_dir).where("not suppressed").join(pack.select(F.col("id").alias("rule_id"), "message"), "rule_id")
    out = actions.code_actions(marks.select("diff_id", "path", "line", F.col("start").alias("start_char"), "message", F.col("rule_id").alias("code")), pack)
    return out.withColumn("arguments", F.array_join("arguments", " "))


def rules_matched(spark, sf_dir):
    return verdict.rules_matched(all_findings(spark, sf_dir))


def tags_matched(spark, sf_dir):
    return verdict.tags_matched(all_findings(spark, sf_dir), rules.rules_table(spark, RULES))


def sarif_rules(spark, sf_dir):
    return encoders.sarif_rules(all_findings(spark, sf_dir))


def sarif_results(spark, sf_dir):
    return encoders.sarif_results(all_findings(spark, sf_dir))


def junit_suites(spark, sf_dir):
    return encoders.junit_suites(all_findings(spark, sf_dir)).drop("cases")


def junit_cases(spark, sf_dir):
    """The bodies of the suites, which are one text each, under the cap of a run."""
    return encoders.junit_suites(found(spark, sf_dir)).select("diff_id", "rule_id", "cases")


def gitlab_issues(spark, sf_dir):
    return encoders.gitlab(all_findings(spark, sf_dir)).select("diff_id", "n", "issue")


def checkstyle_files(spark, sf_dir):
    return encoders.checkstyle_files(all_findings(spark, sf_dir))


def csv_rows(spark, sf_dir):
    return encoders.csv_rows(all_findings(spark, sf_dir))


def tsv_rows(spark, sf_dir):
    return encoders.tsv_rows(all_findings(spark, sf_dir))


def annotations(spark, sf_dir):
    return encoders.annotations(all_findings(spark, sf_dir))


def markdown_rows(spark, sf_dir):
    return encoders.markdown_rows(all_findings(spark, sf_dir))


def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.escape_xml(F.col("html")).alias("escaped"))


def pages_rendered(spark, sf_dir):
    """Summary, SARIF, JUnit and Checkstyle pages; no SQL."""
    run = run_check(doc_lines(spark, sf_dir), RULES, Plan(max_findings=50))
    out = run.markdown().withColumn("format", F.lit("markdown"))
    for name, rows in (("sarif", encoders.sarif(run.findings)), ("junit", encoders.junit(run.findings)), ("checkstyle", encoders.checkstyle(run.findings)), ("receipt", encoders.receipt_json(run.receipt())), ("csv", encoders.csv_page(run.findings))):
        out = out.unionByName(rows.withColumn("format", F.lit(name)))
    return out


def rule_suggest(spark, sf_dir):
    return rules.suggest(pack_of_items(spark, sf_dir), "B.1O").select("id", F.col("score").cast("long").alias("score"))


def rule_self_test(spark, sf_dir):
    """Each item's rule against the item and against its upper-case form."""
    return packs.self_test_pack(pack_of_items(spark, sf_dir)).withColumnRenamed("case", "n")


def config_merge(spark, sf_dir):
    """Two thirds of the items' rules, and over them the even ones as errors."""
    pack = pack_of_items(spark, sf_dir).select("id", "severity", "rule_idx")
    return rules.merge_tables(pack.where("rule_idx % 3 <> 0"), pack.where("rule_idx % 2 = 0").withColumn("severity", F.lit("error")))


def changed_lines_positional(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    new = turns.groupBy(F.col("conv_id").cast("string").alias("uri")).agg(text.alias("text"))
    old = turns.where("turn % 3 <> 1").groupBy(F.col("conv_id").cast("string").alias("uri")).agg(text.alias("text"))
    return positional_changes(old, new)


def benchmark_fanout_rules(spark, sf_dir):
    """A rule for each lower-case word of the benchmark's items, held in a table: how many lines go on with two letters more."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0))
    pack = table(spark, sf_dir, "benchmark").select(word.alias("w")).distinct()
    pack = pack.select(F.concat(F.lit("w."), "w").alias("id"), F.lit("info").alias("severity"), F.array(F.concat("w", F.lit("[a-z]{2}"))).alias("patterns"))
    return packs.find_in_pack(doc_lines(spark, sf_dir), pack).groupBy("rule_id").agg(F.count("*").alias("total"))


def dependency_table(spark, sf_dir):
    """Rules in a table that look for a piece of each benchmark item, three in four of them with dependencies, some in circles."""
    n = F.col("item_id")
    name = lambda x: F.concat(F.lit("b."), x.cast("string"))
    needs = F.when(n % 4 != 0, F.array(name(n - 1))).when(n % 8 == 4, F.array(name(n + 1)))
    pack = table(spark, sf_dir, "benchmark").select(name(n).alias("id"), F.lit("info").alias("severity"), F.array(F.regexp_extract("text", "[a-z]{3}", 0)).alias("patterns"), needs.alias("depends_on"))
    return packs.gate(packs.find_in_pack(doc_lines(spark, sf_dir), pack), packs.closure_table(pack)).select("path", "line", "rule_id")


def runs_of_files(spark, sf_dir):
    """Number of stretches of one path in each diff, where every other line of a diff is put behind all others."""
    lines = doc_lines(spark, sf_dir).withColumn("idx", F.col("idx") + F.when(F.col("line") % 2 == 0, F.lit(1 << 60)).otherwise(F.lit(0)))
    return evaluate.with_runs(lines).groupBy("diff_id").agg(F.count_distinct("path", "run").alias("runs"))


QUERIES = {
    f.__name__: f
    for f in (findings_basic, scoped_lines, files_lines_scanned, diff_special_headers, diff_in_sql, multibase_union_dedupe, language_detect, glob_applicability, path_filter)
    + (allowed_lines_semi, tag_filter, pattern_classes, first_pattern_wins, snippet_240, gitlab_fingerprint, mask_true_texts, mask_html_blocks, mask_multiline_block, forced_language, multiline_match, absent_mode)
    + (context_required, escalate_severity, override_table, override_excludes, glob_table, pack_in_scope, suppressions, event_order_cap, verdict_counts, exit_code_matrix, check_summary, rule_hits)
    + (rule_hits_with_fp, fp_anti_join, fp_baseline_merge, fp_normalise, baseline_classes, baseline_exit, blame_author_age, lines_of_blame, blame_porcelain, trend_totals)
    + (trend_delta, trend_retention, run_histories, record_errors, sensor_findings, code_actions, rules_matched, tags_matched, sarif_rules, sarif_results, junit_suites, junit_cases, gitlab_issues, checkstyle_files, csv_rows)
    + (tsv_rows, annotations, markdown_rows, xml_escape, pages_rendered, rule_suggest, rule_self_test, config_merge, changed_lines_positional)
    + (benchmark_fanout_rules, dependency_table, runs_of_files)
}
QUERIES |= {f"diff_{s}": _diff(s) for s in diffs.SCOPES}
QUERIES |= {"mask_line_comments": _masks("no_comments"), "mask_strings": _masks("no_strings"), "mask_both": _masks("no_both")}
QUERIES |= {
    "dependency_gate": _dependent((), ("d.a",), ()),
    "dependency_chain": _dependent((), ("d.a",), ("d.b",)),
    "dependency_cycle": _dependent(("d.c",), ("d.a",), ("d.b",)),
    "dir_override_severity": _overridden(*DIRECTORY_RULES[:2]),
    "dir_override_disable": _overridden(*DIRECTORY_RULES[:3]),
    "dir_override_exclude": _overridden(*DIRECTORY_RULES[3:]),
}


def _wide(query):
    """The query with its integers as longs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})

    return run


QUERIES = {name: _wide(query) for name, query in QUERIES.items()}
