"""Quick fixes beside an editor's diagnostics, and the commands that they call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import TOOL
from ..operators.rules import Rule, explain, rules_table, suggest

EXPLAIN, RELOAD, OPEN_DOCS = f"{TOOL}.explainRule", f"{TOOL}.reloadConfig", f"{TOOL}.showRuleUrl"


def code_actions(marks: DataFrame, rules: DataFrame) -> DataFrame:
    """(diff_id, path, at, title, command, arguments, rule_id, url): the quick fixes of each document, numbered from 0.

    marks: (diff_id, path, line, start_char, message, code), as `diagnostics` gives them; a mark without a code has none.
    rules: (id, url), ids distinct. A document offers to explain each of its rules once, and to open each address once, for
    the rule that names it first; both stand where the first mark is that calls for them, the explanation before. Marks at
    one place go by message and code. Rules that `rules` doesn't hold can be explained (the command says what is near).
    Repeated marks change nothing, and an empty table gives none.
    """
    doc = ("diff_id", "path")
    first = marks.where("code is not null").groupBy(*doc, "code").agg(F.min(F.struct("line", "start_char", "message", "code")).alias("place"))
    with_url = first.join(rules.where("url is not null").select(F.col("id").alias("code"), "url"), "code")
    opened = with_url.groupBy(*doc, "url").agg(F.min("place").alias("place")).withColumn("code", F.col("place.code"))

    def offer(rows, kind, says, command, *arguments):
        names = F.concat(F.lit(f"{TOOL}: {says} "), "code").alias("title"), F.lit(command).alias("command"), F.array(*arguments).alias("arguments")
        return rows.select(*doc, "place", F.lit(kind).alias("kind"), *names, F.col("code").alias("rule_id"), (F.col("url") if kind else F.lit(None).cast("string")).alias("url"))

    both = offer(first, 0, "Explain", EXPLAIN, "code").unionByName(offer(opened, 1, "Open docs for", OPEN_DOCS, "url", "code"))
    at = F.row_number().over(Window.partitionBy(*doc).orderBy("place", "kind")) - 1  # over twice the document's rules at most
    return both.withColumn("at", at).select(*doc, "at", "title", "command", "arguments", "rule_id", "url")


def execute(spark: SparkSession, command: str, arguments: list[str], rules: list[Rule], reload: Callable[[], list[Rule]] | None = None) -> dict:
    """What an editor's command answers, with the `message` to show; a ValueError if it is unknown or lacks its argument.

    `reload` reads the rules anew; if that fails the old ones stay, and the answer isn't ok.
    """
    if command == RELOAD:
        try:
            rules, ok, message = reload() if reload else rules, True, "configuration reloaded"
        except ValueError as e:  # also what the readers raise of a file that is no TOML or no set of rules
            ok, message = False, str(e)
        return {"ok": ok, "message": message, "rules": len(rules)}
    if command not in (EXPLAIN, OPEN_DOCS):
        raise ValueError(f"unsupported command '{command}'")
    if not arguments or not isinstance(arguments[0], str):
        raise ValueError("missing rule ID argument" if command == EXPLAIN else "missing URL argument")
    if command == OPEN_DOCS:
        rule_id = arguments[1] if len(arguments) > 1 else ""
        label = f"{TOOL} rule {rule_id}" if rule_id else f"{TOOL} documentation"
        return {"url": arguments[0], "ruleId": rule_id, "message": f"{label}: {arguments[0]}"}
    known = [r for r in rules if r.id == arguments[0]]
    if known:
        return {"ruleId": arguments[0], "found": True, "message": explain(known[0])}
    near = [r.id for r in suggest(rules_table(spark, rules), arguments[0]).collect()] if rules else []
    message = "\n".join([f"Rule '{arguments[0]}' not found.", *(["Did you mean:"] if near else []), *(f"- {x}" for x in near)])
    return {"ruleId": arguments[0], "found": False, "message": message}
