"""Documents of an editor as a stream: their state, their changed lines, and diagnostics for each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGED = T.StructType().add("uri", "string").add("version", "integer").add("kind", "string").add("line", "long").add("content", "string")

#: The kind of an event that says that the rules may have changed. Its uri is that of no document.
CONFIG = "config"


def text_lines(text: str) -> list[str]:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def changed_lines(old: str, new: str) -> list[tuple[int, str]]:
    """Lines of the new text (from 1) that the old one doesn't have at the same place."""
    before = text_lines(old)
    return [(i + 1, x) for i, x in enumerate(text_lines(new)) if i >= len(before) or before[i] != x]


def offset_of(text: str, line: int, char: int) -> int:
    """Place in a text of a line and UTF-16 column, both from 0; beyond an end it is that end."""
    start = 0
    for _ in range(line):
        at = text.find("\n", start)
        if at < 0:
            return len(text)
        start = at + 1
    end = text.find("\n", start)
    units = 0
    for i, c in enumerate(text[start : end if end >= 0 else len(text)]):
        if units >= char:
            return start + i
        units += 2 if ord(c) > 0xFFFF else 1
    return end if end >= 0 else len(text)


def apply_edits(text: str, edits: list) -> str:
    """Incremental edits, one after the other; a range whose end lies before its start is an insertion at its start."""
    for e in edits:
        a, b = offset_of(text, e["sl"], e["sc"]), offset_of(text, e["el"], e["ec"])
        text = text[:a] + e["text"] + text[max(a, b) :]
    return text


def step(state: tuple[str, str, int] | None, event: dict) -> tuple[tuple[str, str, int] | None, list[tuple[int, str]]]:
    """(baseline, text, version) after an event, and the changed lines. Events apply in the order they come in.

    open takes the text as baseline and text; change brings a whole text or edits; save makes the text the baseline;
    close forgets the document. Events of documents that aren't open change nothing.
    """
    kind, text = event["kind"], event["text"]
    if kind == "open":
        return (text or "", text or "", event["version"] or 0), []
    if state is None or kind == "close":
        return None, []
    base, now, version = state
    if kind == "change":
        now = text if text is not None else apply_edits(now, list(event["edits"]) if event["edits"] is not None else [])
        version = event["version"] if event["version"] is not None else version
    elif kind == "save":
        base = now = text if text is not None else now
    return (base, now, version), changed_lines(base, now)


class Documents(StatefulProcessor):
    """Keeps each open document's state under its uri; emits its changed lines after each batch of its events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("document", "base string, text string, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        changed, last = [], None
        for frame in rows:
            for event in frame.sort_values("seq").to_dict("records"):
                event = {k: None if k in ("text", "version") and pd.isna(v) else v for k, v in event.items()}
                state, changed = step(state, event)
                last = event["kind"]
        if state is None:
            self.state.clear()
        else:
            self.state.update((state[0], state[1], int(state[2])))
        version = int(state[2]) if state else 0
        out = [(key[0], version, last, n, text) for n, text in changed] or [(key[0], version, last, None, None)]
        yield pd.DataFrame(out, columns=CHANGED.names).astype({"version": "int32", "line": "Int64"})

    def close(self) -> None:
        pass


def document_changes(events: DataFrame) -> DataFrame:
    """CHANGED for each document with events in a micro-batch; a row without a line if none is changed.

    events: a stream of EDITOR_EVENT with seq, the order in which a document's events came in.
    """
    return events.groupBy("uri").transformWithStateInPandas(Documents(), CHANGED, outputMode="Update", timeMode="None")


def positional_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, line, content) of new texts (uri, text) that differ at their place from the old ones; a batch form of the same."""
    lines = lambda df: df.select("uri", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\r?\n")).alias("at", "content"))
    a, b = lines(old).withColumnRenamed("content", "before"), lines(new)
    out = b.join(a, ["uri", "at"], "left").where(~F.col("content").eqNullSafe(F.col("before")))
    return out.select("uri", (F.col("at") + 1).cast("long").alias("line"), "content")


def synthetic_lines(changes: DataFrame) -> DataFrame:
    """LINES of changed lines: each document a diff of its own."""
    order = Window.partitionBy("uri").orderBy("line")
    return changes.where("line is not null").select(F.col("uri").alias("diff_id"), F.row_number().over(order).cast("long").alias("idx"), F.col("uri").alias("path"), "line", "content", F.lit("added").alias("kind"))


def open_documents(spark: SparkSession, checkpoint: str, batch: int) -> DataFrame:
    """(uri, version, base, text) of the documents that are open after a committed batch, read from the stream's state."""
    state = spark.read.format("statestore").option("stateVarName", "document").option("batchId", batch).load(checkpoint)
    return state.select(F.col("key.uri").alias("uri"), "value.version", "value.base", "value.text")


def changes_of(documents: DataFrame) -> DataFrame:
    """CHANGED of documents (uri, version, base, text), as their next event would give it."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            out = []
            for r in frame.itertuples():
                out += [(r.uri, r.version, CONFIG, n, text) for n, text in changed_lines(r.base, r.text)] or [(r.uri, r.version, CONFIG, None, None)]
            yield pd.DataFrame(out, columns=CHANGED.names).astype({"version": "int32", "line": "Int64"})

    return documents.mapInPandas(run, CHANGED)


def diagnose_batches(
    events: DataFrame,
    rules_of: Callable[[], list],
    publish: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    diff_of: Callable[[], DataFrame] | None = None,
    say: Callable[[str], None] = print,
):
    """Writer whose every micro-batch checks the changed documents and publishes (uri, version, diagnostics), in order of uri.

    `rules_of` is asked for the rules in each batch; if it fails the built-in rules hold, and `say` is told why. An event
    of kind config has all open documents checked again, those without events as the state of the batch before tells, for
    which the stream's `checkpoint` folder must be given. A document without changed lines is checked on its lines in
    `diff_of()` (LINES whose paths are uris), if there is one. A document's row replaces what was published for it; one without
    findings, or that was closed, has an empty list.
    """
    from ..operators.evaluate import find_events, findings
    from ..operators.rules import RuleError
    from ..sinks.encoders import diagnostics
    from ..sources.presets import BUILT_IN

    def current_rules() -> list:
        try:
            return rules_of()
        except (OSError, ValueError, RuleError) as e:
            say(f"rules could not be loaded, built-in rules hold: {e}")
            return BUILT_IN

    def batch(changes: DataFrame, number: int) -> None:
        changes = changes.persist()
        now = changes.where(F.col("kind") != CONFIG)
        if number and checkpoint and not changes.where(F.col("kind") == CONFIG).isEmpty():
            others = open_documents(changes.sparkSession, checkpoint, number - 1).join(now.select("uri").distinct(), "uri", "left_anti")
            now = now.unionByName(changes_of(others))
        now = now.persist()
        rules = current_rules()
        lines = synthetic_lines(now)
        if diff_of is not None:
            silent = now.where("line is null and kind <> 'close'").select("uri").distinct()
            lines = lines.unionByName(diff_of().join(silent, F.col("path") == F.col("uri"), "left_semi").withColumn("diff_id", F.col("path")).select(*lines.columns))
        found = diagnostics(findings(find_events(lines, rules), rules))
        listed = F.array_sort(F.collect_list(F.struct("line", "start_char", "message", "end_char", "severity", "code"))).alias("diagnostics")
        rows = now.groupBy("uri").agg(F.max("version").alias("version")).join(found.groupBy(F.col("path").alias("uri")).agg(listed), "uri", "left")
        publish(rows.withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast(rows.schema["diagnostics"].dataType))).orderBy("uri"), number)
        now.unpersist()
        changes.unpersist()

    writer = document_changes(events).writeStream.outputMode("update").foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def publish_into(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for `diagnose_batches`: each batch has a folder of its own, so that one that is played again changes nothing."""

    def publish(rows: DataFrame, number: int) -> None:
        spark, folder = rows.sparkSession, f"{path}/batch={number}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
            rows.write.mode("overwrite").parquet(folder)  # what a broken try has left goes

    return publish


def published(spark: SparkSession, path: str) -> DataFrame:
    """(uri, version, diagnostics) of each document as it was published last."""
    last = F.max_by(F.struct("version", "diagnostics"), "batch").alias("last")
    return spark.read.parquet(path).groupBy("uri").agg(last).select("uri", "last.*")
