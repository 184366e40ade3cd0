"""Histories of runs as a stream: the newest runs of each are a list in the stream's state, and trends come out with each batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.verdict import LEVELS

COUNTED = (*LEVELS, "suppressed", "findings")
#: A run in the state: TREND_RUN with its counts as fields.
TEXTS = ("started_at", "ended_at", "base", "head", "scope", "status")
NUMBERS = ("duration_ms", *LEVELS, "suppressed", "files_scanned", "lines_scanned", "findings")
KEPT = ", ".join(["seq long", *(f"{c} string" for c in TEXTS), *(f"{c} long" for c in NUMBERS)])
#: What a batch says of a history: its newest run, totals of the runs kept, and the newest run less the one before it.
TREND = ", ".join(["history string, seq long, run_count long", *(f"{c} long" for c in COUNTED), *(f"delta_{c} long" for c in COUNTED)])


class Histories(StatefulProcessor):
    """Numbers the runs of each history in the order they come in, and keeps the newest `most`."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", KEPT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = [*TEXTS, *NUMBERS]
        order = lambda r: [(x is not None, x) for x in r]
        # Runs that are no longer among the newest by the end are only counted.
        new: list[tuple] = []
        count = 0
        for row in rows:
            new.append(tuple(row[c] for c in fields))
            count += 1
            if len(new) > 2 * self.most + 64:
                new = sorted(new, key=order)[-self.most :]
        new = sorted(new, key=order)[-self.most :]
        kept = [tuple(r) for r in self.runs.get()]
        first = kept[-1][0] + 1 if kept else 0
        kept = (kept + [(first + count - len(new) + i, *r) for i, r in enumerate(new)])[-self.most :]
        self.runs.put(kept)

        of = lambda run: [run[1 + fields.index(c)] for c in COUNTED]
        totals = [sum(x or 0 for x in column) for column in zip(*map(of, kept), strict=True)]
        pairs = zip(of(kept[-1]), of(kept[-2]), strict=True) if len(kept) > 1 else [(None, None)] * len(COUNTED)
        deltas = [None if a is None or b is None else a - b for a, b in pairs]
        yield Row(*(c.split()[0] for c in TREND.split(", ")))(key[0], kept[-1][0], len(kept), *totals, *deltas)

    def close(self) -> None:
        pass


def trends_of_runs(runs: DataFrame, most: int) -> DataFrame:
    """TREND of each history with new runs in a micro-batch. runs: a stream of TREND_RUN with `history`; its seq doesn't count.

    Runs of one batch are put in order by when they began, then by when they ended and what else they say, nulls first; equal
    ones are runs of their own. Nothing is rewritten but the `most` runs of the histories that a batch has runs of. A batch that
    is played again finds the state that it found before.
    """
    if most < 1:
        raise ValueError("at least one run must be kept")
    flat = runs.select("history", *TEXTS, "duration_ms", *(F.col(f"counts.{c}").alias(c) for c in (*LEVELS, "suppressed")), "files_scanned", "lines_scanned", "findings")
    return flat.groupBy("history").transformWithState(Histories(most), TREND, outputMode="Update", timeMode="None")


def runs_kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """history and TREND_RUN of the runs that the stream of `trends_of_runs` with that checkpoint folder holds now."""
    state = spark.read.format("statestore").option("stateVarName", "runs").load(checkpoint)
    rows = state.select(F.col("key.history").alias("history"), "list_element.*")
    counts = F.struct(*LEVELS, "suppressed").alias("counts")
    return rows.select("history", "seq", "started_at", "ended_at", "duration_ms", "base", "head", "scope", "status", counts, "files_scanned", "lines_scanned", "findings")
