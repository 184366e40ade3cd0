"""Histories of runs as a stream, over restarts, against the same runs as a table."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hunksieve.operators import history
from hunksieve.schemas import TREND_RUN
from hunksieve.streaming import runs

SCHEMA = f"history string, {TREND_RUN}"


def run(name, k, start, warn=None):
    return (name, None, start, f"e{k}", 1, "b", None, "added", "pass", (k, warn, 0, 2), 1, 2, k * k)


def test_histories(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    state, told = str(tmp_path / "state"), []

    def feed(name, rows):
        """A new start of the stream each time."""
        told.clear()
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        writer = runs.trends_of_runs(stream, 3).writeStream.outputMode("update").foreachBatch(lambda df, n: told.extend(df.collect()))
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        kept = runs.runs_kept(spark, state)
        assert kept.drop("history").schema.simpleString() == spark.createDataFrame([], TREND_RUN).schema.simpleString()
        for r in told:  # what was said in the batch is what the table of the kept runs gives
            own = kept.where(F.col("history").eqNullSafe(r.history))
            assert r[2:8] == tuple(history.trend_totals(own).first())
            delta = history.trend_delta(own).collect()
            assert r[8:] == (tuple(delta[0])[1:] if delta else (None,) * 5) and r.seq == own.agg(F.max("seq")).first()[0]
        return {n: [(r.seq, r.started_at, r.counts.warn) for r in kept.where(F.col("history").eqNullSafe(n)).orderBy("seq").collect()] for n in ("a", "b", None)}

    got = feed("1", [run("a", 2, "s2", 5), run("a", 1, "s1"), run("b", 3, "s1", 1), run(None, 1, None)])
    assert got == {"a": [(0, "s1", None), (1, "s2", 5)], "b": [(0, "s1", 1)], None: [(0, None, None)]} and len(told) == 3
    got = feed("2", [run("a", k, f"s{k}", k) for k in (6, 4, 5, 3)])
    assert got["a"] == [(3, "s4", 4), (4, "s5", 5), (5, "s6", 6)] and got["b"] == [(0, "s1", 1)] and len(told) == 1
    got = feed("3", [run("b", 3, "s1", 1), run("b", 3, "s1", 1), run("b", 3, "s1", 1)])
    assert [n for n, *_ in got["b"]] == [1, 2, 3]
    with pytest.raises(ValueError):
        runs.trends_of_runs(spark.createDataFrame([], SCHEMA), 0)


def test_only_the_newest_runs_are_held():
    """Of a batch's runs no more are held than can be kept, and frames are not made for each history."""
    state = []

    class List:
        def get(self):
            return iter(state)

        def put(self, rows):
            state[:] = rows

    histories = runs.Histories(2)
    histories.runs = List()
    fields = [*runs.TEXTS, *runs.NUMBERS]
    each = lambda k: Row(**dict.fromkeys(fields, None) | {"started_at": f"s{k:03}", "findings": k})
    (got,) = histories.handleInputRows(("a",), (each(k) for k in reversed(range(200))), None)
    assert [(r[0], r[1]) for r in state] == [(198, "s198"), (199, "s199")]
    assert got[:3] == ("a", 199, 2) and got[7] == 198 + 199 and got[-1] == 1
