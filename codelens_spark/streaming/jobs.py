"""Streaming versions of the live logs: action counts, category state, task progress.

Every job writes each micro-batch under its own epoch folder, so a replayed batch overwrites its own output and
nothing else. Counts and progress keep their state in the state store and write what changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.scan import Run, running


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], out: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{out}/_progress")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def stream_action_counts(actions: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
    """Running count and error count per action: actions(action, level). The counts live in the state store; every
    micro-batch writes the actions that changed under its epoch. `read_action_counts` gives the latest of each."""
    counts = actions.groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.col("level") >= 3).alias("errors"))

    def work(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts/epoch={epoch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", f"{out}/_progress")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def read_action_counts(spark: SparkSession, out: str) -> DataFrame:
    """(action, n, errors) after the last written micro-batch."""
    changes = read_state(spark, f"{out}/counts")
    latest = changes.groupBy("action").agg(F.max_by(F.struct("n", "errors"), "epoch").alias("last"))
    return latest.select("action", "last.n", "last.errors")


class _Categories(StatefulProcessor):
    """Per big category: its small categories with their counts, in the state store.

    Hands on the batch's events (kind 0) and one row per category that they change (kind 1): how often it came, its
    first place in the batch, and whether it is new. Rows are taken piece by piece, so a batch of one category needs
    memory for its different small categories only. Null is a category like any other.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.smalls = handle.getMapState("smalls", "known boolean, small string", "n bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        big, added, first = key[0], {}, {}
        new_big = not self.smalls.exists()
        for part in rows:
            events = part[["ord", "small"]].astype({"small": object})
            yield pd.DataFrame({"kind": 0, "ord": events["ord"], "big": big, "small": events["small"], "n": 1, "new_small": False, "new_big": False})
            for small, places in events.groupby("small", dropna=False)["ord"]:
                small = None if pd.isna(small) else small
                added[small] = added.get(small, 0) + len(places)
                first[small] = min(first.get(small, places.min()), places.min())
        changes = []
        for small, count in added.items():
            name = (small is not None, small or "")
            old = self.smalls.getValue(name)[0] if self.smalls.containsKey(name) else None
            self.smalls.updateValue(name, ((old or 0) + count,))
            changes.append((1, first[small], big, small, count, old is None, False))
        if changes:
            out = pd.DataFrame(changes, columns=["kind", "ord", "big", "small", "n", "new_small", "new_big"])
            out.loc[out["ord"].idxmin(), "new_big"] = new_big
            yield out

    def close(self) -> None:
        pass


class _FirstReport(StatefulProcessor):
    """Per task: a flag that it has been reported, in the state store."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            row = part.loc[[part["ord"].idxmin()], ["task", "ord", "ok"]]
            best = row if best is None or row["ord"].iloc[0] < best["ord"].iloc[0] else best
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
NEEDED = {
    STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # state that expires by time asks for batches without data for ever, so a query that takes what is there would not end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _start_with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with the settings that its state needs; other queries of the session keep their own."""
    before = {key: spark.conf.get(key, None) for key in NEEDED}
    for key, value in NEEDED.items():
        spark.conf.set(key, value)
    try:
        return start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _time_mode(keep_ms: int | None) -> str:
    return "None" if keep_ms is None else "ProcessingTime"


def stream_category_state(events: DataFrame, out: str, available_now: bool = True, keep_ms: int | None = None) -> StreamingQuery:
    """Per event: total categorisations and distinct category counts after it: events(ord, big, small, ...).

    The categories live in the state store, by big category; an epoch reads and writes only what changed in it, beside
    one row of totals. Null is a category. With `keep_ms` a small category that has not come for that long is forgotten,
    and is new when it comes again; without it all are kept.
    """
    changes, log, totals = (f"{out}/{name}" for name in ("changes", "log", "totals"))
    schema = "kind int, ord long, big string, small string, n long, new_small boolean, new_big boolean"
    rows = events.select(F.col("ord").cast("long").alias("ord"), "big", "small")
    marked = rows.groupBy("big").transformWithStateInPandas(_Categories(keep_ms), schema, "Append", _time_mode(keep_ms))

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")
        batch = spark.read.schema(schema).parquet(f"{changes}/epoch={epoch}")
        before = spark.read.parquet(f"{totals}/epoch={epoch - 1}").first() if epoch else {"total": 0, "bigs": 0, "smalls": 0}
        new = batch.filter("kind = 1").select("ord", F.col("new_small").cast("int").alias("ns"), F.col("new_big").cast("int").alias("nb"))
        # several categories may be new at one place only if places repeat
        new = new.groupBy("ord").agg(F.sum("ns").alias("ns"), F.sum("nb").alias("nb"))
        line = batch.filter("kind = 0").select("ord", "big", "small").join(new, "ord", "left").na.fill(0, ["ns", "nb"])
        seen = running(line, [], "ord", [Run("i", "sum", F.lit(1).cast("long")), Run("b", "sum", F.col("nb")), Run("s", "sum", F.col("ns"))], levels=2)
        counted = [(F.lit(before[name]) + F.col(c)).cast("long").alias(name) for name, c in (("total", "i"), ("bigs", "b"), ("smalls", "s"))]
        seen.select("ord", "big", "small", *counted).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        after = batch.filter("kind = 1").agg(
            (F.lit(before["total"]) + F.coalesce(F.sum("n"), F.lit(0))).alias("total"),
            (F.lit(before["bigs"]) + F.count_if("new_big")).alias("bigs"),
            (F.lit(before["smalls"]) + F.count_if("new_small")).alias("smalls"),
        )
        after.coalesce(1).write.mode("overwrite").parquet(f"{totals}/epoch={epoch}")

    return _start_with_state(events.sparkSession, lambda: _start(marked, work, out, available_now))


def stream_progress(done: DataFrame, out: str, available_now: bool = True, keep_ms: int | None = None) -> StreamingQuery:
    """First completion of each task, written once however often it is reported: done(task, ord, ok).

    One flag per task is kept in the state store; of a task's reports in its first micro-batch the least `ord` counts.
    With `keep_ms` flags are dropped that long after the first report, so the state holds the tasks of that time only,
    and a report that comes later still counts as a first one.
    """
    state = f"{out}/tasks"
    firsts = done.select("task", "ord", "ok").groupBy("task").transformWithStateInPandas(
        _FirstReport(keep_ms), "task bigint, ord bigint, ok boolean", "Append", _time_mode(keep_ms)
    )

    def work(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    return _start_with_state(done.sparkSession, lambda: _start(firsts, work, out, available_now))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def action_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines action log as a stream."""
    from ..sources.schemas import ACTION

    return spark.readStream.schema(ACTION).json(path)
