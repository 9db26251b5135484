"""Streams with state of their own per stage: edit histories, and stages that go stale.

State lives in the state store (RocksDB), so it survives lost executors and restarts; the
session needs STORE set to PROVIDER, as `delivered` does while it runs a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.sources.staging import new_folder
from quire.streaming.logs import Left, history_step

STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = "stage string, current string, done array<string>, undone array<string>"


def delivered(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is now; what it puts out, with the number of the batch, from the shared folder. A batch that is run again replaces its own files."""
    spark = stream.sparkSession
    folder, kept = new_folder(spark, "stream"), spark.conf.get(STORE, None)
    spark.conf.set(STORE, PROVIDER)
    try:
        job = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        job.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, kept) if kept else spark.conf.unset(STORE)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return spark.read.schema(f"{kinds}, batch int").parquet(f"{folder}/out")


class History(StatefulProcessor):
    """The edit history of a stage: its current state as a value, what was done and undone as lists, at most so many each."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.step, self.ttl_ms = history_step(keep), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "value string", self.ttl_ms)
        self.done = handle.getListState("done", "value string", self.ttl_ms)
        self.undone = handle.getListState("undone", "value string", self.ttl_ms)

    def left(self) -> Left:
        lists = [tuple(x[0] for x in state.get()) if state.exists() else () for state in (self.done, self.undone)]
        return Left(self.current.get()[0] if self.current.exists() else None, *lists)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = self.left()
        events = pd.concat(list(rows)).sort_values("seq")
        for op, state in zip(events["op"], events["state"]):
            left, _ = self.step(left, op, state if isinstance(state, str) else None)
        self.current.update((left.current,))
        for state, values in ((self.done, left.done), (self.undone, left.undone)):
            state.put([(v,) for v in values]) if values else state.clear()
        yield pd.DataFrame({"stage": [key[0]], "current": [left.current], "done": [list(left.done)], "undone": [list(left.undone)]})

    def close(self) -> None:
        pass


def stream_history(log: DataFrame, keep: int = 60, ttl_ms: int | None = None) -> DataFrame:
    """edit_history on a stream of (stage, seq, op, state): a row per stage with news, its history as it is then.

    Events of a stage must arrive in batches that follow its order; within a batch they are
    ordered here. With a time to live, a stage untouched for so long starts afresh.
    """
    named = log.withColumn("stage", F.col("stage").cast("string"))
    return named.groupBy("stage").transformWithStateInPandas(
        History(keep, ttl_ms), outputStructType=HISTORY, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


class Stale(StatefulProcessor):
    """The time of a stage's last change, and a timer for when it is too old."""

    def __init__(self, most_ms: int):
        self.most_ms = most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["ms"].max()) for part in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.most_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.most_ms)
        yield pd.DataFrame({"stage": pd.Series(dtype="str"), "ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"stage": [key[0]], "ms": [last]})

    def close(self) -> None:
        pass


def stream_stale(changes: DataFrame, hours: float, delay: str = "0 seconds") -> DataFrame:
    """stage and last of each stage of a stream (stage, ts) once the watermark has passed its last change by so many hours; it is forgotten then."""
    timed = changes.select(F.col("stage").cast("string").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).withWatermark("ts", delay)
    gone = timed.groupBy("stage").transformWithStateInPandas(Stale(int(hours * 3_600_000)), outputStructType="stage string, ms long", outputMode="Append", timeMode="EventTime")
    return gone.select("stage", F.timestamp_millis("ms").alias("last"))
