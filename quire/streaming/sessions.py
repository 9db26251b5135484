"""Edit sessions and versions: as batch folds and as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quire.operators.search import term_hits
from quire.sources.catalog import doc_key, base_name, save_latest
from quire.streaming.logs import fold_log, history_step, versions_step

KEEP_VERSIONS, KEEP_EDITS = 20, 60
#: Of the table that upserts go to.
BUCKETS = 256


def autosave(changes: DataFrame, quiet: str, watermark: str | None = None) -> DataFrame:
    """One save per burst of changes (stage, ts, state), once it has been quiet so long: the last state.

    On a stream, rows later than the watermark are dropped and a burst is given out once the
    watermark has passed its end.
    """
    timed = changes.withWatermark("ts", watermark) if watermark else changes
    return timed.groupBy("stage", F.session_window("ts", quiet).alias("w")).agg(F.max_by("state", F.struct("ts", "state")).alias("state"), F.count(F.lit(1)).alias("changes")).select(
        "stage", F.col("w.start").alias("start"), "state", "changes")


def version_stack(log: DataFrame, keep: int = KEEP_VERSIONS) -> DataFrame:
    """current, versions (older ones, oldest first) and errors (undos of nothing) per stage of a log (stage, seq, op, state)."""
    found = fold_log(log.where("op IN ('save', 'undo')"), versions_step(keep))
    return found.select("stage", "left.current", F.col("left.done").alias("versions"), F.col("errors").cast("int").alias("errors"))


def edit_history(log: DataFrame, keep: int = KEEP_EDITS) -> DataFrame:
    """current, done and undone per stage of a log with save, undo and redo. An unchanged save is passed over; a save clears what was undone."""
    return fold_log(log, history_step(keep)).select("stage", "left.current", "left.done", "left.undone")


def stream_versions(log: DataFrame, keep: int = KEEP_VERSIONS) -> DataFrame:
    """version_stack on a stream of (stage, seq, op, state): a row per stage with news. State is one list per stage, at most keep + 1 long."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, versions, errors = state.get if state.exists else (None, [], 0)
        versions = list(versions)
        rows = pd.concat(list(batches)).sort_values("seq")
        for op, value in zip(rows["op"], rows["state"]):
            if op == "save":
                if current is not None:
                    versions = [*versions, current][-keep:]
                current = value
            elif op == "undo" and versions:
                current = versions.pop()
            elif op == "undo":
                errors += 1
        state.update((current, versions, errors))
        yield pd.DataFrame({"stage": [key[0]], "current": [current], "remaining": [len(versions)], "errors": [errors]})

    return log.withColumn("stage", F.col("stage").cast("string")).groupBy("stage").applyInPandasWithState(run, "stage string, current string, remaining int, errors int", "current string, versions array<string>, errors int", "update", GroupStateTimeout.NoTimeout)


def ingest_stream(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """New files below a path as a catalogue, equal contents once within the delay."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return catalogued(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path), delay)


def catalogued(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same of any stream of files (path, modificationTime, length, content)."""
    named = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha"), doc_key(base_name("path"), "length").alias("doc_id"))
    return named.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["sha"])


def scan_stream(segments: DataFrame, terms: list[str]) -> DataFrame:
    """Terms in arriving segments; stateless, so batches may come in any size."""
    return term_hits(segments, terms)


def merge_batch(batch: DataFrame, path: str, n: int, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Merge batch n into the table of the latest row per key below path.

    Keys are dealt into buckets by their hash. Only buckets with news are read and written
    anew, to data/batch=N; manifest/batch=N, written last, says which, so readers see all of a
    batch or nothing, and a batch that is run again after a failure replaces its own files.
    """
    spark = batch.sparkSession
    news = batch.withColumn("bucket", bucket_of(key, buckets)).persist()
    touched = sorted(r["bucket"] for r in news.select("bucket").distinct().collect())  # as many as buckets at most
    held = located(spark, path, n)
    old = [f"{path}/data/batch={held[b]}/bucket={b}" for b in touched if b in held]
    rows = news.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", bucket_of(key, buckets))) if old else news
    save_latest(rows, key).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={n}")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={n}")
    news.unpersist()


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def located(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The batch that holds each bucket, of all batches or those before the given one."""
    try:
        found = spark.read.schema("bucket int, batch int").parquet(f"{path}/manifest")
    except AnalysisException as lacking:
        if lacking.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found = found if before is None else found.where(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in found.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def latest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table as the last finished batch left it."""
    files = [f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(located(spark, path).items())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Keep the latest row per key of a stream below path, batch by batch; `latest` reads it."""
    return stream.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, path, n, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
