"""Logs folded in chunks, and as streams with state, against one fold from first to last."""

import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import logs, sessions, stateful

LOG = "stage long, seq long, op string, state string"


def plain(rows, step):
    left, errors = {}, {}
    for stage, _, op, state in sorted(rows, key=lambda r: r[1]):
        left[stage], wrong = step(left.get(stage, logs.Left()), op, state)
        errors[stage] = errors.get(stage, 0) + wrong
    return {s: (*left[s], errors[s]) for s in left}


def chunked(log, step, rows_each):
    found = logs.fold_log(log, step, rows_each).collect()
    return {r.stage: (r.left.current, tuple(r.left.done), tuple(r.left.undone), r.errors) for r in found}


def events(n, weights, stages=(1, 1, 2, None), seed=3):
    r = random.Random(seed)
    return [(r.choice(stages), i, r.choices(("save", "undo", "redo"), weights)[0], f"s{r.randrange(5)}") for i in range(n)]


@pytest.mark.parametrize(("weights", "keep"), [((6, 2, 2), 4), ((3, 4, 3), 20), ((1, 8, 1), 60)])
@pytest.mark.parametrize("step", [logs.versions_step, logs.history_step])
def test_chunks_agree_with_one_fold(spark, weights, keep, step):
    rows = events(600, weights)
    assert chunked(spark.createDataFrame(rows, LOG), step(keep), 40) == plain(rows, step(keep))


def test_a_log_in_which_every_chunk_hangs_on_the_one_before(spark):
    rows = [(1, i, "save", f"s{i}") for i in range(60)] + [(1, 60 + i, "undo" if i % 3 else "redo", None) for i in range(90)]
    for step in (logs.versions_step(60), logs.history_step(60)):
        assert chunked(spark.createDataFrame(rows, LOG), step, 15) == plain(rows, step)


def test_nothing(spark):
    assert logs.fold_log(spark.createDataFrame([], LOG), logs.history_step(3)).count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.PROVIDER)
    yield
    spark.conf.set(key, before)


def test_history_stream_equals_fold(spark, tmp_path, rocks):
    rows = events(200, (5, 3, 2), (1, 2, 3))
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    job = stateful.stream_history(stream, 7).writeStream.outputMode("update").format("memory").queryName("histories").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert len(job.recentProgress) >= 4
    wanted = plain(rows, logs.history_step(7))
    news = spark.table("histories").collect()
    assert len(news) > len(wanted)
    # Of the news of a stage, the last is what the fold over all leaves.
    got = {}
    for r in news:
        got.setdefault(r.stage, []).append((r.current, tuple(r.done), tuple(r.undone)))
    assert {str(s): v[:3] for s, v in wanted.items()} == {s: v[-1] for s, v in got.items()}


def test_stale_stages(spark, tmp_path, rocks):
    changes = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 04:00:00"), (2, "2026-01-01 01:00:00"), (3, "2026-01-01 09:00:00")]
    for k, rows in enumerate((changes[:3], changes[3:], [(4, "2026-01-01 09:30:00")])):
        spark.createDataFrame(rows, "stage long, t string").select("stage", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("stage long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    job = stateful.stream_stale(stream, 6).writeStream.outputMode("append").format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    every = spark.createDataFrame(changes, "stage long, t string").select("stage", F.to_timestamp("t").alias("ts"))
    want = every.groupBy("stage").agg(F.max("ts").alias("last")).where("last < timestamp'2026-01-01 09:30:00' - interval 6 hours").collect()
    assert sorted((r.stage, r.last) for r in spark.table("stale").collect()) == sorted((str(r.stage), r.last) for r in want) and len(want) == 1


def test_sessions_use_the_folds(spark):
    log = spark.createDataFrame(events(300, (6, 3, 1), (1, 2)), LOG)
    left = plain([tuple(r) for r in log.where("op <> 'redo'").collect()], logs.versions_step(20))
    assert {r.stage: (r.current, tuple(r.versions), r.errors) for r in sessions.version_stack(log).collect()} == {s: (v[0], v[1], v[3]) for s, v in left.items()}
