"""Versions, histories and bursts, as batch and as stream."""

from pyspark.sql import functions as F

from quire.operators import search as S
from quire.streaming import sessions as R

LOG = "stage long, seq long, op string, state string"


def test_versions(spark):
    rows = [(1, i, "save", f"s{i}") for i in (1, 2, 3)]
    now = R.version_stack(spark.createDataFrame(rows, LOG)).first()
    assert (now.current, now.versions, now.errors) == ("s3", ["s1", "s2"], 0)
    rows += [(1, 4, "undo", None)]
    now = R.version_stack(spark.createDataFrame(rows, LOG)).first()
    assert (now.current, now.versions) == ("s2", ["s1"])
    now = R.version_stack(spark.createDataFrame([*rows, (1, 5, "undo", None), (1, 6, "undo", None)], LOG)).first()
    assert (now.current, now.versions, now.errors) == ("s1", [], 1)
    many = R.version_stack(spark.createDataFrame([(1, i, "save", f"s{i}") for i in range(50)], LOG)).first()
    assert many.versions == [f"s{i}" for i in range(29, 49)]


def test_history(spark):
    ops = [("save", "a"), ("save", "a"), ("save", "b"), ("undo", None), ("redo", None), ("undo", None), ("save", "c"), ("redo", None)]
    now = R.edit_history(spark.createDataFrame([(1, i, *o) for i, o in enumerate(ops)], LOG)).first()
    assert (now.current, now.done, now.undone) == ("c", ["a"], [])


def test_version_stream_equals_fold(spark, tmp_path):
    rows = [(i % 3, i, "undo" if i % 4 == 3 else "save", f"s{i}") for i in range(40)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    job = R.stream_versions(stream).writeStream.outputMode("update").format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = {r.stage: (r.current, r.remaining, r.errors) for r in spark.table("versions").collect()}
    want = {str(r.stage): (r.current, len(r.versions), r.errors) for r in R.version_stack(spark.createDataFrame(rows, LOG)).collect()}
    assert got == want


def test_autosave_stream(spark, tmp_path):
    schema = "stage long, ts timestamp, state string"
    rows = [(1, "2026-01-01 00:00:00", "a"), (1, "2026-01-01 00:00:05", "b"), (1, "2026-01-01 00:05:00", "c"), (2, "2026-01-01 01:00:00", "close")]
    data = spark.createDataFrame(rows, "stage long, t string, state string").select("stage", F.to_timestamp("t").alias("ts"), "state")
    assert sorted((r.stage, r.state, r.changes) for r in R.autosave(data, "10 seconds").collect()) == [(1, "b", 2), (1, "c", 1), (2, "close", 1)]
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = R.autosave(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 seconds", "1 second")
    job = stream.writeStream.outputMode("append").format("memory").queryName("saves").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted((r.stage, r.state) for r in spark.table("saves").collect()) == [(1, "b"), (1, "c")]


def test_ingest_scan_and_upsert(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name, body in (("a.pdf", b"%PDF one"), ("b.pdf", b"%PDF one"), ("c.pdf", b"%PDF two")):
        (tmp_path / "files" / name).write_bytes(body)
    job = R.ingest_stream(spark, str(tmp_path / "files")).writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.table("files").select("sha").distinct().count() == spark.table("files").count() == 2
    segs = spark.createDataFrame([(1, ["the cat"]), (2, ["dog"])], "doc_id long, lines array<string>")
    segs.coalesce(1).write.parquet(str(tmp_path / "segs"))
    found = R.scan_stream(spark.readStream.schema(segs.schema).parquet(str(tmp_path / "segs")), ["cat", "do"])
    job = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, S.term_hits(segs, ["cat", "do"]).collect()))
    notes = spark.createDataFrame([("d", 1.0, "old"), ("d", 2.0, "new"), ("e", 1.0, "x")], "doc_id string, updated double, body string")
    notes.coalesce(1).write.parquet(str(tmp_path / "notes"))
    R.upsert_latest(spark.readStream.schema(notes.schema).parquet(str(tmp_path / "notes")), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert sorted((r.doc_id, r.body) for r in R.latest(spark, str(tmp_path / "out"), notes.schema).collect()) == [("d", "new"), ("e", "x")]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "doc_id long, updated double, body string"
    R.merge_batch(spark.createDataFrame([(i, 1.0, "first") for i in range(500)], schema), path, 0, buckets=32)
    news = spark.createDataFrame([(i, 2.0, "second") for i in (7, 8, 9, 1000)] + [(10, 0.5, "late")], schema)
    for _ in range(2):  # run again, it replaces its own files
        R.merge_batch(news, path, 1, buckets=32)
        held = R.located(spark, path)
        touched = {r[0] for r in news.select(R.bucket_of("doc_id", 32)).collect()}
        assert {b for b, n in held.items() if n == 1} == touched and len(touched) <= 5 and len(held) == 32
        assert {p.name for p in (tmp_path / "t" / "data" / "batch=1").glob("bucket=*")} == {f"bucket={b}" for b in touched}
        rows = R.latest(spark, path, schema).collect()
        assert len(rows) == 501 and {r.doc_id for r in rows if r.body == "second"} == {7, 8, 9, 1000} and not [r for r in rows if r.body == "late"]
