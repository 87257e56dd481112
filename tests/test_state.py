"""Versions, batches that count once, job states and what was written where."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import content_key
from colloquy.sources import ingest, versions
from colloquy.streaming import status

NOTE = "file string, id int, text string"


def test_versions_follow_one_another_and_writers_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None and versions.history(spark, path) == []
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    one, two = spark.range(3), spark.range(5)
    assert versions.commit(one, path, 0).rows == 3
    old = versions.read(spark, path)
    assert versions.commit(two, path, 1).number == 2
    with pytest.raises(versions.Conflict):
        versions.commit(one, path, 1)
    assert (old.count(), versions.read(spark, path).count(), versions.read(spark, path, 1).count()) == (3, 5, 3)
    assert versions.commit(one.limit(0), path).rows == 0 and versions.read(spark, path).columns == ["id"]
    versions.trimmed(spark, path, 1)
    assert versions.history(spark, path) == [3] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_a_commit_that_dies_before_the_rename_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit(spark.range(3), path)
    kept = versions._hadoop

    def broken(session, where):
        if "/versions/_" in where:
            raise OSError("lost")
        return kept(session, where)

    monkeypatch.setattr(versions, "_hadoop", broken)
    with pytest.raises(OSError):
        versions.commit(spark.range(9), path)
    monkeypatch.undo()
    assert versions.read(spark, path).count() == 3 and versions.commit(spark.range(4), path).number == 2


def notes(spark, rows):
    return spark.createDataFrame(rows, NOTE)


def test_batches_of_notes_count_once_and_failed_keys_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    failed = lambda batch: batch.filter("text like 'bad%'")
    apply = versions.once(path, "notes", ingest.synced(["file", "id"], ["file"], failed))
    apply(notes(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("c", 9, "bad new")]), 0)
    again = notes(spark, [("a", 1, "bad x"), ("a", 4, "w"), ("b", 3, None)])
    for _ in range(2):
        apply(again, 1)
    got = {(r.file, r.id, r.text, r.content_hash) for r in versions.read(spark, path).collect()}
    hashed = lambda t: spark.range(1).select(content_key(F.lit(t))).first()[0]
    assert got == {("a", 1, "x", hashed("x")), ("a", 4, "w", hashed("w"))}
    assert versions.history(spark, path) == [1, 2]
    other = versions.once(path, "other", ingest.synced(["file", "id"], ["file"]))
    other(notes(spark, [("d", 5, "v")]), 0)  # another stream's first batch
    assert versions.current(spark, path).batches == {"notes": 1, "other": 0}


def test_streamed_files_reach_the_store_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "store")
    apply = versions.once(path, "files", ingest.synced(["file", "id"], ["file"]))
    died = []

    def flaky(batch, number):
        apply(batch, number)
        if not died:
            died.append(number)
            raise RuntimeError("after the commit, before the stream's own")

    for step, text in enumerate(('{"file": "a", "id": 1, "text": "x"}', '{"file": "b", "id": 2, "text": "y"}')):
        (tmp_path / "in" / f"{step}.json").write_text(text)
        for _ in range(2):
            query = status.ingest(spark, str(tmp_path / "in"), NOTE, str(tmp_path / "checkpoint"), flaky)
            try:
                query.awaitTermination(90)
            except Exception as error:  # noqa: BLE001
                assert "after the commit" in str(error)
    assert {(r.file, r.id, r.text) for r in versions.read(spark, path).collect()} == {("a", 1, "x"), ("b", 2, "y")}
    assert versions.history(spark, path) == [1, 2]


def test_index_is_read_as_written_and_counts_are_compared(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", ["s"]), ("b", "y", None)], "id string, text string, sources array<string>")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    path = str(tmp_path / "index")
    assert ingest.index_written(rows, vectors, "id", "m", path) == 2
    got = {(r.embed_model, r.id, r.text, tuple(r.sources), tuple(r.embedding)) for r in ingest.index(spark, path, lines=True).collect()}
    assert got == {("m", "a", "x", ("s",), (1.0,)), ("m", "b", "y", (), (2.0,))}
    with pytest.raises(ValueError, match="2 rows and 1 vectors"):
        ingest.index_written(rows, vectors.limit(1), "id", "m", path)
    twice = vectors.limit(1).unionByName(vectors.limit(1))
    with pytest.raises(Exception, match="several vectors for a|no vector for b"):
        ingest.index_written(rows, twice, "id", "m", path)


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_job_states(spark):
    rows = [
        ("new", 0, "queued"), ("done", 0, "queued"), ("done", 1, "cached"), ("late", 0, "queued"), ("failed", 0, "queued"), ("failed", 3, "failed"), ("again", 0, "queued"), ("again", 3, "failed"),
        ("again", 4, "queued"), ("ready", 0, "cached"), ("ready", 4, "queued"), ("future", 50, "queued"),
    ]
    events = spark.createDataFrame([(k, at(-20 if k == "late" else m), s) for k, m, s in rows], "key string, time timestamp, kind string")
    got = {r.key: (r.ready, r.pending) for r in status.job_states(events, "key", "time", "kind", F.lit(at(5)), timedelta(minutes=10)).collect()}
    assert got == {"new": (False, True), "done": (True, False), "late": (False, False), "failed": (False, False), "again": (False, True), "ready": (True, False)}


def test_streamed_jobs_are_dropped_at_their_deadline(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "key string, time timestamp, kind string"
        (tmp_path / "in").mkdir()
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        seen = {}

        def kept(batch, _):
            for r in batch.collect():
                seen.setdefault(r.key, []).append((r.ready, r.pending))

        batches = [[("a", 0, "queued"), ("b", 0, "queued"), ("c", 0, "queued")], [("b", 1, "cached"), ("c", 2, "failed")], [("b", 3, "queued"), ("z", 60, "queued")], [("z", 61, "cached")]]
        for number, rows in enumerate(batches):
            lines = [f'{{"key": "{k}", "time": "{at(m).isoformat()}Z", "kind": "{s}"}}' for k, m, s in rows]
            (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))
            updates = status.job_updates(events, "key", "time", "kind", timedelta(minutes=10), "1 minute")
            query = updates.writeStream.foreachBatch(kept).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination(120)
        assert seen["a"] == [(False, True), (False, False)]  # dropped by its timer
        assert seen["b"] == [(False, True), (True, False), (True, False)] and seen["c"] == [(False, True), (False, False)]
        assert seen["z"] == [(False, True), (True, False)]
    finally:
        spark.conf.set(provider, before)


def test_rests_of_keys_are_joined(spark):
    rows = [("a", 0), ("a", 5), ("a", 15), ("a", 40), ("b", 1)]
    events = spark.createDataFrame([(k, at(m)) for k, m in rows], "key string, time timestamp")
    got = {(r.key, r.start, r.stop, r.limits) for r in status.cooling(events, "key", "time", timedelta(minutes=10)).collect()}
    assert got == {("a", at(0), at(25), 3), ("a", at(40), at(50), 1), ("b", at(1), at(11), 1)}
