"""A mapping store with several writers at once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

import veilspark as v
from veilspark.sources import mapping_log as log

SCHEMA = "scope string, mask string, value string"


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def content(spark, path, version=None):
    return {tuple(r) for r in log.load_logged(spark, path, version).collect()}


def test_versions_replays_and_rewrites(spark, frame, tmp_path):
    path = str(tmp_path / "store")
    assert content(spark, path) == set() and log.versions(spark, path) == []
    assert log.log_batch(frame(("s", "m", "1"), ("s", "n", "2")), path, 0, "a") == 1
    assert log.log_batch(frame(("s", "m", "3"), (None, "m", "x")), path, 1, "a") == 2
    assert log.log_batch(frame(("t", "m", "4")), path, 0, "b") == 3
    whole = {("s", "m", "3"), ("s", "n", "2"), (None, "m", "x"), ("t", "m", "4")}
    assert content(spark, path) == whole
    assert content(spark, path, 1) == {("s", "m", "1"), ("s", "n", "2")}
    # a batch written again takes its own place: what came later stays later
    log.log_batch(frame(("s", "m", "1b"), ("s", "n", "2")), path, 0, "a")
    assert content(spark, path) == whole
    log.compact_logged(spark, path)
    assert content(spark, path) == whole and len(log.manifest(spark, path)["folders"]) == 1
    # one that a rewrite has taken in does nothing; the next one counts
    before = log.manifest(spark, path)
    assert log.log_batch(frame(("s", "m", "old")), path, 1, "a") == before["version"]
    log.log_batch(frame(("s", "m", "5")), path, 2, "a")
    assert content(spark, path) == whole - {("s", "m", "3")} | {("s", "m", "5")}
    log.log_whole(frame(("u", "m", "only")), path)
    assert content(spark, path) == {("u", "m", "only")}
    log.log_batch(frame(("u", "m", "next")), path, 0, "a")
    assert content(spark, path) == {("u", "m", "next")}
    assert content(spark, path, 3) == whole  # until it is cleaned up
    assert log.vacuum_logged(spark, path) and log.vacuum_logged(spark, path) == []
    assert content(spark, path) == {("u", "m", "next")} and len(log.versions(spark, path)) == 1


def test_unfinished_writes_are_not_seen(spark, frame, tmp_path):
    path = str(tmp_path / "store")
    log.log_batch(frame(("s", "m", "1")), path, 0)
    log._write(frame(("s", "m", "never committed")), path)
    with open(f"{path}/_log/.draft", "w") as f:
        f.write("{")
    assert content(spark, path) == {("s", "m", "1")}
    assert log.log_batch(frame(("s", "m", "2")), path, 1) == 2


def test_second_writer_starts_from_the_first(spark, frame, tmp_path, monkeypatch):
    """Another commit comes between reading the manifest and making the next one."""
    path = str(tmp_path / "store")
    log.log_batch(frame(("s", "m", "1")), path, 0, "a")
    create, calls = log._create, []

    def late(session, place, made):
        calls.append(made["version"])
        if len(calls) == 1:
            log.log_batch(frame(("t", "m", "2")), path, 0, "b")
        return create(session, place, made)

    monkeypatch.setattr(log, "_create", late)
    assert log.log_batch(frame(("u", "m", "3")), path, 1, "a") == 3
    assert content(spark, path) == {("s", "m", "1"), ("t", "m", "2"), ("u", "m", "3")}
    assert calls == [2, 2, 3]


def test_rewrite_while_a_batch_is_replaced(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    log.log_batch(frame(("s", "m", "1")), path, 0, "a")
    log.log_batch(frame(("s", "n", "2")), path, 1, "a")
    commit, done = log._commit, []

    def late(session, place, change):
        if not done:
            done.append(True)
            log.log_batch(frame(("s", "m", "1 again")), path, 0, "a")
        return commit(session, place, change)

    monkeypatch.setattr(log, "_commit", late)
    log.compact_logged(spark, path)
    assert content(spark, path) == {("s", "m", "1 again"), ("s", "n", "2")}
    assert len(log.manifest(spark, path)["folders"]) == 2  # the rewrite gave way


def test_two_writers_and_rewrites_lose_nothing(spark, frame, tmp_path):
    path, errors = str(tmp_path / "store"), []

    def guarded(work):
        def run():
            try:
                work()
            except Exception as error:  # noqa: BLE001
                errors.append(error)

        return threading.Thread(target=run)

    def writer(name):
        for batch in range(8):
            log.log_batch(frame((name, "last", str(batch)), (name, f"m{batch}", "x")), path, batch, name)

    def rewriter():
        for _ in range(5):
            log.compact_logged(spark, path)

    threads = [guarded(lambda: writer("a")), guarded(lambda: writer("b")), guarded(rewriter)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    log.compact_logged(spark, path)
    expected = {(s, f"m{b}", "x") for s in "ab" for b in range(8)} | {("a", "last", "7"), ("b", "last", "7")}
    assert content(spark, path) == expected


def test_streams_into_one_store(spark, tmp_path):
    """Two streams and a rewrite share a store; a stream goes on from its checkpoint."""
    store = str(tmp_path / "store")
    schema = "k int, scope string, text string"
    rows = [(i, f"s{i % 3}", f"call 206-555-{i:04d}") for i in range(12)]
    for name, half in (("x", rows[:6]), ("y", rows[6:])):
        spark.createDataFrame(half, schema).repartition(3).write.parquet(str(tmp_path / name))
        stream = v.read_message_stream(spark, str(tmp_path / name), schema, max_files_per_trigger=1)
        query = v.flush_mappings(stream, store, "scope", F.col("k"), name, interval=None, compact_every=2, logged=True)
        query.awaitTermination()
    batch = v.latest_mappings(v.span_mapping_rows(v.detect_pii(spark.createDataFrame(rows, schema)), "scope", F.col("k")))
    assert content(spark, store) == {tuple(r) for r in batch.collect()}
    assert os.listdir(store).count("_log") == 1
