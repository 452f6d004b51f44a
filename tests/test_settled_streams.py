"""Streams whose settings change while they run."""

import os
import shutil

from pyspark.sql import functions as F

import veilspark as v
from veilspark.streaming import settled

SCHEMA = "k int, scope string, text string"
LOG = "scope string, enabled boolean, maskingMode string, useML boolean, version long"
FIRST = [
    (1, "on", "call 206-555-0001"), (2, "off", "call 206-555-0002"), (3, "none", "mail a@b.org"),
    (4, "off", None), (5, "on", " "), (6, None, "call 206-555-0006"),
]
SECOND = [(10, "on", "call 206-555-0010"), (11, "off", "call 206-555-0011"), (12, "none", "mail c@d.org"), (13, "on", "x")]
V1 = [("on", True, None, True, 1), ("off", False, None, True, 1)]
V2 = [("on", False, None, True, 2), ("off", True, None, None, 2)]


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_change_without_restart(spark, tmp_path):
    source, log, out = (str(tmp_path / n) for n in ("in", "log", "out"))
    os.makedirs(source)
    stream = v.read_message_stream(spark, source, SCHEMA)
    read = v.settings_log(spark, log)
    assert read().count() == 0 and read().columns == ["scope", "enabled", "maskingMode", "useML", "version"]
    query = v.write_settled(stream, read, v.mask_settled, out, "masks", interval="1 second")
    try:
        put(spark, [(0, "off", "call 206-555-0000")], SCHEMA, source)  # before there are settings
        query.processAllAvailable()
        put(spark, V1, LOG, log)
        put(spark, FIRST, SCHEMA, source)
        query.processAllAvailable()
        put(spark, V2, LOG, log)
        put(spark, SECOND, SCHEMA, source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = {tuple(r) for r in spark.read.parquet(out).select("k", "settings_version", "masked").collect()}
    expected = {(0, None, "call [REDACTED_PHONE]")}
    for rows, at in ((FIRST, 1), (SECOND, 2)):
        batch = v.mask_settled(spark.createDataFrame(rows, SCHEMA), v.settings_as_of(read(), at))
        expected |= {(r["k"], at, r["masked"]) for r in batch.collect()}
    assert got == expected
    assert {(2, 1, "call 206-555-0002"), (11, 2, "call [REDACTED_PHONE]"), (10, 2, "call 206-555-0010")} <= got
    assert {(3, 1, "mail [REDACTED_EMAIL]"), (4, 1, None), (5, 1, " "), (6, 1, "call [REDACTED_PHONE]")} <= got


def halves(spark, tmp_path, write):
    """Two triggers, with the log as of version 1 and then 2."""
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    read = v.settings_log(spark, log)
    for rows, change in ((FIRST, V1), (SECOND, V2)):
        put(spark, change, LOG, log)
        put(spark, rows, SCHEMA, source)
        write(v.read_message_stream(spark, source, SCHEMA), read).awaitTermination()
    return read


def test_alerts_and_cascade(spark, tmp_path):
    out = str(tmp_path / "alerts")
    halves(spark, tmp_path / "a", lambda s, r: v.write_settled(s, r, v.alert_settled, out, "alerts"))
    rows = spark.read.parquet(out)
    assert {tuple(r) for r in rows.select("k", "settings_version").collect()} == {(1, 1), (3, 1), (6, 1), (11, 2), (12, 2)}
    out = str(tmp_path / "cascade")

    def act(rows, settings):
        return v.mask_settled(rows, settings, cascade=True).select("k", "masked")

    halves(spark, tmp_path / "c", lambda s, r: v.write_settled(s, r, act, out, "cascade"))
    masked = {r["k"]: r["masked"] for r in spark.read.parquet(out).collect()}
    assert masked[1] == "call [REDACTED_PHONE]" and masked[2] == "call 206-555-0002" and masked[10] == "call 206-555-0010"


def test_mappings(spark, tmp_path):
    store = str(tmp_path / "store")
    halves(spark, tmp_path, lambda s, r: v.flush_settled(s, r, store, F.col("k"), "flush"))
    assert {tuple(r) for r in v.load_mappings(spark, store).collect()} == {
        ("on", "[REDACTED_PHONE]", "206-555-0001"), ("off", "[REDACTED_PHONE]", "206-555-0011"),
        ("none", "[REDACTED_EMAIL]", "c@d.org"), (None, "[REDACTED_PHONE]", "206-555-0006"),
    }


def test_a_trigger_run_again_takes_the_version_it_noted(spark, tmp_path):
    """The last trigger's commit is lost, as when the driver dies; settings change before the restart."""
    source, log, out, place = (str(tmp_path / n) for n in ("in", "log", "out", "place"))
    read = v.settings_log(spark, log)
    put(spark, V1, LOG, log)
    put(spark, FIRST, SCHEMA, source)

    def run():
        stream = v.read_message_stream(spark, source, SCHEMA)
        v.write_settled(stream, read, v.mask_settled, out, "again", checkpoint=place).awaitTermination()
        return sorted(map(repr, spark.read.parquet(out).select("k", "settings_version", "masked").collect()))

    before = run()
    commits = sorted(os.listdir(f"{place}/commits"))
    for file in os.listdir(f"{place}/commits"):
        os.remove(f"{place}/commits/{file}")
    put(spark, V2, LOG, log)
    written = set(os.listdir(f"{out}"))
    assert run() == before
    assert sorted(os.listdir(f"{place}/commits")) == commits and set(os.listdir(out)) == written
    shutil.rmtree(f"{place}/settings")


def test_version_may_be_a_time(spark, tmp_path):
    rows = [("s", True, None, True, "2024-01-01"), ("s", False, None, True, "2024-03-01")]
    log = spark.createDataFrame(rows, LOG.replace("version long", "version string")).withColumn("version", F.to_timestamp("version"))
    at = log.agg(F.max("version")).first()[0]
    assert not v.settings_as_of(log, at).first()["enabled"]
    early = log.where("version < '2024-02-01'").agg(F.max("version")).first()[0]
    assert v.settings_as_of(log, early).first()["enabled"]
    assert settled.settings_as_of(log, None).count() == 0
