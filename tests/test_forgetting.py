"""Mapping stores fed by a stream whose state forgets idle scopes."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import veilspark as v
from veilspark.streaming import forgetting

SCHEMA = "k long, scope string, text string"
NUMBERS = [f"{i:03d}-45-67{i:02d}" for i in range(10, 60)]


@pytest.fixture
def stream(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("source", "store", "checkpoint"))

    def add(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(forget_after, name):
        texts = spark.readStream.schema(SCHEMA).parquet(source)
        query = v.flush_mappings(
            texts, store, "scope", F.col("k"), name, checkpoint=checkpoint, interval=None, forget_after=forget_after
        )
        assert query.awaitTermination(120)
        return query

    def content():
        return {tuple(r) for r in v.load_mappings(spark, store).select("scope", "mask", "value").collect()}

    def batch():
        rows = v.span_mapping_rows(v.detect_pii(spark.read.schema(SCHEMA).parquet(source)), "scope", F.col("k"))
        return {tuple(r) for r in v.latest_mappings(rows).select("scope", "mask", "value").collect()}

    return add, run, content, batch


def held(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_as_the_batch_over_restarts(stream):
    add, run, content, batch = stream
    add(*[(i, f"s{i % 4}", f"id {NUMBERS[i]} and a{i}@x.org") for i in range(20)], (20, None, "id 123-45-6789"), (21, "s0", None))
    run(3600, "first")
    assert content() == batch() and len(content()) > 4
    # later values, an earlier one that comes late, a new scope; after a restart
    add((30, "s1", f"id {NUMBERS[30]}"), (-5, "s2", f"id {NUMBERS[31]}"), (31, "new", f"id {NUMBERS[32]}"), (None, "s3", f"id {NUMBERS[33]}"))
    run(3600, "second")
    assert content() == batch()


def test_idle_state_goes_and_the_store_stays(stream):
    add, run, content, batch = stream
    add(*[(i, f"s{i}", f"id {NUMBERS[i]}") for i in range(20)])
    before = held(run(2, "first"))
    assert max(before) == 20
    time.sleep(3)
    add((100, "s3", f"id {NUMBERS[40]}"), (101, "t", f"id {NUMBERS[41]}"))
    after = held(run(2, "second"))
    assert after[-1] <= 2
    assert content() == batch() and len(content()) == 21
    # forgotten: what is earlier in the order counts as new
    time.sleep(3)
    add((1, "s7", f"id {NUMBERS[42]}"))
    run(2, "third")
    assert any(scope == "s7" and value == NUMBERS[42] for scope, _, value in content())


def test_rows_are_reduced_before_they_meet(monkeypatch):
    rows = pd.DataFrame({"scope": ["a", None] * 500, "mask": "m", "value": [str(i) for i in range(1000)], "message": range(1000), "no": 0})
    out = list(forgetting._reduced(iter([rows, rows.assign(message=-1), rows])))
    assert [len(x) for x in out] == [2] and sorted(out[0]["value"]) == ["998", "999"]
    monkeypatch.setattr(forgetting, "ROWS_HELD", 2)
    assert [len(x) for x in forgetting._reduced(iter([rows, rows]))] == [2, 2]
    assert list(forgetting._reduced(iter([]))) == []


def test_orders(spark):
    def first(order, kind):
        df = spark.createDataFrame([(order,)], f"x {kind}")
        return df.select(forgetting._long(F.col("x"), df.schema["x"].dataType)).first()[0]

    import datetime

    assert first(5, "int") == 5 and first(None, "long") == -(2**63)
    assert first(datetime.date(1970, 1, 2), "date") == 1
    assert first(datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc), "timestamp") == 0
    with pytest.raises(TypeError):
        first("a", "string")
