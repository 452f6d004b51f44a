"""What keeps the hybrid queries from doing work twice."""

from pyspark.sql import functions as F

from veilspark.functions import entities
from veilspark.operators import token_tables as rows
from veilspark.operators.lexical import load_lexical
from veilspark.schema import DETECTION, ML_DETECTION, TAGGED_CHUNK


def test_a_word_is_sought_once_in_its_chunk(spark, texts):
    chunks = entities.chunk_text(F.col("text"))
    tagged = F.lit(None).cast(f"array<{TAGGED_CHUNK.simpleString()}>")
    df = texts("Ann Lee").select(chunks.alias("c"), tagged.alias("t"))
    located = df.select(entities.locate_tokens(F.col("c"), F.col("t")).alias("x"))
    assert located._jdf.queryExecution().analyzed().toString().count("position(") == 1


def test_entities_apart_need_no_sweep(spark):
    kinds = [
        "array<struct<lo:int,no:int,hi:int,start:int,`end`:int,index:int,stop:int>>",
        f"array<{DETECTION.simpleString()}>",
        f"array<{ML_DETECTION.simpleString()}>",
    ]

    def item(lo, hi):
        return (lo, 0, hi, lo, hi, lo, hi)

    def found(*places):
        return [("person", "x" * (e - s), 0.9, s, e, "ml", 0.9) for s, e in places]

    hits = [("zipCode", "12345", 10, "regex", 1.0)]
    cases = [
        ([item(0, 3), item(3, 5), item(9, 9)], hits, found((0, 3), (15, 18)), [10, 0, 15]),
        ([item(0, 3), item(2, 5)], hits, found((8, 11), (20, 22)), [10, 20]),
        ([item(4, 9)], [], found((20, 22)), [20]),
        ([item(None, None), item(4, 9)], hits, found((11, 12), (12, 17), (0, 2), (1, 4)), [10, 0]),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], f"id int, o {kinds[0]}, s {kinds[1]}, m {kinds[2]}")
    detected = entities.detect_hybrid(F.col("s"), F.col("m"))
    got = df.select(
        "id", entities._apart(F.col("o")).alias("apart"), F.transform(detected, lambda d: d["index"]).alias("at")
    ).orderBy("id").collect()
    assert [r["at"] for r in got] == [c[3] for c in cases]
    assert [bool(r["apart"]) for r in got] == [True, False, True, False]


def test_chunks_grouped_by_key_are_joined_where_they_are(spark, texts):
    df = texts("Ann Lee", None, "Bob Stone " * 40)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows.with_entities_by_chunk(df, "id", load=load_lexical)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # chunks dealt, chunks grouped, texts
        assert {r["id"]: len(r["entities"]) > 0 for r in got.collect()} == {0: True, 1: False, 2: True}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
