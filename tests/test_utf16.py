"""Offsets in UTF-16 units."""

import random
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

import veilspark as v
from veilspark.functions.entities import chunk_text
from veilspark.functions.utf16 import from_utf16, narrow, to_utf16, utf16_index, widen
from veilspark.operators.lexical import load_lexical
from veilspark.operators.utf16 import mask_messages_utf16

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def units(text):
    return len(text.encode("utf-16-le")) // 2


def test_index_maps_both_ways(spark):
    rng = random.Random(4)
    texts = ["", "abc", "😀", "a😀b😀😀c"] + ["".join(rng.choices("ab😀é日𝒳", k=rng.randint(200, 900))) for _ in range(20)]
    rows = [(i, t, at) for i, t in enumerate(texts) for at in sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(30))})]
    df = spark.createDataFrame(rows, "id int, t string, at int").withColumn("x", utf16_index(F.col("t")))
    u = to_utf16(F.col("x"), F.col("at"))
    for r in df.select("t", "at", u.alias("u"), from_utf16(F.col("x"), u).alias("back"), from_utf16(F.col("x"), u + 1).alias("next")).collect():
        assert r["u"] == units(r["t"][: r["at"]]) and r["back"] == r["at"]
        if r["at"] < len(r["t"]):  # the second half of a character belongs to it
            assert r["next"] == r["at"] + (units(r["t"][r["at"]]) == 1)


def test_widen_and_narrow(spark):
    texts = ["", "a", "😀", "a😀😀b", None, "x￿y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.length(widen(F.col("t"))).alias("n"), narrow(widen(F.col("t"))).alias("back")).collect()
    assert [(r["n"], r["back"]) for r in rows] == [
        (0, ""), (1, "a"), (2, "😀"), (6, "a😀😀b"), (None, None), (3, "x�y"),
    ]
    halves = df.where("t = 'a😀😀b'").select(narrow(F.substring(widen(F.col("t")), 3, 2)).alias("h")).first()["h"]
    assert halves == "��"


GOLDEN = [
    # text, places of the values in units
    ("😀 call 206-555-0001", {"206-555-0001": 8}),
    ("a😀😀b 123-45-6789 and 𝒳@y.org, ann@b.org", {"123-45-6789": 7, "ann@b.org": 33}),
    ("no pii 😀", {}),
    ("206-555-0001😀206-555-0002", {"206-555-0001": 0, "206-555-0002": 14}),
]


def test_golden_places_in_both_units(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(9, None), (10, "")], "id int, text string")
    unit = {r["id"]: r for r in mask_messages_utf16(df).collect()}
    point = {r["id"]: r for r in mask_messages_utf16(df, code_points=True).collect()}
    plain = {r["id"]: r for r in v.mask_messages(df).collect()}
    for i, (text, places) in enumerate(GOLDEN):
        found = {d["value"]: d["index"] for d in unit[i]["detections"]}
        assert places.items() <= found.items() and set(places) == set(found), text
        for d in unit[i]["detections"]:
            raw = text.encode("utf-16-le")
            assert raw[2 * d["index"] : 2 * (d["index"] + units(d["value"]))].decode("utf-16-le") == d["value"]
        assert point[i]["detections"] == plain[i]["detections"] and unit[i]["masked"] == plain[i]["masked"]
    assert unit[9]["masked"] is None and unit[9]["detections"] == [] and unit[10]["masked"] == ""


def test_without_such_characters_nothing_changes(spark, texts):
    df = texts("Ann Lee wrote to Bob Stone. " * 20, "call 206-555-0001 Ann", "", None, "é 日本 Maria Gonzales")
    got = mask_messages_utf16(df, load=load_lexical).select("id", "text", "detections", "ml_errors", "masked")
    expected = v.mask_messages(df, load=load_lexical).select("id", "text", "detections", "ml_errors", "masked")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def load_chunks():
    """Tags capital words, with their places."""
    import re

    def tag(chunks):
        return [
            [{"word": m[0], "entity": "B-PER", "score": 0.9, "start": m.start(), "end": m.end()} for m in re.finditer("[A-Z][a-z]+", c)]
            for c in chunks
        ]

    return tag


def test_chunk_borders_are_in_units(spark):
    """A chunk of 150 units: with 149 letters before it, a character is cut into halves."""
    text = "x" * 149 + "😀 Maria " + "😀" * 40 + " Peter"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    shown = F.transform(chunk_text(widen(F.col("text"))), lambda c: narrow(c["text"]))
    chunks = df.select(shown.alias("c")).first()["c"]
    assert chunks[0] == "x" * 149 + "�" and chunks[1].startswith("x" * 14 + "😀 Maria ")
    row = mask_messages_utf16(df, load=load_chunks).first()
    found = {d["value"]: d["index"] for d in row["detections"]}
    assert found["Maria"] == units(text[: text.index("Maria")]) and found["Peter"] == units(text[: text.index("Peter")])
    assert row["masked"] == text.replace("Maria", "[REDACTED_NAME]").replace("Peter", "[REDACTED_NAME]")
    point = mask_messages_utf16(df, load=load_chunks, code_points=True).first()
    assert {d["value"]: d["index"] for d in point["detections"]}["Peter"] == text.index("Peter")
