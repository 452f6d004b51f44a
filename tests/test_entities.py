"""The entity pipeline: stages, filters, and parity with the rules applied one by one."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import veilspark as v
from veilspark.functions.entities import (
    chunk_text,
    detect_hybrid,
    fill_positions,
    filter_confidence,
    filter_confidence_hybrid,
    filter_located,
    filter_valid,
    join_subwords,
    locate_tokens,
    merge_entities,
)
from veilspark.functions.labels import ENTITY_TYPES, map_entity
from veilspark.functions.validity import RULES, is_valid
from veilspark.schema import CHUNK, DETECTION, ENTITY, ML_DETECTION, TAGGED_CHUNK, TOKEN, WORD


def field(name, element):
    return T.StructField(name, T.ArrayType(element))


def frame(spark, rows, *fields):
    schema = T.StructType([T.StructField("id", T.IntegerType()), *fields])
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


TEXT = T.StructField("text", T.StringType())


def token(word, entity="I-CITY", score=0.9, start=None, end=None):
    return (word, entity, score, start, end)


def test_chunks(texts):
    long = "".join(chr(97 + i % 26) for i in range(406))
    rows = texts("", "a" * 150, "b" * 151, long, None, "é😀" * 100).select(
        "id", chunk_text(F.col("text")).alias("c")
    ).orderBy("id").collect()
    got = [[(c["chunk_no"], c["offset"], c["text"]) for c in r["c"]] for r in rows]
    assert got[0] == [(0, 0, "")]
    assert got[1] == [(0, 0, "a" * 150)]
    assert got[2] == [(0, 0, "b" * 150), (1, 135, "b" * 16)]
    assert got[3] == [(i, s, long[s : s + 150]) for i, s in enumerate(range(0, 406, 135))]
    assert got[4] == []
    assert got[5] == [(i, s, ("é😀" * 100)[s : s + 150]) for i, s in enumerate(range(0, 200, 135))]


def test_locating_tokens(spark):
    chunks = [(0, 0, "see Ann and Ann"), (1, 100, "Bob ##x ann")]
    tagged = [
        ([token("Ann"), token("Ann", start=12, end=15), token("▁and "), token("##nn"), token("Zoe")], None),
        ([token("Bob"), token("##ob"), token("Ann", start=8), token("##")], None),
    ]
    df = frame(spark, [(chunks, tagged)], field("c", CHUNK), field("t", TAGGED_CHUNK))
    found = df.select(locate_tokens(F.col("c"), F.col("t")).alias("x")).first()["x"]
    assert [(t["start"], t["end"]) for t in found] == [
        (4, 7), (12, 15), (8, 11), (5, 7), (None, None),
        (100, 103), (101, 103), (None, None), (None, None),
    ]


def test_joining_subwords(spark):
    tokens = [
        token("##lost"),
        token("Jen", score=0.5, start=0, end=3),
        token("##ni", entity="O", score=0.8, start=3, end=5),
        token("##fer", score=0.7),
        token("Bo"),
        token("##b", start=20, end=21),
    ]
    df = frame(spark, [(tokens,), ([],), ([token("##a")],)], field("t", TOKEN))
    got = [r["w"] for r in df.select("id", join_subwords(F.col("t")).alias("w")).orderBy("id").collect()]
    assert [tuple(w) for w in got[0]] == [
        ("Jen", "Jennifer", "I-CITY", 0.8, 0, 3, 5),
        ("Bo", "Bob", "I-CITY", 0.9, None, None, 21),
    ]
    assert got[1] == got[2] == []


def test_mapping_entities(texts):
    tags = [*ENTITY_TYPES, "B-CITY", "I-GIVENNAME", "B-GIVENNAME", "X"]
    rows = texts(*tags).select("id", map_entity(F.col("text")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in rows] == [*ENTITY_TYPES.values(), "city", "person", "givenname", "x"]


def entity(kind, word, score=1.0, start=0, end=1):
    return ("X", kind, word, score, start, end)


@pytest.mark.parametrize(
    "kind, first, second",
    [("email", 0.8, 0.6), ("TEL", 0.9, 0.55), ("I-idCard", 0.75, 0.65), ("person", 0.6, 0.45), ("title", 0.5, 0.4)],
)
def test_gates_on_the_threshold(spark, kind, first, second):
    near = [entity(kind, "w", s) for s in (first, first + 1e-9, first - 1e-9)]
    ml = [(kind, "w", s, 0, 1, "ml", s) for s in (second, second - 1e-9)]
    df = frame(spark, [(near, ml)], field("e", ENTITY), field("m", ML_DETECTION))
    row = df.select(
        filter_confidence(F.col("e")).alias("a"), filter_confidence_hybrid(F.col("m")).alias("b")
    ).first()
    assert [e["score"] for e in row["a"]] == [first + 1e-9]
    assert [m["score"] for m in row["b"]] == [second]


VALIDITY = [
    ("valid_length", "city", "ab", "a"),
    ("valid_charmix", "city", "12345", "5bseattle"),
    ("valid_charmix", "username", "bob99", None),
    ("valid_charmix", "city", "a1@b", None),
    ("valid_charmix", "license", None, "d1234567"),
    ("valid_ip", "ip", "10.0", "10"),
    ("valid_email", "email", "a.b", "his"),
    ("valid_phone", "tel", "555-1234", "617-555"),
    ("valid_phone", "tel", "123456789012345", "1234567890123456"),
    ("valid_phone", "tel", None, "-5551234"),
    ("valid_date", "bod", "1/2/90", "1985-"),
    ("valid_date", "date", "19850101", "1985"),
    ("valid_date", "date", "1985/1", "1/2"),
    ("valid_address", "street", "elm", "el"),
    ("valid_address", "building", "98101", "9810"),
    ("valid_ssn", "socialnumber", "123456789", "12345678"),
]


@pytest.mark.parametrize("rule, kind, good, bad", VALIDITY)
def test_validity(one, rule, kind, good, bad):
    for word, expected in ((good, True), (bad, False)):
        if word is not None:
            assert one(RULES[rule](F.lit(word), F.lit(kind))) is expected
            if not expected:
                assert one(is_valid(F.lit(word), F.lit(kind))) is False


def test_validity_ignores_case_and_outer_space(spark):
    df = frame(spark, [([entity("I-TEL", " 555-1234\t"), entity("Tel", "617-555"), entity("city", "\n ")],)], field("e", ENTITY))
    assert [e["word"] for e in df.select(filter_valid(F.col("e")).alias("x")).first()["x"]] == [" 555-1234\t"]


def test_unlocated_entities_are_dropped(spark):
    df = frame(spark, [([entity("city", "a", start=None), entity("city", "b")],)], field("e", ENTITY))
    assert [e["word"] for e in df.select(filter_located(F.col("e")).alias("x")).first()["x"]] == ["b"]


@pytest.mark.parametrize("gap, merged", [(0, True), (2, True), (3, False), (-1, False)])
def test_merging_by_gap(spark, gap, merged):
    text = "0123456789" * 3
    words = [
        ("0123", "0123", "B-PER", 0.9, 0, 4, None),
        ("x", "x", "I-PER", 0.7, 4 + gap, 8 + gap, None),
    ]
    df = frame(spark, [(text, words)], TEXT, field("w", WORD))
    got = df.select(merge_entities(F.col("w"), F.col("text")).alias("e")).first()["e"]
    if merged:
        assert [(e["word"], e["score"], e["start"], e["end"], e["entity"]) for e in got] == [
            (text[: 8 + gap], 0.7, 0, 8 + gap, "B-PER")
        ]
    else:
        assert [e["word"] for e in got] == ["0123", "x"]


# --- the sequential rules, applied one word after another ------------------------------


def place(words, text):
    out, last = [], 0
    for w in words:
        piece, _, _, _, start, end, sub_end = w
        if start is None:
            at = text.find(piece, last)
            if at >= 0:
                start, end = at, at + len(piece)
        end = end if sub_end is None else sub_end
        last = last if end is None else end
        out.append((*w[:4], start, end, sub_end))
    return out


def join(words, text):
    done, open_ = [], None
    for _, word, tag, score, start, end, _ in words:
        kind = ENTITY_TYPES.get(tag, tag.removeprefix("B-").removeprefix("I-").lower())
        if open_ and kind == open_["type"] and None not in (start, open_["start"], open_["end"]):
            lo, hi = sorted((open_["start"], end))
            if 0 <= start - open_["end"] <= 2 and text[lo:hi].strip():
                open_.update(word=text[lo:hi], end=end, score=min(score, open_["score"]))
                continue
        if open_ and open_["start"] is not None:
            done.append(open_)
        open_ = {"entity": tag, "type": kind, "word": word, "score": score, "start": start, "end": end}
    if open_ and open_["start"] is not None and open_["word"].strip():
        done.append(open_)
    return [tuple(e.values()) for e in done]


def accept(spans, found):
    taken = list(spans)
    for kind, value, score, start, end, _, _ in found:
        if score >= 0.45 and not any(a[2] < end and a[2] + len(a[1]) > start for a in taken):
            taken.append((kind, value, start, "ml", score))
    return taken


def random_words(rng, text):
    words = []
    at = 0
    for _ in range(rng.choice([0, 1, 3, 8, 90])):
        at = max(0, at + rng.randint(-2, 6))
        n = rng.randint(1, 5)
        known = rng.random() < 0.7
        piece = text[at : at + n] if rng.random() < 0.8 else rng.choice(["zz", "ab", "  "])
        piece = piece or "q"
        start, end = (at, at + n) if known else (None, None)
        if known and rng.random() < 0.1:
            end = max(0, start - rng.randint(0, 3))
        sub_end = rng.choice([None, None, None, at + n + 2, max(0, at - 3)])
        tag = rng.choice(["B-PER", "I-PER", "I-CITY", "B-CITY", "O"])
        words.append((piece, piece + "x" * rng.randint(0, 1), tag, rng.randint(1, 9) / 10, start, end, sub_end))
        at += n
    return words


def test_sequential_rules_on_random_words(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(500):
        text = "".join(rng.choice("ab c ") for _ in range(rng.choice([5, 40, 700])))
        rows.append((text, random_words(rng, text)))
    df = frame(spark, rows, TEXT, field("w", WORD)).repartition(4)
    placed = df.withColumn("p", fill_positions(F.col("w"), F.col("text")))
    got = placed.select("id", "p", merge_entities(F.col("p"), F.col("text")).alias("e")).collect()
    for row in got:
        text, words = rows[row["id"]]
        expected = place(words, text)
        assert [tuple(w) for w in row["p"]] == expected
        assert [tuple(e) for e in row["e"]] == join(expected, text)


def test_hybrid_acceptance_on_random_intervals(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        wide = rng.choice([15, 60, 400])
        spans = [
            ("t", "x" * rng.randint(1, 8), rng.randint(0, wide), "regex", 1.0)
            for _ in range(rng.choice([0, 1, 4, 70]))
        ]
        found = []
        for n in range(rng.choice([0, 1, 5, 80])):
            start = rng.randint(0, wide)
            end = start + rng.choice([0, 1, 2, 5, 9, -2])
            score = rng.choice([0.3, 0.45, 0.9])
            found.append((f"k{n % 3}", "y" * rng.choice([1, 2, 5, 9]), score, start, end, "ml", score))
        rows.append((spans, found))
    df = frame(spark, rows, field("s", DETECTION), field("m", ML_DETECTION)).repartition(4)
    for row in df.select("id", detect_hybrid(F.col("s"), F.col("m")).alias("d")).collect():
        spans, found = rows[row["id"]]
        assert [tuple(d) for d in row["d"]] == accept(spans, found)


def test_interval_anti_join_on_random_tables(spark):
    rng = random.Random(8)
    spans = [
        (rng.choice([1, 1, 1, 2, 3]), "x" * rng.choice([1, 5, 300, 900]), rng.randint(0, 4000))
        for _ in range(60)
    ]
    spans += spans[:20]  # copies
    entities = []
    for n in range(600):
        start = rng.randint(0, 4500)
        entities.append((rng.choice([1, 2, 3, 4]), n, start, start + rng.choice([0, 1, 4, 260, 600, -3])))
    kept = v.without_overlaps(
        spark.createDataFrame(entities, "k int, no int, start int, end int"),
        spark.createDataFrame(spans, "k int, value string, index int"),
        ["k"],
        "no",
    )
    expected = {
        e for e in entities
        if not any(s[0] == e[0] and s[2] < e[3] and e[2] < s[2] + len(s[1]) for s in spans)
    }
    rows = [(r["k"], r["no"], r["start"], r["end"]) for r in kept.collect()]
    assert set(rows) == expected and len(rows) == len(expected) and 0 < len(rows) < 600


# --- taggers ---------------------------------------------------------------------------


@pytest.fixture
def picky():
    """Defined inside, so that it travels by value to workers that cannot import this file."""

    def load():
        def tag(chunks):
            answers = []
            for chunk in chunks:
                if "boom" in chunk:
                    raise ValueError("boom")
                answers.append(
                    [{"word": w, "entity": "B-PER", "score": 0.99} for w in chunk.split() if w[:1].isupper()]
                )
            return answers

        return tag

    return load


def test_a_failing_chunk_does_not_take_others_along(texts, picky):
    df = texts("Ann Lee called 206-555-1234", "boom Bob", None, "")
    tagged = v.tag_tokens(df, "text", picky)
    assert [tuple(r) for r in v.tag_errors(tagged, "id").collect()] == [(1, 0, "ValueError: boom")]
    masked = {r["id"]: r["masked"] for r in v.mask_messages(df, load=picky).collect()}
    assert masked == {0: "[REDACTED_NAME] called [REDACTED_PHONE]", 1: "boom Bob", 2: None, 3: ""}


def test_a_tagger_that_does_not_load_leaves_the_patterns(texts):
    def load():
        raise OSError("no model")

    df = texts("Ann Lee called 206-555-1234")
    assert v.mask_messages(df, load=load).first()["masked"] == "Ann Lee called [REDACTED_PHONE]"
    tagged = v.tag_tokens(df, "text", load)
    assert v.tag_errors(tagged, "id").first()["error"] == "OSError: no model"


def test_a_tagger_with_too_few_answers_is_an_error(texts):
    def load():
        return lambda chunks: []

    tagged = v.tag_tokens(texts("Ann"), "text", load)
    assert v.tag_errors(tagged, "id").count() == 1


def test_switches_per_row(texts, picky):
    df = texts("Ann 206-555-1234", "Ann 206-555-1234", "Ann 206-555-1234", "boom")
    df = df.withColumn("on", F.col("id") != 1).withColumn("ml", F.when(F.col("id") == 2, False))
    got = v.mask_messages(df, load=picky, enabled="on", use_ml="ml").orderBy("id").collect()
    assert [r["masked"] for r in got] == [
        "[REDACTED_NAME] [REDACTED_PHONE]", "Ann 206-555-1234", "Ann [REDACTED_PHONE]", "boom",
    ]


def test_entities_of_a_long_text_need_no_shuffle(texts, picky):
    plan = v.mask_messages(texts("Ann"), load=picky).select("id", "masked")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and shown.count("ArrowEvalPython") == 1
