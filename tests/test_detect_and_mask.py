"""Golden strings, properties of detection, and both maskers."""

import random
import re

import pytest
from pyspark.sql import functions as F

import veilspark as v
from veilspark.functions.labels import MASK_LABELS, mask_label
from veilspark.functions.patterns import (
    JAVA_SPACE,
    PATTERN_NAMES,
    PATTERNS,
    _expand_space,
    java_pattern,
    plain_java_pattern,
)
from veilspark.functions.resolve import mask_spans, resolve_overlaps
from veilspark.functions.spans import (
    cascade_mappings,
    detect_regex,
    find_spans,
    first_pii_type,
    has_pattern,
    has_pii,
    mask_cascade,
)
from veilspark.schema import DETECTION
from pyspark.sql import types as T

NBSP = "\u00a0"

# text, cascade result, span result if different
GOLDEN = [
    (
        "Hi, I'm Jennifer Anderson from Microsoft Corporation in Seattle.\n"
        "Contact me at jennifer.anderson@microsoft.com or (206) 555-9876.",
        "Hi, I'm Jennifer Anderson from [REDACTED_ORGANIZATION] in Seattle.\n"
        "Contact me at [REDACTED_EMAIL] or [REDACTED_PHONE].",
        None,
    ),
    (
        "Hi, I'm John Doe. Email me at john@example.com",
        "Hi, I'm John Doe. Email me at [REDACTED_EMAIL]",
        None,
    ),
    ("I work at Google in Mountain View. Call me at 555-1234.",) * 2 + (None,),
    ("What is the weather today?",) * 2 + (None,),
    ("account number: 12345678901234 ok", "[REDACTED_ACCOUNT] ok", None),
    (
        "card 4111 1111 1111 1111, CVV: 123 and é123-45-6789é",
        "card [REDACTED_CREDIT_CARD], [REDACTED_CVV] and é[REDACTED_SSN]é",
        "card [REDACTED_CREDIT_CARD], CVV: 123 and é[REDACTED_SSN]é",
    ),
    (
        "Meet with Dr. Ann Lee at Acme Bank, born on 01/02/1990, ip 10.0.0.1 zip 98101-1234",
        "Meet with [REDACTED_NAME] at [REDACTED_ORGANIZATION], [REDACTED_DOB], "
        "ip [REDACTED_IP] zip [REDACTED_ZIP]",
        None,
    ),
    (
        f"😀 ssn 123-45-6789{NBSP}x; 9123-45-6789 123-45-6789",
        f"😀 ssn [REDACTED_SSN]{NBSP}x; 9123-45-6789 [REDACTED_SSN]",
        None,
    ),
    (
        f"Mr.{NBSP}Bob Stone, extraordinarily uncharacteristic straightforwardly x12345678",
        "[REDACTED_NAME], extraordinarily uncharacteristic straightforwardly [REDACTED_PASSPORT]",
        None,
    ),
    (None, None, None),
    ("", "", None),
]

# One text per pattern and the whole match expected in it.
EXAMPLES = {
    "ssn": ("my ssn 123-45-6789.", "123-45-6789"),
    "creditCard": ("pay 6011-1234 56781234 now", "6011-1234 56781234"),
    "cvv": ("(expires 4/2027) should work", "expires 4/2027) should"),
    "policyNumber": ("Insurance # POLICY-2024-1234567", "Insurance # POLICY-2024-1234567"),
    "medicalRecord": ("medical record number: 12-345-67890b", "medical record number: 12-345-67890b"),
    "vin": ("car 1hgcm82633a004352.", "1hgcm82633a004352"),
    "routingNumber": ("Routing #: 123456789", "Routing #: 123456789"),
    "bankAccount": ("account no. 1234567890", "account no. 1234567890"),
    "passport": ("ab1234567", "ab1234567"),
    "driversLicense": ("License number is D1234567", "License number is D1234567"),
    "email": ("<first.last+tag@mail.example.co>", "first.last+tag@mail.example.co"),
    "phone": ("+44 (206) 555.0101", "+44 (206) 555.0101"),
    "zipCode": ("at 98101-1234", "98101-1234"),
    "ipv4": ("ip 255.249.199.9", "255.249.199.9"),
    "dateOfBirth": ("date of birth: Sept 3, 2001 / birth date: Sep 3, 2001", "birth date: Sep 3, 2001"),
    "titleName": ("ask Prof. Anne-Marie O'Hara Smith today", "Prof. Anne-Marie"),
    "fullName": ("coordinating with Ann Lee Roe", "coordinating with Ann Lee Roe"),
    "organization": ("the Acme Medical Center here", "Acme Medical Center"),
}

_PIECES = [
    "123-45-6789", "4111 1111 1111 1111", "cvv: 123", "expires 1/2030) should", "Policy # 2024-1234567",
    "MRN 12-345-67890", "1HGCM82633A004352", "routing 123456789", "account: 1234567890123", "C1234567",
    "driver's license D1234567", "a.b-c@d-e.org", "@", "x@y.zz|", "(206) 555-1234", "12345", "10.0.0.255",
    "DOB 1/2/1990", "Dr. Ann", "Mrs Bob", "Ann", "Lee", "Bob-Jo", "O'Neil", "my name is", "with", "Acme",
    "Bank", "Inc.", "Corp", "é", "ß", "_", "-", ".", "%", "+", ",", ":", " ", "  ", NBSP, "\u2003", "\ufeff",
    "\n", "\t", "A", "a", "7", "99", "", "😀", "[REDACTED_SSN]",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.choice(_PIECES) for _ in range(rng.randint(1, 14))]
        yield rng.choice(["", " "]).join(words)


def test_golden_strings(texts):
    rows = (
        texts(*[g[0] for g in GOLDEN])
        .select(
            "id",
            mask_cascade(F.col("text")).alias("cascade"),
            mask_spans(F.col("text"), detect_regex(F.col("text"))).alias("spans"),
        )
        .orderBy("id")
        .collect()
    )
    for row, (_, cascade, spans) in zip(rows, GOLDEN):
        assert row["cascade"] == cascade
        assert row["spans"] == (cascade if spans is None else spans)


@pytest.mark.parametrize("name", PATTERN_NAMES)
def test_each_pattern_finds_its_example(texts, name):
    text, value = EXAMPLES[name]
    row = texts(text).select(find_spans(F.col("text"), name).alias("found"), has_pattern(F.col("text"), name).alias("has")).first()
    assert [s["value"] for s in row["found"]] == [value]
    assert row["found"][0]["index"] == text.index(value)
    assert row["has"] is True


def test_tuned_patterns_match_as_the_plain_ones(texts):
    df = texts(*random_texts(4000, 1)).repartition(4).cache()
    for name in PATTERN_NAMES:
        tuned = F.regexp_extract_all(F.col("text"), F.lit(java_pattern(name)), F.lit(0))
        plain = F.regexp_extract_all(F.col("text"), F.lit(plain_java_pattern(name)), F.lit(0))
        wrong = df.where(tuned != plain).select("text", tuned.alias("t"), plain.alias("p")).take(1)
        assert not wrong, (name, wrong)
        assert df.where(F.size(tuned) > 0).count() > 10, name


def test_matches_equal_those_of_another_regex_engine(texts):
    values = list(random_texts(3000, 5))
    rows = texts(*values).repartition(4).select("id", detect_regex(F.col("text")).alias("d")).collect()
    compiled = [
        (name, re.compile(_expand_space(pattern, JAVA_SPACE), re.ASCII | (re.IGNORECASE if fold else 0)))
        for name, fold, pattern in PATTERNS
    ]
    for row in rows:
        text = values[row["id"]]
        expected = [(n, m.group(), m.start()) for n, p in compiled for m in p.finditer(text)]
        assert [(s["type"], s["value"], s["index"]) for s in row["d"]] == expected, text


def test_spans_are_where_they_say(texts):
    df = texts(*random_texts(2000, 2)).repartition(4)
    rows = df.select(
        F.col("text"),
        detect_regex(F.col("text")).alias("d"),
        has_pii(F.col("text")).alias("has"),
        first_pii_type(F.col("text")).alias("first"),
        F.array(
            *[F.regexp_extract_all(F.col("text"), F.lit(plain_java_pattern(n)), F.lit(0)) for n in PATTERN_NAMES]
        ).alias("plain"),
        mask_spans(F.col("text"), detect_regex(F.col("text"))).alias("masked"),
        resolve_overlaps(detect_regex(F.col("text"))).alias("kept"),
    ).collect()
    for row in rows:
        for span in row["d"]:
            at = span["index"]
            assert row["text"][at : at + len(span["value"])] == span["value"]
        # gates and marks lose nothing: the same values as plain scans, in the same order
        expected = [(n, value) for n, found in zip(PATTERN_NAMES, row["plain"]) for value in found]
        assert [(s["type"], s["value"]) for s in row["d"]] == expected
        assert row["has"] == bool(expected)
        assert row["first"] == (expected[0][0] if expected else None)
        end, out = 0, ""
        for span in row["kept"]:
            assert span["index"] >= end
            label = MASK_LABELS.get(span["type"], "REDACTED_" + span["type"].upper())
            out += row["text"][end : span["index"]] + f"[{label}]"
            end = span["index"] + len(span["value"])
        assert row["masked"] == out + row["text"][end:]


def test_cascade_is_the_patterns_one_after_another(texts):
    step = F.col("text")
    for name in PATTERN_NAMES:
        label = MASK_LABELS.get(name, "REDACTED_" + name.upper())
        step = F.regexp_replace(step, plain_java_pattern(name), f"[{label}]")
    df = texts(*random_texts(2000, 3)).repartition(4)
    assert df.where(mask_cascade(F.col("text")) != step).count() == 0


def test_long_texts_neither_overflow_nor_stall(texts):
    names = "Dr. Ann" + " Bob" * 50_000
    phones = " ".join(f"call 206-555-{i:04d}" for i in range(3000))
    dotted = "a@b.com " + "foo%20bar.baz-qux+" * 20_000
    rows = texts(names, phones, dotted).select(
        "id", F.size(detect_regex(F.col("text"))).alias("n"), mask_spans(F.col("text"), detect_regex(F.col("text"))).alias("m")
    ).orderBy("id").collect()
    assert [r["n"] for r in rows] == [1, 3000, 1]
    assert rows[0]["m"] == "[REDACTED_NAME]"
    assert rows[1]["m"] == " ".join(["call [REDACTED_PHONE]"] * 3000)
    assert rows[2]["m"].startswith("[REDACTED_EMAIL] foo%20")


def brute_resolve(spans):
    kept = []
    for span in sorted(spans, key=lambda s: s[2]):
        end = span[2] + len(span[1])
        if not any(end > k[2] and span[2] < k[2] + len(k[1]) for k in kept):
            kept.append(span)
    return kept


def test_resolution_equals_the_pairwise_rule(spark):
    rng = random.Random(4)
    cases = []
    for i in range(400):
        spans = [
            (f"t{n}", "x" * rng.choice([0, 1, 1, 2, 3, 7]), rng.randint(0, 30), "regex", 1.0)
            for n in range(rng.choice([0, 1, 2, 5, 12, 150]))
        ]
        cases.append((i, spans))
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("s", T.ArrayType(DETECTION))])
    rows = spark.createDataFrame(cases, schema).select("id", resolve_overlaps(F.col("s")).alias("k")).collect()
    for row in rows:
        assert [tuple(s) for s in row["k"]] == brute_resolve(cases[row["id"]][1])


def test_a_value_the_text_does_not_have_stays_but_blocks(spark):
    spans = [("person", "john doe", 0, "ml", 0.9), ("person", "Doe x", 5, "ml", 0.9)]
    df = spark.createDataFrame([("John Doe x", spans)], T.StructType([
        T.StructField("text", T.StringType()), T.StructField("s", T.ArrayType(DETECTION))]))
    assert df.select(mask_spans(F.col("text"), F.col("s")).alias("m")).first()["m"] == "John Doe x"


def test_labels(one):
    expected = {
        "email": "[REDACTED_EMAIL]", "titleName": "[REDACTED_NAME]", "cvv": "[REDACTED_CVV]",
        "fullName": "[REDACTED_FULLNAME]", "zipcode": "[REDACTED_ZIPCODE]", "zipCode": "[REDACTED_ZIP]",
    }
    for kind, mask in expected.items():
        assert one(mask_label(F.lit(kind))) == mask


def test_operators_over_frames(texts):
    df = texts("mail a@b.org", "nothing", None, "call 206-555-1234 or 206-555-9999")
    assert {r["id"] for r in v.only_pii(df).collect()} == {0, 3}
    assert v.only_pii(df).columns == ["id", "text"]
    assert {(r["type"], r["hits"]) for r in v.count_pii(df).collect()} == {("email", 1), ("phone", 2)}
    assert {r["id"]: r["masked"] for r in v.mask_changed(df).collect()} == {
        0: "mail [REDACTED_EMAIL]",
        3: "call [REDACTED_PHONE] or [REDACTED_PHONE]",
    }
    rows = v.detection_rows(df, "id", name="phone").orderBy("index").collect()
    assert [(r["ordinal"], r["value"], r["index"]) for r in rows] == [(0, "206-555-1234", 5), (1, "206-555-9999", 21)]
    both = v.mask_columns(df.withColumn("more", F.col("text")), ["text", "more"]).where("id = 0").first()
    assert both["text"] == both["more"] == "mail [REDACTED_EMAIL]"
    off = v.mask_messages(df.withColumn("on", F.col("id") > 0), enabled="on").where("id = 0").first()
    assert off["masked"] == "mail a@b.org" and off["detections"] == []


def test_detection_runs_once_per_text(texts):
    """Neither a filter below the scan nor a second copy of the patterns in the plan."""
    for frame in (v.mask_changed(texts("a")), v.count_pii(texts("a")), v.detection_rows(texts("a"), "id")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" not in plan
    plan = v.mask_messages(texts("a")).select("id", "masked")._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()


def test_cascade_mappings_are_in_order(texts):
    row = texts("call 206-555-1234, 206-555-9999, ask Dr. Ann Lee").select(cascade_mappings(F.col("text")).alias("m")).first()
    assert [tuple(p) for p in row["m"]] == [
        ("[REDACTED_PHONE]", "206-555-1234"),
        ("[REDACTED_PHONE]", "206-555-9999"),
        ("[REDACTED_NAME]", "Dr. Ann Lee"),
    ]
