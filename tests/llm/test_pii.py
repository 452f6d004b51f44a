"""Pseudonyms: bijective, within their format, linked across documents, texts else unchanged."""

import datetime
import re

import pytest

from veilspark.llm import queries
from veilspark.llm.pii import ANY, pseudonymise

DATA = "/root/testdata/sf0.01"
VALUES = [
    "4111 1111 1111 1111", "4111111111111111", "5500-0055-5555-5559", "+1 (523) 555-1055", "+1 (523) 555-1056",
    "(206) 555-0100", "206.555.0100", "+49 30 1234 5678", "+1 (123) 555-0000", "123-45-6789", "10.0.255.1",
    "1990-02-28", "2000/02/29", "28.02.1990", "02/28/1990", "28/02/1990", "31-12-1999",
    "hein.19@mail5.example.com", "a@b.io", "A.b+C%9@x-y.co.uk",
]
UNTOUCHED = ["4111111111111112", "1990-02-30", "256.1.1.1", "1.2.3.4.5", "1850-01-01", "12345", "x@y", "3000-01-01"]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    return [tuple(r) for r in pseudonymise(df, "k", **options).orderBy("doc_id").collect()]


def test_formats_and_way_back(spark):
    texts = [f"a {v}, b" for v in VALUES] + [f"a {v}, b" for v in UNTOUCHED] + [None, "", "plain"]
    got = run(spark, texts)
    shape = lambda t: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", t)))
    for i, (_, text, n, new, count) in enumerate(got):
        assert text == texts[i] and n == 7
        if i < len(VALUES):
            assert count == 1 and new != text, text
            if "." in text and re.search(r"10\.0", text):
                assert all(0 <= int(x) < 256 for x in re.findall(r"\d+", new))
            else:
                assert shape(new) == shape(text)
        else:
            assert (new, count) == (text, 0), text
    new = [r[3][2:-3] for r in got[: len(VALUES)]]
    assert all(luhn(re.sub(r"\D", "", v)) for v in new[:3])
    assert re.sub(" ", "", new[0]) == new[1]
    assert re.sub(r"\D", "", new[5]) == re.sub(r"\D", "", new[6])
    assert new[0][0] == "4" and new[3].startswith("+1 (") and new[3] != new[4]
    assert new[11].replace("-", "") == "".join(reversed(new[13].split(".")))
    for v in (new[11], new[12].replace("/", "-")):
        datetime.date.fromisoformat(v)
    back = run(spark, [r[3] for r in got], back=True)
    assert [r[3] for r in back[: len(VALUES)]] == texts[: len(VALUES)]


def test_permutation_of_a_whole_range(spark):
    texts = [f"10.0.{i}.{j}" for i in range(16) for j in range(64)] + [f"19{y}-0{m}-11" for y in range(10, 99) for m in range(1, 10)]
    assert len({r[3] for r in run(spark, texts)}) == len(texts)


def test_repeats_long_texts_and_empty(spark):
    long = "x" * 300_000 + " 10.1.2.3 " + "1" * 50_000 + " a@b.io" * 2000
    (a, b) = run(spark, [long, long])
    assert a[3] == b[3] and a[4] == 2001 and a[3].startswith("x" * 300_000)
    assert run(spark, ["z"])[0][3] == "z"
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    java = re.compile(re.sub(r"\+\+|\}\+", lambda m: m.group()[:-1], ANY))
    seen = {}
    n = 0
    for r in queries.op10_pseudonyms(spark, DATA).collect():
        old, new = java.findall(texts[r.doc_id]), java.findall(r.text)
        assert java.sub("", texts[r.doc_id]) == java.sub("", r.text) and len(old) == len(new)
        for a, b in zip(old, new):
            assert seen.setdefault(a, b) == b
            n += a != b
    assert n > 50 and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("key", ["a", "b"])
def test_key_matters(spark, key):
    df = spark.createDataFrame([(1, "10.9.8.7")], "doc_id long, text string")
    first = pseudonymise(df, key).first().pseudonymised
    assert first != pseudonymise(df, key + "x").first().pseudonymised
