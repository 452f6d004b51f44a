"""Character references, tagger errors and logs of settings."""

import html

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import veilspark as v
from veilspark.functions.text import text_content
from veilspark.operators.lexical import load_failing


def test_references_as_the_standard_has_them(texts):
    names = [f"a&{name}b" for name in html.entities.html5] + [
        "caf&eacute; &uuml;ber &copy 2020", "&notit; &notin; &ampamp;", "&AMPx&", "&#128;&#x9f;&#0;",
        "&#0000000065;&#65 &#x41g &#99999999999;", "&nosuch; & &; &#; &#x;", "&&amp;&amp",
    ]
    rows = texts(*names).select("id", "text", text_content(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [html.unescape(r["text"]) for r in rows]


def test_tagger_errors_reach_the_caller(texts):
    df = texts("Ann Lee", "a q here", None, "", "x" * 200 + " q")
    for out in (v.mask_messages(df, load=load_failing), v.mask_stream(df, load=load_failing)):
        assert [r["ml_errors"] for r in out.orderBy("id").collect()] == [0, 1, 0, 0, 1]
    assert [r["ml_errors"] for r in v.preview(df, load=load_failing).orderBy("id").collect()] == [0, 1, 1]
    masked = v.mask_messages(df, load=load_failing).select("masked", "ml_errors")
    assert masked._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_scope_has_one_row_of_settings(spark, texts):
    df = texts("a", "b").withColumn("scope", F.lit("s"))
    row = ("s", True, "regex", True)
    twice = spark.createDataFrame(
        [row, ("s", False, "regex", True)], "scope string, enabled boolean, maskingMode string, useML boolean"
    )
    with pytest.raises(PySparkException, match="settings occur twice for scope s"):
        v.apply_settings(df, twice).collect()
    log = twice.withColumn("version", F.when(F.col("enabled"), 1).otherwise(2))
    assert [r["enabled"] for r in v.apply_settings(df, log).collect()] == [False, False]
