"""Figures of the tagging, gathered on the one pass."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

import veilspark as v
from veilspark.operators.lexical import load_failing, load_lexical

TEXTS = ["Ann Lee " * 40, "quiet Ann. " * 30, "", None, "Bob"]


def expected(df, load):
    tagged = v.tag_tokens(df, "text", load)
    answers = [a for r in tagged.collect() for a in r["tagged"] or ()]
    return len(answers), sum(len(a["tokens"] or ()) for a in answers), sum(a["error"] is not None for a in answers)


def test_figures_of_a_masking_run(spark, texts, tmp_path):
    df = texts(*TEXTS)
    metrics = Observation("masking")
    masked = v.mask_messages(df, load=load_failing, metrics=metrics)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    masked.select("id", "masked", "ml_errors").write.parquet(str(tmp_path / "out"))
    chunks, tokens, failed = expected(df, load_failing)
    assert failed > 0
    assert metrics.get == {"texts": 5, "chunks": chunks, "tokens": tokens, "failed": failed, "failed_other": failed}
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("ml_errors")).first()[0] == failed


def load_broken():
    raise OSError("no model")


def test_kinds_of_errors(spark, texts):
    df = texts(*TEXTS).repartition(3)
    chunks, tokens, failed = expected(df, load_failing)
    for load, kinds, found in (
        (load_failing, ("ValueError", "KeyError"), {"failed_ValueError": failed, "failed_KeyError": 0, "failed_other": 0}),
        (load_failing, ("KeyError",), {"failed_KeyError": 0, "failed_other": failed}),
        (load_lexical, ("ValueError",), {"failed_ValueError": 0, "failed_other": 0}),
    ):
        metrics = Observation()
        v.observe_tagging(v.tag_tokens(df, "text", load), metrics, kinds).write.format("noop").mode("overwrite").save()
        got = metrics.get
        assert got["chunks"] == chunks and got["texts"] == 5 and found.items() <= got.items()
    metrics = Observation()
    v.observe_tagging(v.tag_tokens(df.limit(0), "text", load_lexical), metrics).collect()
    assert set(metrics.get.values()) == {0}
