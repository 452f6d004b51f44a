"""Targets that can be met and such that cannot."""

import warnings

import pytest

from veilspark.llm.mixing import fit_mixture, with_rates


def tables(spark):
    texts = ["good word " * 30] * 5 + ["vile word " * 30] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 5)) for i in range(10)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_reached(spark):
    docs, labels = tables(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        model, _ = fit_mixture(docs, labels, {"good": 0.8, "toxic": 0.2})
        none, _ = fit_mixture(docs.limit(0), labels, {"good": 0.8, "toxic": 0.2})
    assert model.reached and max(map(abs, model.residual.values())) <= 1e-5
    assert none.reached and none.residual == {}


def test_a_domain_that_no_document_has_is_reported(spark):
    docs, labels = tables(spark)
    with pytest.warns(UserWarning, match="not reached"):
        model, _ = fit_mixture(docs, labels.where("toxic = 0"), {"good": 0.5, "poor": 0.5})
    assert not model.reached and len(model.steps) == 40
    assert abs(model.residual["poor"]) > 0.1
    assert with_rates(docs, model).count() == 10
