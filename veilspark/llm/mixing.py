"""Mixing sources to target weights by soft membership.

1. A classifier learns domains from a labelled table: a multinomial model over hashed words,
   whose counts Spark sums.  It gives every document a posterior over the domains, sharpened
   by the power that fits the labelled rows best.
2. Rates r >= 0 per document are fitted by projected gradient descent on the least squares
   between the expected tokens of each domain, sum of r * tokens * posterior, and the target
   shares of all tokens.  Rates start at one.  A step takes the K residuals, weighted by the
   inverse of the K x K matrix of the domains (a metric in which one step would do without
   the bound), and moves every rate against its posterior, then cuts it at zero.
   The rates are a function of the posterior and the steps so far, so no state is kept per
   document: a pass over the written posteriors sums K + K*K numbers, whatever the rows.

The classifier sees at most ``labelled_rows`` rows (20,000 by default), chosen by a hash of
their id.  Posteriors, totals and rates cover all documents.

Defined cases: a null or empty text has no tokens and the prior as its posterior; without any
labelled row the posterior is even; a domain without a target has target zero; targets are
scaled to a sum of one; without tokens all rates are one; an empty table gives no rows; rows
are independent of each other, so repeated ones have equal rates; a row of a null id takes
part like any other; all columns are kept, new ones replace old ones of the same name.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .base import free_name, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 14
POWERS = tuple(2.0**-i for i in range(0, 11))
COPY_STEPS = 1 << 20


@dataclass
class Model:
    """``weights``: log probabilities, domains x buckets; ``steps``: those of the descent;
    ``residual``: by how much each domain's share is off its target; ``reached``: by no more
    than the tolerance, or there are no tokens."""

    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray
    power: float = 1.0
    steps: list[np.ndarray] = field(default_factory=list)
    residual: dict[str, float] = field(default_factory=dict)
    reached: bool = False

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and summed log probabilities per domain of each text."""
        words = W.split_words(texts, lower=True)
        n = words.counts()
        bucket = (words.hashes >> np.uint64(50)).astype(np.int64)
        docs = words.documents()
        sums = [np.bincount(docs, w[bucket], minlength=len(n)) for w in self.weights]
        return n, np.stack(sums, axis=1) if len(n) else np.zeros((0, len(self.domains)))

    def posterior(self, sums: np.ndarray, power: float | None = None) -> np.ndarray:
        logs = np.log(self.prior) + (self.power if power is None else power) * sums
        logs -= logs.max(axis=1, keepdims=True, initial=-np.inf)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for step in self.steps:
            r = np.maximum(0.0, r - p @ step)
        return r


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: list[str], labelled_rows: int = 20_000
) -> Model:
    """Classifier of the texts of ``docs`` from ``labelled``: ``doc_id`` and ``domain``."""
    index = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    known = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
    each = known.groupBy("doc_id").agg(F.min(index).alias("_domain"))
    # at most labelled_rows ids with a number
    sample = F.broadcast(each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    texts = staged(texts.select("_domain", "text"), "labelled")
    k = len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, BUCKETS + 1), np.int64)
        for batch, part in W.slices(batches):
            words = W.split_words(part, lower=True)
            domain = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = (words.hashes >> np.uint64(50)).astype(np.int64)
            np.add.at(total[:, BUCKETS], domain, 1)
            cell = domain[words.documents()] * (BUCKETS + 1) + bucket
            total += np.bincount(cell, minlength=total.size).reshape(total.shape)
        d, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int32()), pa.array(b, pa.int32()), pa.array(total[d, b])], names=["d", "b", "n"]
        )

    counts = np.zeros((k, BUCKETS + 1))
    summed = texts.mapInArrow(count, "d int, b int, n long").groupBy("d", "b").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # at most domains x (buckets + 1) rows
        counts[r["d"], r["b"]] = r["n"]
    rows = counts[:, BUCKETS] + 1
    words = counts[:, :BUCKETS] + 0.5
    model = Model(domains, rows / rows.sum(), np.log(words / words.sum(axis=1, keepdims=True)))
    if not counts.any():
        return model

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(POWERS))
        for batch, part in W.slices(batches):
            domain = batch.column(0).to_numpy(zero_copy_only=False)
            _, sums = model.likelihoods(part)
            for i, power in enumerate(POWERS):
                p = model.posterior(sums, power)[np.arange(len(domain)), domain]
                total[i] += np.log(np.maximum(p, 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(POWERS)), pa.int32()), pa.array(total)], names=["i", "fit"])

    found = texts.mapInArrow(fits, "i int, fit double").groupBy("i").agg(F.sum("fit").alias("fit")).collect()
    model.power = POWERS[max(found, key=lambda r: r["fit"])["i"]]
    return model


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``posterior``, an array in the order of the domains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.slices(batches):
            n, sums = model.likelihoods(texts)
            p = model.posterior(sums)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(model.domains))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))],
                names=["doc_id", "n_tokens", "posterior"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def fit_rates(found: DataFrame, model: Model, targets: dict[str, float], rounds: int = 40, tolerance: float = 1e-5) -> Model:
    """Adds to ``model.steps`` until no domain's share is off by more than ``tolerance``.

    Targets that ``rounds`` steps do not meet, as of a domain that no document has, are said in
    ``model.residual`` and in a warning.
    """
    k = len(model.domains)
    goal = np.array([targets.get(d, 0.0) for d in model.domains], float)
    goal /= goal.sum()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n_tokens").to_numpy().astype(float)
                p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
                r = model.rates(p)
                total[0] += n.sum()
                total[1 : 1 + k] += (n * r) @ p
                total[1 + k :] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

    for step in range(rounds + 1):
        gathered = found.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(1 + k + k * k)
        for r in gathered:  # 1 + K + K*K numbers
            total[r["i"]] = r["x"]
        if total[0] == 0:
            model.reached = True
            break
        residual = total[1 : 1 + k] / total[0] - goal
        model.residual = dict(zip(model.domains, residual.tolist(), strict=True))
        model.reached = bool(np.abs(residual).max() <= tolerance)
        if model.reached or step == rounds:
            break
        metric = total[1 + k :].reshape(k, k) / total[0] + 1e-6 * np.eye(k)
        model.steps.append(np.linalg.solve(metric, residual))
    if not model.reached:
        warnings.warn(f"target shares not reached, off by {model.residual}", stacklevel=2)
    return model


def with_rates(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, ``rate`` and ``copies``.

    ``copies`` is the rate rounded up or down by a hash of the id, so that it is right in
    expectation and the same in every run.
    """
    names = [c for c in docs.columns if c not in ("rate", "copies")]
    held = free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.slices(batches, held):
            _, sums = model.likelihoods(texts)
            r = model.rates(model.posterior(sums))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(r)], names=[*names, "rate"])

    schema = T.StructType(list(docs.select(*names).schema.fields)).add("rate", "double")
    rows = docs.select(*names, F.col(text).cast("string").alias(held)).mapInArrow(run, schema)
    return rows.withColumn("copies", copies(F.col("rate"), F.col(key)))


def copies(rate: Column, key: Column) -> Column:
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(COPY_STEPS)) / COPY_STEPS
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


# Domains of the labelled table and the shares of tokens that the mixture aims at.
TARGETS = {"good": 0.90, "toxic": 0.02, "poor": 0.08}


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` of the table of quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, labelled_rows: int = 20_000) -> tuple[Model, DataFrame]:
    """The fitted model and the written posteriors of ``docs``."""
    model = fit_domains(docs, label_domains(labels), list(targets), labelled_rows)
    found = staged(posteriors(docs, model), "posteriors")
    return fit_rates(found, model, targets), found


def rate_table(found: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, a probability per domain, ``rate`` and ``copies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, len(model.domains))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.rates(p))], names=[*batch.schema.names, "rate"]
            )

    rows = found.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double")
    each = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rows.select("doc_id", "n_tokens", *each, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
