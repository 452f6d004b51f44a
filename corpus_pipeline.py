"""The pipeline over ``documents``: quality, line dedup, near duplicates, leaks, mixture.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``; the last adds ``rate`` and ``copies``.

Null, empty and long texts, repeated rows, clashing names and empty tables: as the operators
say.  No stage drops a document for a null text or id except the quality rules, which reject
texts of fewer than twenty words, and line dedup, which drops a document left without a word.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.base import SPACE, free_name, staged, table
from veilspark.llm.decontaminate import remove_contaminated
from veilspark.llm.lines import remove_repeated_lines
from veilspark.llm.mixing import fit_mixture, with_rates
from veilspark.llm.ngram_join import similar_documents
from veilspark.llm.quality import P, fit_quality_rules, judge_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and the learned rules keep."""
    rules = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    aside = {c: free_name(docs, "x" + c) for c in docs.columns if c.startswith(P)}
    kept = judge_quality(docs.withColumnsRenamed(aside), rules).where(F.col(P + "kept"))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; ``n_chars`` follows.

    A document of which no word is left had nothing of its own, and goes.
    """
    removed = free_name(docs, "_lines_removed")
    out = remove_repeated_lines(docs, removed=removed)
    changed = F.col(removed) > 0
    out = out.where(~changed | F.col("text").rlike(f"[^{SPACE}]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, similarity 0.8 or more, the smallest id stays."""
    members, _ = similar_documents(docs, 5, Fraction(4, 5))
    name = free_name(docs, "_gone")
    gone = members.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the rate that makes the token shares of the domains the targets.

    ``copies`` is the rate rounded by a hash of the id.  Rows are neither dropped nor repeated:
    whoever samples takes the rate or the copies, and no text is multiplied on disk.
    """
    model, _ = fit_mixture(docs, table(spark, sf_dir, "labels"))
    return with_rates(docs, model)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("mixing to target weights", mixture),
]

# No stage but the base part of the first can be expressed in SQL at a bearable cost.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
