"""Ranked lexical search, accumulator-limited and term at a time.

Every text is read once: its terms, counted, as far as an item asks for them.  Scores are sums
of integers, one summand a term, so they can be added up in any order.

The terms of an item are taken rarest first, in rounds that grow fourfold by their postings.
A round joins the postings of its terms with the items that ask for them and adds them to the
accumulators, one for each item and document met.  Then the k-th best partial score of an item
is a score that its answer cannot fall below.  A term makes accumulators only while a document
that has none yet could still reach that score with this term and all after it; a document with
one loses it when its score and all the bounds left cannot.  An item whose next term makes none
is closed: its survivors get the rest of their scores, exactly, from their own documents.

A term's bound is its weight times its largest share over all documents, repeats included.

Scale: the only thing sent to all tasks is a bitmap over the items' terms, of 2**24 flags at
most; it only thins the terms out, a join on the terms themselves decides.  A term with more
than one ``SHARES``-th of all postings is dealt over as many keys as it has shares; there are
at most ``SHARES`` such terms.  A partial score is found from the k best rows of each task.
Accumulators are written after every round and the former ones removed; the driver gets
counts, never rows.

Defined cases: a null or empty text has no term and is not among the N documents; an item
without a term, or whose terms no document has, gets no rows; rows with equal or null ids are
documents, or items, of their own, null ids last among equal scores; empty tables give no
rows; columns other than ids and texts are not looked at, so their names cannot clash; texts
are taken whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .base import drop_staged, staged
from .decontaminate import bitmap_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRST_POSTINGS = 1000  # of an item's first round
SHARES = 1024
MOST_BITS = 24

# Fixed value: what stands between terms, by byte.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _counted(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Per text with a term: id, number of terms, distinct terms that hit the bitmap, their counts."""
    for batch, texts in W.slices(batches):
        words = W.split_words(texts, lower=True, space=_BETWEEN)
        n = words.counts()
        at = np.arange(len(words.starts))
        if bitmap is not None and len(at):
            at = np.flatnonzero(bitmap[(words.hashes >> np.uint64(64 - bits)).astype(np.int64)])
        coded = W.strings(words, at).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        each, count = np.unique(words.documents()[at] * max(1, len(coded.dictionary)) + codes, return_counts=True)
        doc, code = np.divmod(each, max(1, len(coded.dictionary)))
        rows = np.flatnonzero(n)
        bounds = pa.array(np.append(np.searchsorted(doc, rows), len(doc)).astype(np.int32))
        terms = coded.dictionary.take(pa.array(code)).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows)),
                pa.array(n[rows].astype(np.int64)),
                pa.ListArray.from_arrays(bounds, terms),
                pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int64))),
            ],
            names=["id", "n", "terms", "counts"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = W.split_words(batch.column(0).cast(pa.large_string()), space=np.zeros(256, bool))
        yield pa.RecordBatch.from_arrays([W.signed(words.hashes)], names=["run"])


def _texts(rows: DataFrame, id: str, text: str) -> DataFrame:
    return rows.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))


def _count_terms(rows: DataFrame, bitmap=None, bits: int = 0) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda b: _counted(b, bitmap and bitmap.value, bits),
        f"id {kind}, n long, terms array<string>, counts array<long>",
    ).withColumn("row", F.monotonically_increasing_id())


def _share(count: Column, n: Column, documents: int, tokens: int) -> Column:
    """What a term's weight is multiplied with in a document of ``n`` terms that has it ``count`` times."""
    m = 25 + _div(75 * n * documents, F.lit(tokens))
    return _div(1_000_000_000 * count, 1000 * count + 8 * m)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _term_plan(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Per item and term: place, round, value of a whole share, bounds from this and the next term on."""
    order = Window.partitionBy("q").orderBy("df", "term")
    left = Window.partitionBy("q").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    met = F.sum("df").over(order)
    return (
        asked.join(terms.where("w > 0"), "term")
        .withColumn("value", F.col("w") * F.col("count"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("round", F.greatest(F.lit(0), F.ceil(F.log(4.0, met / FIRST_POSTINGS))).cast("int"))
        .withColumn("bound", F.sum(F.col("value") * F.col("top")).over(left))
        .select("q", "term", "place", "round", "value", "salts", "bound",
                (F.col("bound") - F.col("value") * F.col("top")).alias("after"))
    )


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """The ``k`` best documents of every item: item id, ``rank``, document id, ``score``."""
    spark = docs.sparkSession
    queries = staged(_count_terms(_texts(items, item_id, text)), "search-items")
    asked = queries.select(
        F.col("row").alias("q"), F.explode(F.arrays_zip("terms", "counts")).alias("t")
    ).select("q", F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    vocabulary = staged(asked.select("term").distinct(), "search-vocabulary")
    bits = int(np.clip(np.ceil(np.log2(max(1, vocabulary.count()) * 16)), 16, MOST_BITS))
    bitmap = spark.sparkContext.broadcast(bitmap_of(vocabulary.mapInArrow(_hashed, "run long"), bits))
    texts = staged(_count_terms(_texts(docs, doc_id, text), bitmap, bits), "search-terms")
    size = texts.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens")).first()
    documents, tokens = size["documents"], size["tokens"] or 1

    postings = texts.select(
        "row", "n", F.explode(F.arrays_zip("terms", "counts")).alias("t")
    ).select(
        "row", F.col("t.terms").alias("term"), _share(F.col("t.counts"), F.col("n"), documents, tokens).alias("share")
    )
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("share").alias("top"))
    terms = staged(terms.join(vocabulary, "term", "left_semi").withColumn("w", weight), "search-stats")
    total = terms.agg(F.sum("df")).first()[0] or 1
    salts = F.greatest(F.lit(1), _div(F.col("df") * SHARES, F.lit(total))).cast("int")
    terms = terms.withColumn("salts", salts)
    plan = staged(_term_plan(asked, terms), "search-plan")
    heavy = F.broadcast(terms.where("salts > 1").select("term", F.col("salts").alias("keys")))  # at most SHARES
    dealt = postings.join(heavy, "term", "left").withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.coalesce("keys", F.lit(1))).cast("int")
    )

    survivors, state, sums = [], None, None
    while True:
        ahead = plan
        if state is not None:
            ahead = plan.join(state.where("NOT closed").select("q", "floor", "done"), "q", "left").where(
                F.col("done").isNotNull() & (F.col("place") > F.col("done")) & (F.col("bound") >= F.col("floor"))
            )
        current = ahead.agg(F.min("round")).first()[0]
        if current is None:
            break
        ahead = ahead.where(F.col("round") == current)
        wanted = ahead.select("q", "term", "value", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        # written, so that its size is known: a small round needs no shuffle of the postings
        wanted = staged(wanted, "search-wanted")
        met = dealt.join(wanted, ["term", "salt"]).select("q", "row", (F.col("value") * F.col("share")).alias("score"))
        if sums is not None:
            going = state.where("NOT closed").select("q", "floor", "after")
            kept = sums.join(going, "q").where(F.col("score") + F.col("after") >= F.col("floor"))
            met = met.unionByName(kept.select("q", "row", "score"))
        sums = staged(met.groupBy("q", "row").agg(F.sum("score").alias("score")), "search-sums", instead=sums)
        state = staged(_states(plan, ahead, state, sums, k), "search-state")
        ended = sums.join(state.where("closed").select("q", "floor", "done", "after"), "q").where(
            F.col("score") + F.col("after") >= F.col("floor")
        )
        survivors.append(staged(ended.select("q", "row", "score", "done"), "search-survivors"))

    if sums is not None:
        drop_staged(sums)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    names = queries.select(F.col("row").alias("q"), F.col("id").alias(item_id))
    if not survivors:
        ranked = spark.createDataFrame([], "q long, score long, row long, rank int").join(
            texts.select("row", F.col("id").alias("doc")), "row"
        )
    else:
        ended = survivors[0]
        for more in survivors[1:]:
            ended = ended.unionByName(more)
        ranked = _completed(ended, plan, texts, documents, tokens).where("score > 0")
        ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names, "q").select(item_id, "rank", F.col("doc").alias(doc_id), "score")


def _states(plan: DataFrame, ahead: DataFrame, state: DataFrame | None, sums: DataFrame, k: int) -> DataFrame:
    """Per open item: the k-th best partial score, terms done, the bound of the rest, whether it is closed."""
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    top = sums.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
    floors = top.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("floor"))
    done = ahead.groupBy("q").agg(F.max("place").alias("done"))
    if state is not None:  # an item may have no term in a round
        before = state.where("NOT closed").select("q", F.col("done").alias("before"))
        done = before.join(done, "q", "left").select("q", F.coalesce("done", "before").alias("done"))
    else:
        done = plan.select("q").distinct().join(done, "q", "left").select("q", F.coalesce("done", F.lit(0)).alias("done"))
    rest = (
        plan.join(done, "q").where(F.col("place") > F.col("done"))
        .groupBy("q").agg(F.max("bound").alias("after"))
    )
    return (
        done.join(floors, "q", "left").join(rest, "q", "left")
        .select("q", "done", F.coalesce("floor", F.lit(0)).alias("floor"), F.coalesce("after", F.lit(0)).alias("after"))
        .withColumn("closed", (F.col("after") < F.col("floor")) | (F.col("after") == 0))
    )


def _completed(ended: DataFrame, plan: DataFrame, texts: DataFrame, documents: int, tokens: int) -> DataFrame:
    """Survivors with the summands of the terms that made no accumulators, from their documents."""
    closed = ended.select("q", "done").distinct()
    rest = (
        plan.join(closed, "q").where(F.col("place") > F.col("done"))
        .groupBy("q").agg(F.collect_list(F.struct("term", "value")).alias("rest"))
    )
    whole = ended.join(rest, "q", "left").join(texts, "row")

    def summand(t: Column) -> Column:
        at = F.array_position("terms", t["term"])
        count = F.get("counts", (at - 1).cast("int"))
        return F.when(at > 0, t["value"] * _share(count, F.col("n"), documents, tokens)).otherwise(0)

    more = F.aggregate("rest", F.lit(0).cast("long"), lambda acc, t: acc + summand(t))
    return whole.select("q", "row", F.col("id").alias("doc"), (F.col("score") + F.coalesce(more, F.lit(0))).alias("score"))
