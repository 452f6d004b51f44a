"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order, that of their hash.  It is cut into
fragments, and every document's set of n-grams with it.  If two sets have a Jaccard
similarity of t or more and the smaller has s n-grams, they differ in at most s (1 - t) / t
of them; with more fragments than that, one fragment at least is equal in both.

1. Every document emits a key for each of its non-empty fragments.  The number of fragments
   depends on a class of sizes; a document emits them for the classes that a smaller partner
   can have.  Documents of equal sets count once, as the one with the smallest id.
2. Keys are counted.  Of a document's fragments, the rarest first, only the first
   s (1 - t) / t + 1 have to be looked at, one of which a partner shares (prefix filter).
   Fragments that nobody else has come first, so most documents drop out here, and keys of
   passages that many documents share are rarely needed.  Documents that share a key are
   compared with one of them, the leader of the key (a star, not all pairs).  Overlaps are
   counted fragment by fragment and summed per pair.
3. Links make components.  Keys whose documents are not all in one component are compared
   again, with the most central document as the leader; what is still apart then is compared
   pair by pair, so that no link is lost.  Components follow from all links.

Every set has a parity sketch: a bit for each remainder of the hashes, flipped by each n-gram.
Two sets differ in at least as many n-grams as their sketches do in bits, so pairs whose
sketches differ in more than (a + b) (1 - t) / (1 + t) bits cannot be linked.  They are left
out before texts are fetched, and where documents are compared pair by pair, inside the join.

In sets of fewer than ``SMALL`` n-grams, and what they can be linked with, every n-gram is a
fragment.  From ``SMALL`` on, ``SPARE`` more fragments than needed make a pair without an
equal, non-empty one improbable (below 1e-9).

Keys are counted in ``ROUNDS`` parts, and keys and sketches are removed from disk once no later
step reads them; the shuffles of a step go before the next one starts.

Defined cases: a null text or one without words has an empty set and no link; a text of fewer
words than ``n`` has its whole sequence as its only n-gram; rows of one id with equal sets are
one document; with different ones each has its own ``n_shingles``, a link of one is a link of
the id, and if one is a copy of another document's set, the others are not compared further; a
null id is left out of the links and its own component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .base import release, staged
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL, SPARE, CLASS_RATIO = 64, 8, 1.5
PARITY = 8  # bits of a sketch for each n-gram that two similar sets can differ in
BITS = 52  # of a hash; the other 12 number the documents of a slice
FRAGMENTS = 16  # in which overlaps are counted
ROUNDS = 4  # in which keys are counted: each shuffles its part of them


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct n-grams, sorted, of up to 4,096 texts."""
    words = W.split_words(texts, lower=True)
    h = words.hashes
    grams, inside = W.windows(words, n, h)
    at = np.flatnonzero(inside)
    docs = words.documents()[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    first = words.first[short]
    last = first + counts[short]
    few = W.mix(W.span_hashes(h, first, last), 1) + counts[short].astype(np.uint64)
    value = np.concatenate((grams[at], few)) >> np.uint64(64 - BITS)
    doc = np.concatenate((docs, short))
    key = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | value)
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64(2**BITS - 1)


def size_classes() -> np.ndarray:
    """Upper bounds of the classes of sizes."""
    bounds = [SMALL - 1]
    while bounds[-1] < 2**40:
        bounds.append(int(bounds[-1] * CLASS_RATIO) + 1)
    return np.array(bounds)


SETS = (
    "doc_id long, n long, signature long, own boolean, class int, differing int, "
    "keys array<long>, parity array<long>"
)


def parity(row: np.ndarray, value: np.ndarray, rows: int, most: int) -> np.ndarray:
    """A sketch per row of sets that, if similar, differ in at most ``most`` values."""
    bits = 64 * (PARITY * most // 64 + 1)
    flips = np.bincount(row * bits + (value % np.uint64(bits)).astype(np.int64), minlength=rows * bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64)


def _keys(batches: Iterator[pa.RecordBatch], n: int, t: Fraction) -> Iterator[pa.RecordBatch]:
    """A row per document and class of sizes a smaller partner can have, own: its own class."""
    bounds = size_classes()
    for batch, texts in _few(W.slices(batches)):
        doc, value = shingles(texts, n)
        size = np.bincount(doc, minlength=len(texts))
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        signature = W.mix(W.span_hashes(W.mix(value), first[:-1], first[1:])) + size.astype(np.uint64)
        least = -(-size * t.numerator // t.denominator)  # the smallest partner
        low, high = np.searchsorted(bounds, least), np.searchsorted(bounds, size)
        for c in np.unique(np.concatenate((low, high))):
            docs = np.flatnonzero((low <= c) & (high >= c))
            # n-grams that the smaller of two similar sets can differ in, of all their n-grams
            differing = (np.minimum(size[docs], bounds[c]) * (1 - t).numerator // t.numerator).astype(np.int32)
            rows = ((low <= c) & (high >= c))[doc]
            d, v = doc[rows], value[rows]
            if c == 0:
                keys, of = W.mix(v, 1), d
            else:
                fragments = int(bounds[c] * (1 - t) / t) + 1 + SPARE
                cut = (v >> np.uint64(20)) * np.uint64(fragments) >> np.uint64(BITS - 20)
                breaks = np.ones(len(d), bool)
                breaks[1:] = (d[1:] != d[:-1]) | (cut[1:] != cut[:-1])
                heads = np.flatnonzero(breaks)
                ends = np.append(heads[1:], len(d))
                keys, of = W.mix(W.span_hashes(W.mix(v), heads, ends) + W.mix(cut[heads], int(c) + 2)), d[heads]
            offsets = np.append(np.searchsorted(of, docs), len(of)).astype(np.int32)
            sketch = parity(np.searchsorted(docs, d), v, len(docs), int(bounds[c] * (1 - t) / t))
            cuts = np.linspace(0, len(sketch), len(docs) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs)), pa.array(size[docs], pa.int64()), W.signed(signature[docs]),
                 pa.array(high[docs] == c), pa.array(np.full(len(docs), c, np.int32)), pa.array(differing),
                 pa.ListArray.from_arrays(pa.array(offsets), W.signed(keys)),
                 pa.ListArray.from_arrays(pa.array(cuts), W.signed(sketch))],
                names=["doc_id", "n", "signature", "own", "class", "differing", "keys", "parity"],
            )


def _few(parts, most: int = 4096):
    """Slices of at most 4,096 rows."""
    for batch, texts in parts:
        for low in range(0, len(texts), most):
            yield batch.slice(low, most), texts.slice(low, most)


def _compare(batches: Iterator[pa.RecordBatch], n: int, t: Fraction) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts have a similarity of t or more."""
    for batch, left in _few(W.slices(batches, "text_a", W.SLICE_BYTES, beside="text_b")):
        right = batch.column("text_b").cast(pa.large_string()).fill_null("")
        doc_a, a = shingles(left, n)
        doc_b, b = shingles(right, n)
        pair = np.concatenate((doc_a, doc_b)).astype(np.uint64)
        both = np.sort((pair << np.uint64(BITS)) | np.concatenate((a, b)))
        common = both[1:][both[1:] == both[:-1]]
        fragment = (common & np.uint64(2**BITS - 1)) * np.uint64(FRAGMENTS) >> np.uint64(BITS)
        partial = np.bincount(
            ((common >> np.uint64(BITS)) * np.uint64(FRAGMENTS) + fragment).astype(np.int64),
            minlength=len(left) * FRAGMENTS,
        )
        overlap = partial.reshape(-1, FRAGMENTS).sum(axis=1)
        union = np.bincount(doc_a, minlength=len(left)) + np.bincount(doc_b, minlength=len(left)) - overlap
        linked = (overlap * t.denominator >= union * t.numerator) & (union > 0)
        kept = batch.select(["a", "b"]).filter(pa.array(linked))
        if kept.num_rows:
            yield kept


def _verify(pairs: DataFrame, texts: DataFrame, n: int, t: Fraction) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that are similar enough."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(lambda batches: _compare(batches, n, t), "a long, b long")


def _met(single: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each document's keys that another row has as well, with how ``often`` there are such rows.

    To count the keys and to join the counts are two shuffles of all keys; both are done for one
    part of the keys after another, and their files removed before the next.
    """
    keyed = single.select(
        "doc_id", "class", "differing", F.size("keys").alias("fragments"), F.explode("keys").alias("key")
    )
    parts = []
    for i in range(rounds):
        own = keyed.where(F.pmod("key", F.lit(rounds)) == i)
        often = own.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
        parts.append(staged(own.join(often, "key"), "ngram-met"))
        release(single.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def similar_documents(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``.

    ``members``: ``doc_id``, ``n_shingles`` and ``component_id``, one row per row of ``docs``.
    ``links``: pairs of representatives ``a``, ``b`` that were found similar; they connect
    each component, equal sets standing for one another.
    """
    t = Fraction(similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = staged(rows.mapInArrow(lambda batches: _keys(batches, n, t), SETS), "ngram-sets")
    sets = staged(written.where("own").select("doc_id", "n", "signature"), "ngram-sizes")
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    same = full.groupBy("signature", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copies = staged(
        full.join(same.where("rep < last").drop("last"), ["signature", "n"])
        .where("doc_id > rep").select("doc_id", "rep").distinct(),
        "ngram-copies",
    )
    # the keys are most of what is written: where the copies are many, this join shuffles them once
    single = written.where("n > 0").join(copies.select("doc_id"), "doc_id", "left_anti")
    single = staged(single.drop("signature", "own"), "ngram-single", instead=written)
    release(docs.sparkSession)
    # of similar documents at most `differing` fragments are not shared: of each one's fragments,
    # the rarest first, one of the first differing + 1 is; most documents have more rare ones
    per_class = Window.partitionBy("doc_id", "differing", "fragments")
    met = _met(single).select(
        "key", "doc_id", "class",
        F.row_number().over(per_class.orderBy("often", "key")).alias("place"),
        (F.col("fragments") - F.count(F.lit(1)).over(per_class)).alias("alone"),
        "differing",
    )
    shared = staged(met.where("place + alone <= differing + 1").select("key", "doc_id", "class"), "ngram-keys")
    groups = shared.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = staged(
        shared.join(groups.where("low < high"), "key").select("key", "doc_id", "class", "low"), "ngram-keys", instead=shared
    )
    open_docs = shared.select("doc_id").distinct()
    sketches = staged(
        single.select("doc_id", "class", F.struct("n", "parity").alias("sketch")).join(open_docs, "doc_id", "left_semi"),
        "ngram-sketches", instead=single,
    )
    release(docs.sparkSession)
    texts = staged(rows.join(open_docs, "doc_id", "left_semi"), "ngram-texts")
    release(docs.sparkSession)

    def alike(x: str, y: str) -> Column:
        """Whether two sketches allow the similarity."""
        bits = F.zip_with(f"{x}.parity", f"{y}.parity", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        differ = F.aggregate(bits, F.lit(0), lambda total, k: total + k)
        return differ * (t.denominator + t.numerator) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (
            t.denominator - t.numerator
        )

    def pairs(found: DataFrame, x: str, y: str) -> DataFrame:
        """Distinct pairs whose sketches allow the similarity."""
        named = found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "class").where("a < b")
        named = named.groupBy("a", "b").agg(F.min("class").alias("class"))
        for side in ("a", "b"):
            named = named.join(
                sketches.select(F.col("doc_id").alias(side), "class", F.col("sketch").alias(f"sketch_{side}")),
                [side, "class"],
            )
        return named.where(alike("sketch_a", "sketch_b")).select("a", "b").distinct()

    links = staged(_verify(pairs(shared, "doc_id", "low"), texts, n, t), "ngram-links")
    all_links = [links]
    for turn in range(2):
        label = components(reduce(DataFrame.unionByName, all_links))
        named = shared.join(label, F.col("doc_id") == F.col("node"), "left").select(
            "key", "doc_id", "class", F.coalesce("component", "doc_id").alias("component")
        )
        apart = named.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"))
        open_rows = staged(named.join(apart.where("c < d").select("key"), "key"), "ngram-open")
        if open_rows.isEmpty():
            break
        if turn == 0:
            # the document that shares the most with others leads its keys
            members = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            weight = open_rows.join(members, "key").groupBy("doc_id").agg(F.sum("size").alias("weight"))
            leader = open_rows.join(weight, "doc_id").groupBy("key").agg(
                F.max_by(F.struct("doc_id", "component"), F.struct("weight", "doc_id")).alias("lead")
            )
            found = open_rows.join(leader, "key").where("component <> lead.component").select(
                "doc_id", F.col("lead.doc_id").alias("other"), "class"
            )
            near = pairs(found, "doc_id", "other")
        else:
            known = staged(open_rows.join(sketches, ["doc_id", "class"]), "ngram-open")
            other = known.select(
                F.col("key").alias("same"), F.col("doc_id").alias("other"),
                F.col("component").alias("theirs"), F.col("sketch").alias("sketch_other"),
            )
            meet = (F.col("key") == F.col("same")) & (F.col("component") < F.col("theirs"))
            near = known.join(other, meet & alike("sketch", "sketch_other")).select(
                F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")
            ).distinct()
        all_links.append(staged(_verify(near, texts, n, t), "ngram-links"))
    links = reduce(DataFrame.unionByName, all_links)
    label = components(links)
    rep = sets.join(copies, "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    members = rep.join(label, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    return members, links
