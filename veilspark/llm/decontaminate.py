"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles, runs of at least ``seed`` words that
both have in the same order and that do not overlap, cover the share ``coverage`` of the
item's words.  The tiles may stand in any order, so reordered passages are caught.  An item of
fewer than ``seed`` words is found where it stands as a whole.

1. The runs of ``seed`` words of the items set bits in a bitmap of a fixed size, whatever the
   number of items.  Documents keep the stretches whose runs hit it, with false hits.
2. The runs in these stretches are joined with those of the items, which leaves the pairs of
   document and item that share enough runs for the coverage asked for.
3. Each pair is tiled: running Karp-Rabin hashes of a falling length find the longest
   matches between words not yet marked, which are marked first.

Defined cases: a null text has no words; an item without words is never found;
repeated items are reported each; rows of one document id are one document, its stretches
taken together; a null document or item id takes part like any other; empty tables give no
rows; other columns are ignored, or kept by ``remove_contaminated``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .base import free_name, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED, COVERAGE = 5, Fraction(1, 2)
FILTER_BITS = 22  # of the bitmap: 512 KiB
_BUCKET = 32768  # bits in a bitmap of bitmap_construct_agg


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), W.signed(values))


def _item_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Each item's words as hashes, and its runs."""
    for batch, texts in W.slices(batches):
        words = W.split_words(texts, lower=True)
        h = words.hashes
        runs, inside = W.windows(words, seed, h)
        at = np.flatnonzero(inside)
        runs = runs[at]
        for n in range(1, seed):  # an item of n words is one run
            whole = words.first[:-1][words.counts() == n]
            at, runs = np.append(at, whole), np.append(runs, W.windows(words, n, h)[0][whole])
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], words.first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _lists(words.first, h), _lists(bounds, runs[order])], names=["item_id", "words", "runs"]
        )


def _stretches(
    batches: Iterator[pa.RecordBatch], lengths: list[int], bitmap: np.ndarray, bits: int
) -> Iterator[pa.RecordBatch]:
    """Stretches of each document whose runs of a length hit the bitmap: first word, words, runs."""
    for (batch, texts), seed in ((part, n) for part in W.slices(batches) for n in lengths):
        words = W.split_words(texts, lower=True)
        h = words.hashes
        runs, inside = W.windows(words, seed, h)
        at = np.flatnonzero(inside & bitmap[(runs >> np.uint64(64 - bits)).astype(np.int64)]) if len(runs) else np.zeros(0, np.int64)
        if not len(at):
            continue
        docs = words.documents()[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (docs[1:] != docs[:-1])
        head = np.flatnonzero(new)
        bounds = np.append(head, len(at))
        doc = docs[head]
        first, last = at[head], at[bounds[1:] - 1] + seed
        size = last - first
        ends = np.cumsum(size)
        each = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array((first - words.first[doc]).astype(np.int32)),
             _lists(np.append(0, ends), h[each]), _lists(bounds, runs[at])],
            names=["doc_id", "start", "words", "runs"],
        )


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in doc, length), the longest matches first."""
    out: list[tuple[int, int, int]] = []
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    length = max(least, min(len(item), len(doc)))
    while True:
        matches: list[tuple[int, int, int]] = []
        grown = 0
        if min(len(item), len(doc)) >= length:
            # running hashes of all runs of this length, of words that are all free
            sides = []
            for values, free in ((item, free_item), (doc, free_doc)):
                at = np.arange(len(values) - length + 1)
                full = np.concatenate(([0], np.cumsum(free)))
                at = at[full[at + length] - full[at] == length]
                sides.append((W.span_hashes(values, at, at + length), at))
            (a, at_a), (b, at_b) = sides
            order = np.argsort(a, kind="stable")
            a, at_a = a[order], at_a[order]
            low, high = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
            for j, x, y in zip(at_b[low < high], low[low < high], high[low < high], strict=True):
                for i in at_a[x:y]:
                    # the run to the left of a match is found from there
                    if i and j and free_item[i - 1] and free_doc[j - 1] and item[i - 1] == doc[j - 1]:
                        continue
                    n = 0
                    while (
                        i + n < len(item) and j + n < len(doc) and free_item[i + n]
                        and free_doc[j + n] and item[i + n] == doc[j + n]
                    ):
                        n += 1
                    if n >= length:
                        matches.append((n, int(i), int(j)))
                        grown = max(grown, n)
        if grown > 2 * length:
            length = grown  # look for the long ones first
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[i : i + n].all() and free_doc[j : j + n].all():
                free_item[i : i + n] = free_doc[j : j + n] = False
                out.append((i, j, n))
        if any(
            not (free_item[i : i + n].all() and free_doc[j : j + n].all()) and _rest(free_item[i : i + n] & free_doc[j : j + n]) >= length
            for n, i, j in matches
        ):
            continue  # what a marked tile has left of another match may still be long enough
        if length == least:
            return out
        length = max(least, length // 2)


def _rest(free: np.ndarray) -> int:
    """Longest stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _tile(batches: Iterator[pa.RecordBatch], seed: int, coverage: Fraction) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, columns = [], ([], [], [], [])
        for k in range(batch.num_rows):
            item = np.array(batch.column("words")[k].values).view(np.uint64)
            places, doc = [], []
            for n, s in enumerate(batch.column("stretches")[k].values):
                found = np.array(s["words"].values).view(np.uint64)
                # a word no item has keeps tiles inside one stretch
                doc.append(np.append(found, W.mix(np.array([n], np.uint64), 99)))
                places.append(s["start"].as_py() + np.arange(len(found) + 1))
            doc, places = np.concatenate(doc), np.concatenate(places)
            found = tiles(item, doc, min(seed, len(item)))
            covered = sum(n for _, _, n in found)
            if covered * coverage.denominator >= coverage.numerator * len(item):
                keep.append(k)
                spans = [{"item_start": i, "doc_start": int(places[j]), "n": n} for i, j, n in sorted(found)]
                for column, value in zip(columns, (len(item), covered, covered / len(item), spans), strict=True):
                    column.append(value)
        if keep:
            rows = batch.select(["doc_id", "item_id"]).take(pa.array(keep))
            span = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("n", pa.int32())])
            types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(span))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"],
            )


def bitmap_of(runs: DataFrame, bits: int) -> np.ndarray:
    """2**bits flags; ``runs`` has a column ``run``.  Its size does not depend on the rows."""
    bit = F.shiftrightunsigned("run", 64 - bits)
    parts = runs.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(_BUCKET - 1)).alias("flags")
    )
    out = np.zeros(1 << bits, bool)
    for r in parts.collect():  # at most 2**bits / 32768 rows of 4 KiB
        flags = np.unpackbits(np.frombuffer(r["flags"], np.uint8), bitorder="little")
        out[r["part"] * _BUCKET :][: len(flags)] = flags[: len(out) - r["part"] * _BUCKET]
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: Fraction = COVERAGE, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``doc_id``, ``item_id``, ``item_words``, ``covered`` words, ``coverage`` and the ``tiles``."""
    spark = docs.sparkSession
    coverage = Fraction(coverage)
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = staged(
        source.mapInArrow(lambda b: _item_words(b, seed), "item_id long, words array<long>, runs array<long>"), "items"
    ).withColumn("item", F.monotonically_increasing_id())
    items = staged(items, "items")
    runs = items.select("item", F.size("words").alias("n"), F.posexplode("runs").alias("at", "run"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(runs, filter_bits))
    short = items.where((F.size("words") < seed) & (F.size("words") > 0)).select(F.size("words").alias("n")).distinct()
    lengths = [seed, *sorted(r["n"] for r in short.collect())]  # as many as the seed has words, at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stretches = staged(
        rows.mapInArrow(
            lambda b: _stretches(b, lengths, bitmap.value, filter_bits),
            "doc_id long, start int, words array<long>, runs array<long>",
        ),
        "stretches",
    )
    met = stretches.select("doc_id", F.explode(F.array_distinct("runs")).alias("run")).join(runs, "run")
    enough = F.col("common") * seed * coverage.denominator >= F.col("n") * coverage.numerator
    pairs = (
        met.select("doc_id", "item", "n", "at").distinct()
        .groupBy("doc_id", "item", "n").agg(F.count(F.lit(1)).alias("common")).where(enough)
        .select("doc_id", "item")
    )
    pairs = staged(pairs, "pairs")
    # only stretches with a run of an item in question, by document: no more than its text
    known = stretches.select("doc_id", "start", "words").withColumnRenamed("doc_id", "_doc")
    asked = pairs.select(F.col("doc_id").alias("_asked")).distinct()
    texts = (
        known.join(asked, F.col("_doc").eqNullSafe(F.col("_asked")), "left_semi")
        .groupBy("_doc").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("stretches"))
    )
    joined = pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(items.select("item", "item_id", "words"), "item")
    return joined.select("doc_id", "item_id", "words", "stretches").mapInArrow(
        lambda b: _tile(b, seed, coverage),
        "doc_id long, item_id long, item_words long, covered long, coverage double, "
        "tiles array<struct<item_start:int,doc_start:int,n:int>>",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates, all columns."""
    name = free_name(docs, "_found")
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")
