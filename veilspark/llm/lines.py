"""Line dedup by a deletion-neighbourhood join over the words of a line.

Lines are compared as sequences of lower-cased words.  A line is removed if an earlier line
(smaller document id, or same document and higher up) has the same words, or is at an edit
distance of one: one word more, less or exchanged.  One edit is looked for between lines of
``least`` words or more, as in a shorter one it is more than a fifth of the line; equality
between all lines with a word.

1. Equal lines become one, at its first place.
2. Two lines one edit apart share their first or their last half.  Halves are hashed and
   counted; only lines that share one go on.
3. Those emit their deletion neighbourhood: the hash of the line without one word, for every
   word outside the shared half, and of the whole line.  Equal variants are joined: the
   earliest line of a variant is paired with each other one that has it, so a variant of many
   lines makes one pair per line, not all pairs.
4. The edit distance of each pair is verified on the words themselves.

Variants carry the place of the missing word: two lines without a word at the same place
differ by an exchange; a whole line that equals another without a word differs by that word.
So the earliest line of a variant is within one edit of all that have it.

Defined cases: a null text has no lines and stays null; an empty text stays empty; lines
without words stay; ties cannot occur, as a place is unique, but rows of one document id are
copies of one document and are judged alike; null is the smallest id; an empty table gives no
rows; all columns are kept, other columns may have any name not starting with ``_line``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .base import free_name, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NULL_ID = -(2**63)
LEAST = 5


def _line_words(texts: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of each line with one: document, number, first word (one more at the end)."""
    words = W.split_words(texts, lower=True)
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.starts)
    docs = words.documents()
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(new)
    doc = docs[first]
    number = line[first] - np.searchsorted(breaks, words.offsets[doc])
    return words, doc, number, np.append(first, len(line))


def _halves(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Each line with a word: place, hash and, from ``least`` words on, hashes of its halves."""
    for batch, texts in W.slices(batches):
        ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        words, doc, number, first = _line_words(texts)
        h = words.hashes
        a, b = first[:-1], first[1:]
        n = b - a
        long = n >= least
        hash_of = lambda x, y, salt: W.mix(W.span_hashes(h, x, y) + (y - x).astype(np.uint64), salt)
        # lengths that a partner of n - 1, n or n + 1 words has in common with this line
        heads = [hash_of(a, a + k, 1) | np.uint64(1) for k in (n // 2, (n + 1) // 2)]
        tails = [hash_of(b - k, b, 2) & ~np.uint64(1) for k in (n // 2, (n - 1) // 2)]
        keys = np.stack([*heads, *tails], axis=1)[long] if len(a) else np.zeros((0, 4), np.uint64)
        offsets = pa.array(np.append(0, np.cumsum(long * 4)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc]), pa.array(number, pa.int32()), W.signed(hash_of(a, b, 0)),
             pa.ListArray.from_arrays(offsets, W.signed(keys.ravel()))],
            names=["doc", "line", "whole", "halves"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The named lines of each document, lower-cased words by single spaces."""
    for batch in batches:
        out = ([], [], [], [], [])
        for doc, text, wanted in zip(*(batch.column(n).to_pylist() for n in ("doc", "text", "wanted")), strict=True):
            lines = (text or "").encode().split(b"\n")
            for w in wanted:
                found = lines[w["line"]] if w["line"] < len(lines) else b""
                for column, value in zip(out, (doc, w["line"], w["head"], w["tail"], b" ".join(found.lower().split()).decode()), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc", "line", "head", "tail", "words"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each line (``whole``) and of the line without one word."""
    for batch, texts in W.slices(batches, "words", W.SLICE_BYTES // 4):
        words = W.split_words(texts)
        h = words.hashes
        first = words.first
        n = np.diff(first)
        row = words.documents()
        at = np.arange(len(h)) - first[row]
        head = batch.column("head").to_numpy(zero_copy_only=False)[row]
        tail = batch.column("tail").to_numpy(zero_copy_only=False)[row]
        # a word of the half that is shared is not the one that differs
        size = n[row]
        use = np.flatnonzero((head & (at >= size // 2)) | (tail & (at <= size - (size - 1) // 2)))
        row, at = row[use], at[use]
        up, down = W.powers(int(n.max(initial=0)) + 2)
        whole = W.span_hashes(h, first[:-1], first[1:])
        before = W.span_hashes(h, first[row], first[row] + at)
        after = W.span_hashes(h, first[row] + at + 1, first[row + 1])
        # the words behind the gap move up by one place
        without = before + after * up[at]
        length = (n[row] - 1).astype(np.uint64)
        gap = W.mix(without + length, 3) + at.astype(np.uint64)
        key = np.concatenate((
            W.mix(whole + n.astype(np.uint64), 4), W.mix(without + length, 4), W.mix(gap, 5),
        ))
        rows = np.concatenate((np.arange(len(n)), row, row))
        kind = np.concatenate((np.zeros(len(n)), np.ones(len(row)), np.full(len(row), 2))).astype(np.int8)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [W.signed(key), pa.array(kind), batch.column("doc").take(take), batch.column("line").take(take)],
            names=["key", "kind", "doc", "line"],
        )


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance over words, or ``most`` + 1 if it is larger."""
    row = list(range(len(b) + 1))
    if abs(len(a) - len(b)) > most:
        return most + 1
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last, row[low - 1] = row[low - 1], i if low == 1 else most + 1
        for j in range(low, high + 1):
            last, row[j] = row[j], min(last + (x != b[j - 1]), row[j] + 1 if j < i + most else most + 1, row[j - 1] + 1)
        if min(row[low - 1 : high + 1]) > most:
            return most + 1
    return min(row[len(b)], most + 1)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose lines are at most one edit apart."""
    for batch in batches:
        pairs = zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)
        ok = [word_distance(a.split(" "), b.split(" "), 1) <= 1 for a, b in pairs]
        yield batch.filter(pa.array(ok, pa.bool_())).select(["doc", "line"])


def repeated_lines(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of the lines to remove: ``doc`` (null as the smallest long) and ``line``, from zero."""
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text).cast("string").alias("text")
    )
    place = F.struct("doc", "line")
    lines = staged(
        rows.mapInArrow(lambda b: _halves(b, least), "doc long, line int, whole long, halves array<long>"), "lines"
    )
    # copies make one row per task before they are shuffled
    distinct = staged(
        lines.groupBy("whole").agg(F.min(F.struct("doc", "line", "halves")).alias("first"), F.count(F.lit(1)).alias("n")),
        "distinct-lines",
    )
    single = distinct.select(
        "whole", "first.doc", "first.line", F.explode(F.array_distinct("first.halves")).alias("half")
    )
    head = F.col("half") % 2 != 0
    often = single.groupBy("half").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    wanted = (
        single.join(often.select("half"), "half")
        .groupBy("doc", "line").agg(F.bool_or(head).alias("head"), F.bool_or(~head).alias("tail"))
        .groupBy("doc").agg(F.collect_list(F.struct("line", "head", "tail")).alias("wanted"))
    )
    near = staged(
        rows.join(wanted, "doc").mapInArrow(
            _texts, "doc long, line int, head boolean, tail boolean, words string"
        ),
        "near-lines",
    )
    variants = near.mapInArrow(_variants, "key long, kind byte, doc long, line int")
    least_of = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, place)).alias("whole"),
        F.min(F.when(F.col("kind") > 0, place)).alias("part"),
        F.max(place).alias("last"),
    ).where("coalesce(whole, part) < last OR part < last")
    own = F.col("own")
    met = variants.select("key", "kind", place.alias("own")).join(least_of.drop("last"), "key")
    # whole lines meet lines without a word; lines without a word at one place meet each other
    partner = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("part"))
    pairs = met.select(own, partner.alias("partner")).where("partner < own").distinct()
    a = near.select(place.alias("own"), "words").distinct()
    b = near.select(place.alias("partner"), F.col("words").alias("other")).distinct()
    checked = pairs.join(a, "own").join(b, "partner").select("own.doc", "own.line", "words", "other")
    close = checked.mapInArrow(_close, "doc long, line int").distinct()
    # a line one edit from an earlier one goes with all its copies
    gone = close.join(distinct.select("whole", "first.doc", "first.line"), ["doc", "line"]).select("whole")
    copies = (
        lines.join(distinct.where("n > 1").select("whole", "first.doc", "first.line").withColumnsRenamed({"doc": "d", "line": "l"}), "whole")
        .where("doc <> d OR line <> l").select("doc", "line")
    )
    near_copies = lines.join(gone, "whole", "left_semi").select("doc", "line")
    return copies.unionByName(near_copies).distinct()


def remove_repeated_lines(
    docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", removed: str = "_lines_removed"
) -> DataFrame:
    """All columns, ``text`` without the repeated lines, and how many there were: ``removed``.

    A column that is called like ``removed`` already is replaced.
    """
    names = [c for c in docs.columns if c != removed]
    doc, places = free_name(docs, "_line_doc"), free_name(docs, "_lines")
    gone = repeated_lines(docs, least, key, text).groupBy(F.col("doc").alias(doc)).agg(
        F.collect_list("line").alias(places)
    )
    rows = docs.withColumn(doc, F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)))
    schema = T.StructType(list(docs.select(*names).schema.fields)).add(removed, "long")
    return rows.join(gone, doc, "left").select(*names, places).mapInArrow(
        lambda b: _drop(b, names, text, places, removed), schema
    )


def _drop(
    batches: Iterator[pa.RecordBatch], names: list[str], text: str, places: str, removed: str
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for old, gone in zip(batch.column(text).to_pylist(), batch.column(places).to_pylist(), strict=True):
            if gone:
                drop = set(gone)
                old = "\n".join(x for i, x in enumerate(old.split("\n")) if i not in drop)
            texts.append(old)
            counts.append(len(gone or ()))
        columns = [pa.array(texts, batch.schema.field(n).type) if n == text else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, removed])
