"""Substring dedup over a compacted De Bruijn graph of words.

Every run of ``k`` consecutive words of a document is an edge between two (k-1)-word nodes.
An edge is repeated if its words also start earlier, by document id, then by position; its
source is such a place, the first one in the slice or else in the bucket that saw both.
Words covered by an edge with a source are removed.  Edges are judged on the input, not on
what is left.

1. Edges are bucketed by their minimizer, the smallest hash among the m-word runs inside
   them: equal edges have equal minimizers, so equal edges meet in one bucket.  Neighbouring
   edges of a bucket travel as one row (some seven edges).  A map task compares the edges of
   a slice among themselves first and only sends on the first of equal ones, so a passage
   in a third of all documents makes one row per slice, not one per document.
2. Where a bucket meets, repeated edges find their source, and nonbranching paths are
   compacted: edges that follow each other in the copy and in the source become one row.
3. Paths are glued across buckets by the coordinates of copy and source (a window over one
   document's paths), which gives the repeated spans: copy, start, length, source, start.
4. The spans of a document are joined to its text and their words removed.

Defined cases: a null text has no words; a document of fewer than ``k`` words keeps all; rows
of one id are copies of one document, none is the source of another; null is the smallest id;
an empty table gives no rows; other columns are kept, except that none may be called
``n_words``, ``n_removed`` or ``kept`` (they are replaced).

Edges are compared by all 64 bits of the minimizer's hash and 48 of the edge's own: in a slice
by both hashes in full, in a bucket bit by bit.  Words are not compared again at the source.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTES = 6  # of an edge's hash that travel
EDGES_AT_ONCE = 2 << 20
NULL_ID = -(2**63)
ROW = "bucket long, doc long, start int, edges binary, n int, src_doc long, src_start int"
PATH = "doc long, start int, n int, src_doc long, src_start int"


def _runs(breaks: np.ndarray) -> np.ndarray:
    """First index of each run; ``breaks[i]`` says that i does not continue i - 1."""
    if not len(breaks):
        return np.zeros(0, np.int64)
    breaks = breaks.copy()
    breaks[0] = True
    return np.flatnonzero(breaks)


def _paths(doc, start, src_doc, src_start) -> list[np.ndarray]:
    """Rows that follow each other in copy and source as one: doc, start, n, source."""
    order = np.lexsort((start, doc))
    doc, start, src_doc, src_start = (x[order] for x in (doc, start, src_doc, src_start))
    breaks = np.ones(len(doc), bool)
    breaks[1:] = ~(
        (doc[1:] == doc[:-1])
        & (start[1:] == start[:-1] + 1)
        & (src_doc[1:] == src_doc[:-1])
        & (src_start[1:] == src_start[:-1] + 1)
    )
    first = _runs(breaks)
    n = np.diff(np.append(first, len(doc)))
    return [doc[first], start[first], n, src_doc[first], src_start[first]]


def _edges(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    """Bucket rows of the first of equal edges in a slice, and paths of the others."""
    schema = pa.schema([
        ("bucket", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("edges", pa.binary()),
        ("n", pa.int32()), ("src_doc", pa.int64()), ("src_start", pa.int32()),
    ])
    for batch, texts in W.slices(batches, limit=2 * W.SLICE_BYTES):
        ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, texts = ids[order], texts.take(pa.array(order))
        words = W.split_words(texts)
        h = words.hashes
        edge, inside = W.windows(words, k, h)
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        parts, _ = W.windows(words, m, h)
        low, where = parts[: len(edge)].copy(), np.arange(len(edge))
        for shift in range(1, k - m + 1):
            other = parts[shift : shift + len(edge)]
            less = other < low
            low[less] = other[less]
            where[less] = np.flatnonzero(less) + shift
        docs = words.documents()[at]
        doc, start = ids[docs], (at - words.first[docs]).astype(np.int32)
        edge, low, where = edge[at], low[at], where[at]
        _, first, group = np.unique(edge, return_index=True, return_inverse=True)
        source = first[group]
        # a hash alone is not trusted: edges of another minimizer than the first one's travel
        source = np.where(low == low[source], source, np.arange(len(edge)))
        # rows of one id have equal coordinates: neither is the other's source
        own = (doc == doc[source]) & (start == start[source])
        later = np.flatnonzero(~own)
        paths = _paths(doc[later], start[later], doc[source[later]], start[source[later]])
        keep = np.flatnonzero(own)
        d, s, b = doc[keep], start[keep], where[keep]
        breaks = np.ones(len(keep), bool)
        breaks[1:] = ~((d[1:] == d[:-1]) & (s[1:] == s[:-1] + 1) & (b[1:] == b[:-1]))
        heads = _runs(breaks)
        raw = np.ascontiguousarray(edge[keep]).view(np.uint8).reshape(-1, 8)[:, :BYTES]
        offsets = (np.append(heads, len(keep)) * BYTES).astype(np.int32)
        packed = pa.Array.from_buffers(
            pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]
        )
        none = pa.nulls(len(heads), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [W.signed(low[keep][heads]), pa.array(d[heads]), pa.array(s[heads]), packed, none,
             pa.nulls(len(heads), pa.int64()), none], schema=schema)
        if len(paths[0]):
            n = len(paths[0])
            yield pa.RecordBatch.from_arrays(
                [W.signed(W.mix(paths[0].view(np.uint64))), pa.array(paths[0]), pa.array(paths[1], pa.int32()),
                 pa.nulls(n, pa.binary()), pa.array(paths[2], pa.int32()), pa.array(paths[3]),
                 pa.array(paths[4], pa.int32())], schema=schema)


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compacted paths of the edges that have an earlier source, for whole buckets."""
    schema = pa.schema([
        ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
        ("src_doc", pa.int64()), ("src_start", pa.int32()),
    ])
    held: list[tuple] = []
    for batch in batches:
        known = batch.column("edges").is_null()
        done = batch.filter(known)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(n) for n in schema.names], schema=schema)
        rows = batch.filter(pc.invert(known))
        if rows.num_rows:
            column = rows.column("edges")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            held.append((
                rows.column("bucket").to_numpy().view(np.uint64), rows.column("doc").to_numpy(),
                rows.column("start").to_numpy(), np.diff(offsets) // BYTES, raw.copy(),
            ))
    if not held:
        return
    bucket, doc, start, n, raw = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    raw = raw.reshape(-1, BYTES)
    first = np.concatenate(([0], np.cumsum(n)))
    rounds = -(-len(raw) // EDGES_AT_ONCE)  # whole buckets at a time, some at once
    for turn in range(rounds):
        rows = np.flatnonzero(bucket % np.uint64(rounds) == turn) if rounds > 1 else np.arange(len(bucket))
        if not len(rows):
            continue
        count = n[rows]
        row = np.repeat(rows, count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        wide = np.zeros((len(row), 8), np.uint8)
        wide[:, :BYTES] = raw[first[row] + step]
        # sorted by a mixture, compared by all bits of both hashes
        part = wide.view(np.uint64).ravel()
        key = W.mix(part) ^ bucket[row]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[:-1] |= same
        again[1:] |= same
        order = order[again]
        if not len(order):
            continue
        d, s, at, part = doc[row[order]], (start[row] + step)[order], bucket[row[order]], part[order]
        order = np.lexsort((s, d, part, at))
        d, s, at, part = d[order], s[order], at[order], part[order]
        heads = _runs(np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])))
        source = np.repeat(heads, np.diff(np.append(heads, len(part))))
        later = np.flatnonzero((d != d[source]) | (s != s[source]))
        paths = _paths(d[later], s[later], d[source[later]], s[source[later]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t.type) for x, t in zip(paths, schema, strict=True)], schema=schema
        )


def repeated_spans(docs: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of words that occur earlier: ``doc``, ``start``, ``n`` words, ``src_doc``, ``src_start``."""
    m = max(1, k * 2 // 5)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    edges = rows.mapInArrow(lambda batches: _edges(batches, k, m), ROW)
    paths = edges.repartition("bucket").mapInArrow(_sources, PATH)
    order = Window.partitionBy("doc").orderBy("start", "n", "src_doc", "src_start")
    glued = (
        (F.lag("doc").over(order).isNotNull())
        & (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start"))
        & (F.lag("src_doc").over(order) == F.col("src_doc"))
        & (F.lag(F.col("src_start") + F.col("n")).over(order) == F.col("src_start"))
    )
    heads = paths.withColumn("_head", F.when(glued, 0).otherwise(1))
    spans = heads.withColumn("_span", F.sum("_head").over(order)).groupBy("doc", "_span").agg(
        F.min("start").alias("start"),
        (F.sum("n") + (k - 1)).cast("int").alias("n"),
        F.first("src_doc").alias("src_doc"),
        F.min("src_start").alias("src_start"),
    )
    return spans.drop("_span")


def _cut(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        columns = (batch.column("_text").to_pylist(), batch.column("_spans").to_pylist())
        for text, spans in zip(*columns, strict=True):
            found = (text or "").encode().split()
            total.append(len(found))
            if spans:
                keep = np.ones(len(found), bool)
                for s in spans:
                    keep[s["start"] : s["start"] + s["n"]] = False
                removed.append(int(len(found) - keep.sum()))
                found = [w for w, k in zip(found, keep.tolist(), strict=True) if k]
            else:
                removed.append(0)
            kept.append(b" ".join(found).decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(total, pa.int64()),
             pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=[*names, "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but ``text``, and ``n_words``, ``n_removed``, ``kept``: what is left, by single spaces."""
    spans = repeated_spans(docs, k, key, text).groupBy("doc").agg(
        F.collect_list(F.struct("start", "n")).alias("_spans")
    )
    names = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept")]
    rows = docs.select(
        *names, F.col(text).cast("string").alias("_text"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"),
    )
    joined = rows.join(spans, "doc", "left").select(*names, "_text", "_spans")
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(lambda batches: _cut(batches, names), schema)
