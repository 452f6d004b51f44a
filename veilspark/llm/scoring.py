"""LM scoring: word pairs over a hashed maximum-entropy model with a class-factored softmax.

P0(word | history) = P(class | history) * P(word | class) is the class model, of a fixed size.
Over it stand the counts of real words, in a table that grows with the training tokens:

    P1 = (count(word two before, word) + m * P0) / (count(word two before) + m)
    P  = (count(word before, word) + m * P1) / (count(word before) + m)

with m = ``SPREAD`` * count ** ``GROWTH`` + 1 of the respective history, so that each sums to
what P0 sums to.  The first two tokens of a text have no word two before and take P0 for P1;
before the first stands the start.  Split into P(class | history) and P(word | class, history)
by sums over the words of a class, the product is the same, so counts per class need not be kept.
These counts are ratios, not weights found by gradient updates; only the class model is fitted.

* The 64 most frequent tokens are classes of their own; all other words fall into 64 classes
  by a hash of their last two bytes.  Within a class a word has its share of the counts, plus
  one each and one more for all unseen words, so probabilities sum to one.
* P(class | history) is a softmax over features of the two words before: a bias, the class of
  the word before (n-gram), the coarse class of the word before that (skip), and both hashed
  to 1,024 features.

Features of the class model depend on the history only through its two classes, so the counts
of (history, class) over the training texts are sufficient: Spark sums them over all documents
once, and every gradient update is a pass over that table, of a size fixed by the numbers above.

Documents are packed into blocks of some megabytes: distinct words as 64-bit hashes and each
token as its number among them.  Blocks are written once; counts, statistics and scores read
them as numpy arrays.  Only distinct words of a block are shuffled, to be counted and to bring
their counts back, so a word in every document makes one row per block.  Pairs of words are
counted under 64-bit hashes: a block sends the sorted hashes of its distinct pairs, packed as
differences, to as many buckets of hashes as a shuffle has parts, and gets back what all blocks
have of them, in the same order.  A pair in every block is an entry per block among others.  This
goes over the blocks once for every range of hashes, so that what is on disk at a time is that
of one range.

Defined cases: a null text is empty and has its end as the only token; a null id counts as
training text; rows are independent, repeated ones count and score alike; without training
texts every token is unknown, the base score is 0 and the model is even; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .base import release, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 5 << 20
RANGES = 3  # of pair hashes, one after another
HEADS = TAILS = 64
CLASSES = HEADS + TAILS
BEFORE = CLASSES + 1  # and the start of a text
COARSE = 33
HISTORIES = BEFORE * COARSE
HASHED = 1024
END_HASH = W.mix(np.array([0x1234567], np.uint64), 77)[0]
START_HASH = W.mix(np.array([0x7654321], np.uint64), 78)[0]
SPREAD, GROWTH = 2.0, 0.75  # weight of the shorter history against a count
_TAIL_OF = np.array([zlib.crc32(bytes((i >> 8, i & 255))) % TAILS for i in range(1 << 16)], np.uint8)
# the start of a text is a class of its own, 16 frequent tokens are, the others share
_COARSE_OF = np.array([min(i // 4, 15) if i < HEADS else 16 + (i - HEADS) // 4 for i in range(CLASSES)] + [32])
_FEATURES = np.array([
    (0, 1 + b, 1 + BEFORE + s, 1 + BEFORE + COARSE + zlib.crc32(b"%d|%d" % (b, s)) % HASHED)
    for b in range(BEFORE) for s in range(COARSE)
])
_FIRST = np.array([i * (1 << 64) // RANGES for i in range(RANGES)], np.uint64)  # hashes of each range
_LAST = np.array([(i + 1) * (1 << 64) // RANGES - 1 for i in range(RANGES)], np.uint64)
N_FEATURES = 1 + BEFORE + COARSE + HASHED
BLOCK = (
    "block long, ids array<long>, held array<boolean>, sizes array<int>, words array<long>, "
    "tails binary, trained array<int>, codes binary"
)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for batch, texts in W.slices(batches, limit=BLOCK_BYTES):
        words = W.split_words(texts, lower=True)
        n = words.counts()
        size = n + 1
        ends = np.cumsum(size) - 1
        h = np.empty(int(size.sum()), np.uint64)
        spot = np.arange(len(words.starts)) + words.documents()
        h[spot], h[ends] = words.hashes, END_HASH
        last = np.zeros(len(h), np.int64)
        tip = words.data[words.ends - 1].astype(np.int64) if len(words.ends) else np.zeros(0, np.int64)
        before = np.where(words.ends - 2 >= words.starts, words.data[np.maximum(words.ends - 2, 0)] if len(words.ends) else 0, 0)
        last[spot] = before.astype(np.int64) << 8 | tip
        distinct, first, codes = np.unique(h, return_index=True, return_inverse=True)
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        trained = np.bincount(codes[np.repeat(~held, size)], minlength=len(distinct))
        one = lambda x, t: pa.array([x], pa.list_(t))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(batch.column("doc_id").to_pylist(), pa.int64()), one(held.tolist(), pa.bool_()),
             one(size.astype(np.int32), pa.int32()), one(distinct.view(np.int64), pa.int64()),
             pa.array([_TAIL_OF[last[first]].tobytes()], pa.binary()), one(trained.astype(np.int32), pa.int32()),
             pa.array([pa.compress(codes.astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary())],
            names=["block", "ids", "held", "sizes", "words", "tails", "trained", "codes"],
        )
        number += 1


class _Block:
    """One row of the written blocks as arrays."""

    def __init__(self, batch: pa.RecordBatch, k: int, heads: np.ndarray | None):
        """Without ``heads``, no classes: words and their pairs only."""
        take = lambda name, t: batch.column(name)[k].values.to_numpy(zero_copy_only=False).astype(t)
        self.held, self.sizes = take("held", bool), take("sizes", np.int64)
        self.words = words = np.ascontiguousarray(take("words", np.int64)).view(np.uint64)
        total = int(self.sizes.sum())
        raw = pa.decompress(batch.column("codes")[k].as_py(), total * 4, "zstd", asbytes=True)
        self.codes = np.frombuffer(raw, np.int32)
        self.docs = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = first = np.cumsum(self.sizes) - self.sizes
        if heads is None:
            return
        order = np.argsort(heads)
        at = np.searchsorted(heads[order], words)
        at[at == len(heads)] = 0
        tails = np.frombuffer(batch.column("tails")[k].as_py(), np.uint8).astype(np.int64)
        self.of_word = HEADS + tails
        if len(heads):
            is_head = heads[order][at] == words
            self.of_word = np.where(is_head, order[at], self.of_word)
        self.classes = self.of_word[self.codes]
        one = np.empty(total, np.int64)
        one[1:] = self.classes[:-1]
        one[first] = CLASSES
        two = np.empty(total, np.int64)
        two[2:] = self.classes[:-2]
        two[first] = CLASSES
        second = first[self.sizes > 1] + 1
        two[second] = CLASSES
        self.histories = one * COARSE + _COARSE_OF[two]

    def _pair_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each token with the word before; then, of the tokens with two before (their
        places are the second array), with the word two before; then of that word itself."""
        h = self.words[self.codes]
        place = np.arange(len(h)) - self.first[self.docs]
        far = np.flatnonzero(place > 1)
        salted = W.mix(self.words, 6), W.mix(self.words, 8), W.mix(self.words, 10)
        ahead = np.empty_like(h)
        ahead[1:] = salted[0][self.codes[:-1]]
        ahead[self.first] = W.mix(np.array([START_HASH], np.uint64), 6)[0]
        two = self.codes[far - 2]
        return np.concatenate((W.mix(ahead + h, 7), W.mix(salted[1][two] + h[far], 9), salted[2][two])), far

    def pairs_in(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs with a hash in the range ``part``, sorted, and their training counts."""
        keys, far = self._pair_keys()
        use = ~self.held[self.docs]
        use = np.concatenate((use, use[far], use[far]))
        here = (keys >= _FIRST[part]) & (keys <= _LAST[part])
        distinct, at = np.unique(keys[here], return_inverse=True)
        return distinct, np.bincount(at[use[here]], minlength=len(distinct))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as hashes, and of each token its number among them: with the word
        before, with the word two before, and of that word itself.  The last two are -1 where
        there is no such word."""
        keys, far = self._pair_keys()
        n = len(self.codes)
        distinct, at = np.unique(keys, return_inverse=True)
        skip, alone = np.full(n, -1), np.full(n, -1)
        skip[far], alone[far] = at[n : n + len(far)], at[n + len(far) :]
        return distinct, at[:n], skip, alone


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte of equal weight, so that the high ones vanish."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpack_keys(value: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(value, n * 8, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpack_counts(value: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(value, n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").ravel()


def _pairs(batches: Iterator[pa.RecordBatch], part: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per block and bucket of hashes in a range: its distinct pairs and training counts."""
    low, high = int(_FIRST[part]), int(_LAST[part])
    edges = np.array([low + (high - low) * i // buckets for i in range(1, buckets)], np.uint64)
    for batch in batches:
        for k in range(batch.num_rows):
            keys, trained = _Block(batch, k, None).pairs_in(part)
            bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            full = [i for i in range(buckets) if bounds[i] < bounds[i + 1]]
            cut = [slice(bounds[i], bounds[i + 1]) for i in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part * buckets + i for i in full], pa.int32()),
                 pa.array([batch.column("block")[k].as_py()] * len(full), pa.int64()),
                 pa.array([c.stop - c.start for c in cut], pa.int32()),
                 pa.array([_pack_keys(keys[c]) for c in cut], pa.binary()),
                 pa.array([_pack_counts(trained[c]) for c in cut], pa.binary())],
                names=["bucket", "block", "n", "keys", "counts"],
            )


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the counts of all blocks, in the order of their keys.

    A task holds the packed rows of its buckets and, bucket by bucket, their keys.
    """
    rows: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *row in zip(*(batch.column(n).to_pylist() for n in ("bucket", "block", "n", "keys", "counts")), strict=True):
            rows.setdefault(bucket, []).append(row)
    for bucket in list(rows):
        here = rows.pop(bucket)
        sizes = [n for _, n, _, _ in here]
        distinct, at = np.unique(np.concatenate([_unpack_keys(k, n) for _, n, k, _ in here]), return_inverse=True)
        counts = np.concatenate([_unpack_counts(c, n) for _, n, _, c in here])
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, at, counts)
        each = np.split(totals[at], np.cumsum(sizes)[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in here], pa.int64()), pa.array([bucket] * len(here), pa.int32()),
             pa.array(sizes, pa.int32()), pa.array([_pack_counts(t) for t in each], pa.binary())],
            names=["block", "bucket", "n", "totals"],
        )


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """Per block, in order of its distinct pairs: ``found``, packed training counts over all blocks."""
    spark = blocks.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = blocks.select("block", "held", "sizes", "words", "codes")
    found = None
    for part in range(RANGES):
        rows = words.mapInArrow(
            lambda b, part=part: _pairs(b, part, buckets), "bucket int, block long, n int, keys binary, counts binary"
        )
        totals = rows.repartition("bucket").mapInArrow(_total, "block long, bucket int, n int, totals binary")
        one = staged(totals, "lm-pairs")
        release(spark)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "totals"))).alias("found"))


def _count(batches: Iterator[pa.RecordBatch], heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each class follows each history in the training texts, one row per history."""
    total = np.zeros((HISTORIES, CLASSES), np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            block = _Block(batch, k, heads)
            use = ~block.held[block.docs]
            cell = block.histories[use] * CLASSES + block.classes[use]
            total += np.bincount(cell, minlength=total.size).reshape(total.shape)
    seen = np.flatnonzero(total.any(axis=1))
    if len(seen):
        rows = total[seen]
        packed = [pa.compress(r.tobytes(), "zstd", asbytes=True) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(packed, pa.binary())], names=["history", "counts"])


def _row(value: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(value, CLASSES * 8, "zstd", asbytes=True), np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[h] = total[h] + _row(c) if h in total else _row(c)
    if total:
        packed = [pa.compress(c.tobytes(), "zstd", asbytes=True) for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["history", "counts"])


def log_softmax(weights: np.ndarray, histories: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Natural logarithm of P(class | history), a row per history."""
    logits = weights[_FEATURES[histories]].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def fit_weights(table: DataFrame, class_counts: np.ndarray, updates: int = 16, prior: float = 5.0) -> np.ndarray:
    """Weights of the class model; ``table``: ``history`` and packed ``counts``.

    Each update gathers, per feature and class, how often it was seen and how often the model
    expects it.  That difference, less ``prior`` times the weight, is the gradient of the
    penalised likelihood; over the expectation it is the step, halved, as four features share
    a history.
    """
    weights = np.zeros((N_FEATURES, CLASSES))
    weights[0] = np.log(np.maximum(class_counts, 0.5) / max(1.0, class_counts.sum()))

    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, expected = np.zeros_like(weights), np.zeros_like(weights)
        for batch in batches:
            histories = batch.column(0).to_numpy().astype(np.int64)
            if len(histories):
                counts = np.stack([_row(c) for c in batch.column(1).to_pylist()]).astype(float)
                model = np.exp(log_softmax(weights, histories)) * counts.sum(axis=1, keepdims=True)
                for f in _FEATURES[histories].T:
                    np.add.at(seen, f, counts)
                    np.add.at(expected, f, model)
        both = np.stack((seen, expected)).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(both.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["part"])

    parts = table.repartition(4)  # HISTORIES rows at most, however large the corpus
    for _ in range(updates):
        seen, expected = np.zeros_like(weights), np.zeros_like(weights)
        for r in parts.mapInArrow(gradient, "part binary").collect():  # four rows of a fixed size
            raw = pa.decompress(bytes(r["part"]), weights.size * 16, "zstd", asbytes=True)
            both = np.frombuffer(raw, np.float64).reshape(2, *weights.shape)
            seen, expected = seen + both[0], expected + both[1]
        step = (seen - expected - prior * weights) / (expected + prior)
        weights = weights + np.clip(step, -2.0, 2.0) / 2
    return weights


def score_documents(docs: DataFrame, held: str = "crc32(cast(doc_id as string)) % 7 = 2") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Scores are logarithms to base 10 of the probability of the whole text with its end: of
    single tokens by add-one counts (base), and by the model.  Texts for which ``held`` is
    true are not learned from.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held), F.lit(False)).alias("held"),
        F.col("text").cast("string").alias("text"),
    )
    blocks = staged(rows.mapInArrow(_pack, BLOCK), "lm-blocks")
    entries = blocks.select(
        "block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w"), "tails"
    ).select("block", "at", "w.words", "w.trained", F.substring("tails", F.col("at") + 1, F.lit(1)).alias("tail"))
    counts = staged(
        entries.groupBy("words").agg(F.sum("trained").alias("c"), F.first("tail").alias("tail")).where("c > 0"), "lm-counts"
    )
    top = counts.orderBy(F.desc("c"), "words").limit(HEADS).collect()
    heads = np.array([r["words"] for r in top], np.int64).view(np.uint64)
    in_head = F.col("words").isin([r["words"] for r in top]) if top else F.lit(False)
    mass = counts.groupBy(F.when(~in_head, F.hex("tail")).alias("tail")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")
    ).collect()  # a row per class
    n, v = sum(r["c"] for r in mass), sum(r["v"] for r in mass)
    classes, seen = np.ones(CLASSES), np.zeros(CLASSES)  # one for the unseen words of each tail
    seen[: len(top)] = [r["c"] for r in top]
    for r in mass:
        if r["tail"] is not None:
            tail = HEADS + int(r["tail"], 16)
            classes[tail] += r["c"] + r["v"]
            seen[tail] = r["c"]
    table = blocks.mapInArrow(lambda b: _count(b, heads), "history int, counts binary")
    table = staged(table.repartition("history").mapInArrow(_add, "history int, counts binary"), "lm-histories")
    release(spark)
    weights = fit_weights(table, seen) if n else np.zeros((N_FEATURES, CLASSES))
    model = spark.sparkContext.broadcast((weights.astype(np.float32), heads, classes))
    known = (
        entries.select("block", "at", "words").join(counts.select("words", "c"), "words")
        .groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("counts"))
    )
    known = staged(known, "lm-known")
    release(spark)
    joined = blocks.drop("trained").join(known, "block", "left").join(_pair_counts(blocks), "block", "left")
    return joined.mapInArrow(
        lambda b: _score(b, model.value, n, v),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _score(batches: Iterator[pa.RecordBatch], model: tuple, n: int, v: int) -> Iterator[pa.RecordBatch]:
    weights, heads, classes = model
    table = None
    for batch in batches:
        if table is None and batch.num_rows:
            table = (log_softmax(weights.astype(float)) / np.log(10)).astype(np.float32)
        for k in range(batch.num_rows):
            block = _Block(batch, k, heads)
            c = np.zeros(len(block.of_word), np.int64)
            found = batch.column("counts")[k].values
            if found is not None:
                c[found.field("at").to_numpy()] = found.field("c").to_numpy()
            inside = np.where(block.of_word < HEADS, 0.0, np.log10((c + 1) / classes[block.of_word]))
            base = np.log10((c + 1) / (n + v + 1))
            docs, codes, many = block.docs, block.codes, len(block.sizes)
            given = table[block.histories, block.classes].astype(float)
            score = _with_pairs(block, batch, k, c, inside[codes] + given)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[k].values, pa.array(block.held), pa.array(block.sizes),
                 pa.array(np.bincount(docs, c[codes] > 0, minlength=many).astype(np.int64)),
                 pa.array(np.full(many, n, np.int64)),
                 pa.array(np.bincount(docs, base[codes], minlength=many)),
                 pa.array(np.bincount(docs, score, minlength=many))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def _with_pairs(block: _Block, batch: pa.RecordBatch, k: int, c: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Logarithms of P of each token, from those of P0 (``given``) and the counts of words and pairs."""
    _, with_one, with_two, alone = block.pairs()
    found = [_unpack_counts(f["totals"], f["n"]) for f in batch.column("found")[k].as_py()]
    pairs = np.concatenate(found)
    p = 10**given
    far = with_two >= 0
    p[far] = _mixed(pairs[with_two[far]], pairs[alone[far]], p[far])
    of_one = np.empty(len(p), np.int64)  # a word is before as often as it is there, the start as often as the end
    of_one[1:] = c[block.codes[:-1]]
    of_one[block.first] = c[block.codes[block.first + block.sizes - 1]]
    return np.log10(_mixed(pairs[with_one], of_one, p))


def _mixed(both: np.ndarray, alone: np.ndarray, p: np.ndarray) -> np.ndarray:
    m = SPREAD * alone**GROWTH + 1
    return (both + m * p) / (alone + m)
