"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, no Python loop.

A word is a run of bytes other than ASCII white space.  The hash of a word, and of a run of
words, is a polynomial over its parts modulo 2**64, taken from prefix sums, then mixed.
Arrays are built for slices of a batch, so memory follows the slice and the longest text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 2 << 20
STRETCH_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64((salt * _BASE + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial of ``values[start:end]`` for each span, independent of where it stands."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:], dtype=np.uint64)
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """``first[d]`` is the first word of document ``d``; ``data`` are the bytes of the texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        low = 0
        while low < len(out):  # stretches of a bounded size, or one word
            base = self.starts[low]
            high = max(low + 1, int(np.searchsorted(self.ends, base + STRETCH_BYTES, "right")))
            values = self.data[base : self.ends[high - 1]].astype(np.uint64) + np.uint64(1)
            out[low:high] = span_hashes(values, self.starts[low:high] - base, self.ends[low:high] - base)
            low = high
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def split_words(texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """``texts``: strings without nulls; ``space``: by byte, what stands between words."""
    texts = pc.cast(texts, pa.large_binary())
    _, offsets, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    if lower:
        data = _LOWER[data]
    space = space[data]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[inner] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def strings(words: Words, at: np.ndarray) -> pa.Array:
    """The words at the places ``at``, as strings."""
    size = words.ends[at] - words.starts[at]
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    each = np.arange(offsets[-1]) + np.repeat(words.starts[at] - offsets[:-1], size)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.data[each]))]
    return pa.Array.from_buffers(pa.large_string(), len(at), buffers)


def windows(words: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they lie in one document."""
    h = words.hashes if hashes is None else hashes
    n = max(0, len(h) - k + 1)
    at = np.arange(n)
    docs = words.documents()
    return mix(span_hashes(h, at, at + k), k), docs[:n] == docs[k - 1 :] if n else np.zeros(0, bool)


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, beside: str | None = None
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows whose texts hold about ``limit`` bytes, with the texts, null as empty.

    ``beside`` names a second column of texts whose bytes count as well.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        if beside is not None:
            other = pc.binary_length(batch.column(batch.schema.get_field_index(beside))).fill_null(0)
            sizes = sizes + other.to_numpy(zero_copy_only=False)
        sizes = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            base = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(low, high - low), column.slice(low, high - low)
            low = high


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a column of longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
