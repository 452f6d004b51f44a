"""Edges whose mixed hashes meet but whose hashes differ are not taken for one another."""

import numpy as np
import pyarrow as pa

from veilspark.llm import words as W
from veilspark.llm.substrings import BYTES, _sources


def rows(*found):
    """One row per (bucket, doc, start, edge hash)."""
    bucket, doc, start, edge = zip(*found, strict=True)
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [W.signed(np.array(bucket, np.uint64)), pa.array(doc, pa.int64()), pa.array(start, pa.int32()),
         pa.array([int(e).to_bytes(8, "little")[:BYTES] for e in edge], pa.binary()), pa.nulls(n, pa.int32()),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
        names=["bucket", "doc", "start", "edges", "n", "src_doc", "src_start"],
    )


def spans(*found):
    return sorted(tuple(r.values()) for b in _sources(iter([rows(*found)])) for r in b.to_pylist())


def test_forced_collision():
    a, b = 123, 456
    mixed = W.mix(np.array([a, b], np.uint64))
    bucket = 7
    other = int(np.uint64(bucket) ^ mixed[0] ^ mixed[1])  # (other, b) mixes to what (bucket, a) does
    assert mixed[0] ^ np.uint64(bucket) == mixed[1] ^ np.uint64(other)
    assert spans((bucket, 1, 0, a), (other, 2, 0, b)) == []
    # and true repeats beside them keep their own sources
    assert spans((bucket, 1, 0, a), (other, 2, 5, b), (bucket, 3, 9, a), (other, 4, 1, b)) == [(3, 9, 1, 1, 0), (4, 1, 1, 2, 5)]


def test_neighbours_are_one_path():
    assert spans((1, 1, 0, 10), (1, 1, 1, 11), (1, 5, 7, 10), (1, 5, 8, 11)) == [(5, 7, 2, 1, 0)]
