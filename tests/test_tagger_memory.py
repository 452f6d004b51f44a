"""What the tagger's Python worker holds: one Arrow batch at a time."""

import pyarrow as pa

from veilspark.operators.lexical import load_lexical
from veilspark.operators.tagging import token_tagger


def test_a_batch_is_gone_before_the_next_is_read():
    tag = token_tagger(load_lexical).func
    held = []

    def batch():
        return pa.array([["plain words " * 12] * 20] * 1000)

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes())
            yield batch()

    rows = 0
    for out in tag(batches()):
        rows += len(out)
        del out
    assert rows == 3000
    size = batch().nbytes
    assert max(held[1:]) - held[0] < size // 2, (held, size)
