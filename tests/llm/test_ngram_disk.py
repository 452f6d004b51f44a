"""What the n-gram join has on disk: keys in rounds, and not beyond the step that reads them."""

import random
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

from veilspark.llm.ngram_join import SETS, _met, similar_documents
from veilspark.session import checkpoint_root


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def test_keys_go_once_they_are_compared(spark):
    texts = [prose(i, 120) for i in range(6)]
    texts += [texts[0] + " more", texts[1], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = Path(checkpoint_root(spark), "llm")
    before = set(root.glob("*"))
    members, _ = similar_documents(df, 3, Fraction(9, 10))
    left = [f for f in set(root.glob("*")) - before if "keys" in spark.read.parquet(str(f)).columns]
    assert left == []
    got = {r.doc_id: r.component_id for r in members.collect()}
    assert got == {**{i: i for i in range(10)}, 6: 0, 7: 1}


def test_rounds_meet_all_keys(spark):
    r = random.Random(5)
    rows = [
        (d, 9, 0, True, c, 3, [r.randrange(-40, 40) for _ in range(9)], [0])
        for d in [*range(30), 7, None] for c in (0, 1)
    ]
    single = spark.createDataFrame(rows, SETS)
    times = {}
    for row in rows:
        for key in row[6]:
            times[key] = times.get(key, 0) + 1
    wanted = sorted((k, row[0] or 0, row[4], times[k]) for row in rows for k in row[6] if times[k] > 1)
    for rounds in (1, 4, 7):
        got = _met(single, rounds).select("key", F.coalesce("doc_id", F.lit(0)), "class", "often").collect()
        assert sorted(map(tuple, got)) == wanted
