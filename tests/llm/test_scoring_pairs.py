"""Scores use pairs of real words, whatever their frequency."""

import itertools
import random

from veilspark.llm import scoring
from veilspark.llm.scoring import score_documents


def test_rare_pairs_count(spark):
    # all words end alike and are equally frequent, so only pairs tell the orders apart
    r = random.Random(1)
    texts = []
    for _ in range(12):
        pairs = [f"a{i}zz b{i}zz c{i}zz" for i in range(300)]
        r.shuffle(pairs)
        texts.append(" ".join(pairs))
    usual = " ".join(f"a{i}zz b{i}zz c{i}zz" for i in range(100, 300))
    mixed = " ".join(f"a{i}zz b{(i * 7) % 200 + 100}zz c{(i * 11) % 200 + 100}zz" for i in range(100, 300))
    skips = " ".join(f"a{i}zz b{(i * 7) % 200 + 100}zz c{i}zz" for i in range(100, 300))
    docs = spark.createDataFrame(list(enumerate([*texts, usual, mixed, skips])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in score_documents(docs, "doc_id >= 12").collect()}
    assert abs(got[12].base_score - got[13].base_score) < 1e-6 and abs(got[12].base_score - got[14].base_score) < 1e-6
    assert got[12].score > 0.6 * got[13].score
    assert got[14].score > got[13].score + 10


def test_blocks_do_not_matter(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.score for r in score_documents(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in score_documents(docs.repartition(7)).collect()}
    assert all(abs(one[d] - many[d]) < 1e-3 for d in one) and len(one) == 80


def test_sums_to_one(spark):
    """All texts of up to two words, and the unseen rest, have a probability of one at most."""
    words = [f"w{i}" for i in range(12)]
    train = [(i, f"w{i} w{(i * 5) % 12} w{i}") for i in range(12)]
    every = [" ".join(t) for n in range(3) for t in itertools.product(words, repeat=n)]
    docs = spark.createDataFrame(train + [(100 + i, t) for i, t in enumerate(every)], "doc_id long, text string")
    total = sum(10**r.score for r in score_documents(docs, "doc_id >= 100").where("held_out").collect())
    assert 0.02 < total <= 1.0 and scoring.GROWTH < 1
