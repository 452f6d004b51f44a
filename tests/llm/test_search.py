"""Ranked search against plain Python, and the defined cases."""

import math
import random
import re
from collections import Counter

import veilspark.llm.search as module
from veilspark.llm.search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    N, L = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for no, (doc, c) in enumerate(counted):
            m = 25 + 75 * sum(c.values()) * N // L
            s = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w in terms(text) if w in c
            )
            if s > 0:
                scores.append((-s, doc is None, doc if doc is not None else 0, no, doc))
        for rank, (s, _, _, _, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, doc, -s))
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, parts=1):
    d = spark.createDataFrame(
        [(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item_id string, row int, score int"
    ).repartition(parts)
    i = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    out = search(d, i, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(rng, n, vocabulary):
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(n)]


def test_random_corpus_with_rounds(spark, monkeypatch):
    """Small rounds, so that items close at different times and survivors are completed."""
    monkeypatch.setattr(module, "FIRST_POSTINGS", 4)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = corpus(rng, 400, vocabulary)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(20)]
    items += [(100 + i, docs[i * 7][1]) for i in range(10)]  # items with exact copies
    docs += [(1000 + i, docs[21][1]) for i in range(40)]  # and a large group of copies
    completed = []
    inner = module._completed

    def watched(ended, plan, *rest):
        completed.append((ended.count(), plan.join(ended, "q").where("place > done").count()))
        return inner(ended, plan, *rest)

    monkeypatch.setattr(module, "_completed", watched)
    assert run(spark, docs, items) == brute(docs, items)
    made, left = completed[0]
    assert left > 0  # some terms made no accumulators
    pairs = sum(len({w for w in terms(t)} & set(terms(d))) > 0 for _, t in items for _, d in docs)
    assert made < pairs / 2


def test_frequent_term_is_dealt_over_keys(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARES", 8)
    docs = [(i, f"the the a{i % 7} b{i % 11}") for i in range(200)] + [(500, "rare the")]
    items = [(1, "the rare a1"), (2, "the"), (3, "a1 b1 a1 the")]
    assert run(spark, docs, items, parts=3) == brute(docs, items)


def test_ties_by_id_and_characters(spark):
    docs = [(9, "Äb Äb cd"), (3, "Äb äb cd"), (5, "cd, Äb; Äb"), (4, "x-y Zé9 zé9"), (8, "日本 語"), (7, "it's"), (6, "_a_b_")]
    items = [(1, "cd Äb"), (2, "äb"), (3, "x y ZÉ9 Zé9"), (4, "語 日本"), (5, "S it"), (6, "A b `c`")]
    assert run(spark, docs, items, 2) == brute(docs, items, 2)
    assert [r[2] for r in run(spark, docs, items, 2) if r[0] == 1] == [5, 9]


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, " .,- "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "two three"), (6, "zz")]
    items = [(1, "one"), (1, "one"), (None, "two"), (2, None), (3, ""), (4, "absent"), (5, "one one two absent")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, None)], items) == []
    assert run(spark, [(1, "everywhere")], [(1, "everywhere")]) == brute([(1, "everywhere")], [(1, "everywhere")])


def test_long_texts(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = corpus(rng, 30, vocabulary) + [(100, " ".join(rng.choices(vocabulary, k=200_000)))]
    items = [(1, docs[3][1]), (2, " ".join(vocabulary))]
    assert run(spark, docs, items) == brute(docs, items)
