"""Substring dedup and n-gram join: against brute force on whole small tables and planted cases."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from veilspark.llm import queries
from veilspark.llm.components import components
from veilspark.llm.ngram_join import parity, similar_documents
from veilspark.llm.substrings import remove_repeats, repeated_spans

DATA = "/root/testdata/sf0.01"


def brute_removal(texts, k):
    first, out = {}, {}
    for d in sorted(texts):
        w = (texts[d] or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), (d, i)) != (d, i):
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_substrings(spark, DATA).collect()}
    assert got == brute_removal(texts, 20)


def prose(seed, n, vocabulary=40):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def planted():
    passage = prose(1, 60)
    texts = {i: " ".join(prose(i, 50) + passage[i % 7 :] + prose(i + 99, 30)) for i in range(10, 40)}
    texts |= {1: None, 2: "", 3: " ".join(["a"] * 500), 4: "x " * 19, 5: "x " * 20, 6: "x " * 21, 50: texts[10], 51: texts[10]}
    return texts


def test_substrings_planted(spark):
    texts = planted()
    df = spark.createDataFrame([(d, t, "s") for d, t in texts.items()], "doc_id long, text string, kept string")
    out = remove_repeats(df.repartition(3), 20)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()}
    assert got == brute_removal(texts, 20)
    spans = repeated_spans(df, 20).collect()
    assert {s.doc for s in spans} >= {50, 51}
    for s in spans:
        a, b = texts[s.doc].split(), texts[s.src_doc].split()
        assert (s.src_doc, s.src_start) < (s.doc, s.start)
        assert a[s.start : s.start + s.n] == b[s.src_start : s.src_start + s.n] and s.n >= 20
    twice = spark.createDataFrame([(1, texts[10]), (1, texts[10]), (None, "y")], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeats(twice).collect()) == [0, 0, 0]
    assert remove_repeats(df.limit(0)).count() == 0


def grams(text, n):
    w = [bytes(x) for x in (text or "").encode().lower().split()] if (text or "").isascii() else [
        bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in text.encode().split()
    ]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n, t):
    sets = {d: grams(x, n) for d, x in texts.items()}
    posting, overlap = {}, {}
    for d in sorted(sets):
        for g in sets[d]:
            for e in posting.setdefault(g, []):
                overlap[e, d] = overlap.get((e, d), 0) + 1
            posting[g].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), o in overlap.items():
        if o * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - o):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_ngram_join(spark, DATA).collect()}
    assert got == brute_components(texts, 3, Fraction(9, 10))


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_ngrams_planted(spark, n, t):
    r = random.Random(5)
    texts = {1: None, 2: "", 3: "a", 4: "A", 5: "a b", 6: " a\tB ", 7: "a b c", 8: "A b c", 9: "a b c d"}
    d = 10
    for base in range(25):
        words = prose(base, r.choice([4, 8, 20, 40, 63, 66, 70, 100, 300, 1000]), 5000)
        for _ in range(r.randrange(1, 12)):
            copy = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 40)):
                copy[r.randrange(len(copy))] = f"z{r.randrange(10**6)}"
            if r.random() < 0.3:
                copy += prose(r.random(), len(words) // 15 + 1, 5000)
            texts[d] = " ".join(copy)
            d += 1
            if r.random() < 0.3:
                words = copy
    df = spark.createDataFrame([(d, x, 0) for d, x in texts.items()], "doc_id long, text string, n long")
    members, links = similar_documents(df.repartition(3), n, t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute_components(texts, n, t)
    assert links.count() > 10


def test_ngrams_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in similar_documents(df, 3, Fraction(9, 10))[0].collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1)]
    assert similar_documents(df.limit(0))[0].count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for size, most in ((10, 1), (200, 20), (3000, 300)):
        a = rng.integers(0, 2**52, size).astype(np.uint64)
        b = np.concatenate((a[most:], rng.integers(0, 2**52, most).astype(np.uint64)))
        row = np.repeat([0, 1], size)
        x, y = parity(row, np.concatenate((a, b)), 2, most).reshape(2, -1)
        assert 0 < sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))
