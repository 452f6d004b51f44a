"""Line dedup, decontamination, mixing, scoring and the pipeline: brute force and planted cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from veilspark.llm import queries
from veilspark.llm.decontaminate import contaminated, remove_contaminated, tiles
from veilspark.llm.lines import remove_repeated_lines, word_distance
from veilspark.llm.mixing import TARGETS, fit_mixture, rate_table, with_rates
from veilspark.llm.scoring import score_documents

DATA = "/root/testdata/sf0.01"


def texts_of(spark, root=DATA):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}


def split(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def brute_lines(texts, least=5):
    """Removed lines: an equal one earlier, or an earlier distinct one within one edit, if both
    have ``least`` words."""
    first = {}
    places = [(d, i, tuple(split(x))) for d in sorted(texts) for i, x in enumerate((texts[d] or "").split("\n"))]
    for d, i, w in places:
        if w:
            first.setdefault(w, (d, i))
    by_gap = {}
    long = [w for w in first if len(w) >= least]
    for w in long:
        for k in range(len(w)):
            by_gap.setdefault((w[:k], w[k + 1 :]), []).append(w)
    near = {w: set() for w in first}
    for group in by_gap.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    for w in long:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            if shorter in first and len(shorter) >= least:
                near[w].add(shorter)
                near[shorter].add(w)
    gone = {w for w in first if any(first[v] < first[w] for v in near[w])}
    out = {d: [] for d in texts}
    for d, i, w in places:
        if w in gone or (w in first and first[w] != (d, i)):
            out[d].append(i)
    return out


def check_lines(texts, rows):
    gone = brute_lines(texts)
    for d, text, n in rows:
        keep = None if texts[d] is None else "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in set(gone[d]))
        assert (text, n) == (keep, len(gone[d])), d


def test_line_query(spark):
    check_lines(texts_of(spark), [tuple(r) for r in queries.op1_lines(spark, DATA).collect()])


def test_lines_planted(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(50)}" for _ in range(r.randrange(3, 14))] for _ in range(30)]
    texts = {0: None, 1: "", 2: "\n\n", 3: "a b c d e", 4: "A  b c\td e\na b c d x", 5: "a b c d", 6: "x " * 3000}
    for d in range(10, 90):
        lines = []
        for _ in range(4):
            w = list(r.choice(base))
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + ["new"] + w[k:], w[:k] + [f"w{r.randrange(50)}"] + w[k + 1 :]]) or ["q"]
            lines.append(" ".join(w))
        texts[d] = "\n".join(lines)
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in texts.items()], "doc_id long, text string, doc int, line string").repartition(3)
    out = remove_repeated_lines(df)
    assert out.columns == [*df.columns, "_lines_removed"]
    check_lines(texts, [(x.doc_id, x.text, x._lines_removed) for x in out.collect()])
    short = {1: "All rights reserved.", 2: "x\nall  rights RESERVED.\nall rights reserved", 3: "x y\n日本語。", 4: "日本語。\nx\n \n"}
    out = remove_repeated_lines(spark.createDataFrame(list(short.items()), "doc_id long, text string")).collect()
    check_lines(short, [(x.doc_id, x.text, x._lines_removed) for x in out])
    assert {x.doc_id: x.text for x in out} == {1: short[1], 2: "x\nall rights reserved", 3: short[3], 4: " \n"}
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d f")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x._lines_removed) for x in remove_repeated_lines(twice).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert remove_repeated_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,d", [("abcde", "abcde", 0), ("abcde", "abxde", 1), ("abcde", "abde", 1), ("abcde", "xabcd", 2), ("abcde", "badce", 2), ("a", "abcd", 2), ("abcdef", "bcdef", 1)])
def test_word_distance(a, b, d):
    assert word_distance(list(a), list(b), 1) == d


def test_tiles():
    item = np.arange(30, dtype=np.uint64)
    moved = np.concatenate((item[20:], [99], item[:10], [98], item[10:20])).astype(np.uint64)
    assert sorted(tiles(item, moved, 5)) == [(0, 11, 10), (10, 22, 10), (20, 0, 10)]
    assert tiles(item, np.array([7, 8, 9, 10], np.uint64), 5) == []
    again = np.concatenate((item[:12], item[6:18])).astype(np.uint64)
    assert sorted(tiles(item, again, 5)) == [(0, 0, 12), (12, 18, 6)]


def test_leak_query_and_planted(spark):
    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    expected = set()
    for d, t in texts_of(spark).items():
        mine = grams(split(t))
        for i, w in items.items():
            hit = set()
            for k in range(len(w) - 4):
                if tuple(w[k : k + 5]) in mine:
                    hit |= set(range(k, k + 5))
            if 2 * len(hit) >= len(w):
                expected.add((d, i))
    got = queries.op2_decontaminate(spark, DATA).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected) > 20
    item = " ".join(f"q{i}" for i in range(24))
    w = item.split()
    rows = [
        (1, " ".join(w[12:] + ["x"] * 3 + w[:12])), (2, " ".join(w[:11])), (3, None), (4, ""), (5, item.upper()),
        (6, " ".join(f"{a} x" for a in w)), (7, "y " * 5000 + item), (None, item), (8, " ".join(w[:4] + ["z"] + w[5:9] + ["z"] + w[10:14])),
    ]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "q1 q2")], "item_id long, text string")
    found = contaminated(docs, bench).collect()
    whole = [(d, 4) for d in (0, 1, 2, 5, 7, 8)]  # the item of two words stands there as a whole
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == sorted([(d, i) for d in (0, 1, 5, 7) for i in (1, 2)] + whole)
    assert all(len(r.tiles) == 2 for r in found if r.doc_id == 1 and r.item_id != 4)
    assert all((r.covered, r.coverage) == (2, 1.0) for r in found if r.item_id == 4)
    assert sorted(r.doc_id for r in remove_contaminated(docs, bench).collect()) == [3, 4, 6]
    assert contaminated(docs, bench, filter_bits=15).count() == 14
    few = spark.createDataFrame([(1, "two plus two answer"), (2, "four"), (3, "five words are a seed")], "item_id long, text string")
    texts = ["so Two plus  two\nanswer it", "two plus two", "fourteen", "is four.", "is four", "five words are a seed", "words are a seed"]
    docs_of = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs_of, few).collect()) == [(0, 1), (4, 2), (5, 3)]
    assert contaminated(docs.limit(0), bench).count() == 0 == contaminated(docs, bench.limit(0)).count()


def test_mixing(spark):
    rows = queries.op3_mixing(spark, DATA).toPandas()
    texts = texts_of(spark)
    assert {r.doc_id: r.n_tokens for r in rows.itertuples()} == {d: len(split(t)) for d, t in texts.items()}
    total = rows.n_tokens.sum()
    for d, share in TARGETS.items():
        assert abs((rows.n_tokens * rows.rate * rows[f"p_{d}"]).sum() / total - share) < 1e-4
    assert (rows.rate >= 0).all() and np.allclose(rows[[f"p_{d}" for d in TARGETS]].sum(axis=1), 1)
    label = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    right = [(r.p_poor > 0.5) == (label[r.doc_id].quality == 0) for r in rows.itertuples() if r.doc_id in label]
    assert sum(right) > 0.9 * len(right)


def test_mixing_edges(spark):
    docs = spark.createDataFrame(
        [(i, t, 5.0) for i, t in enumerate(["good word " * 30] * 5 + ["vile word " * 30] * 5 + [None, "", "good " * 40_000])] + [(None, "good", 5.0)],
        "doc_id long, text string, rate double",
    )
    labels = spark.createDataFrame([(i, 1, int(i >= 5)) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model, found = fit_mixture(docs, labels, {"good": 0.999, "toxic": 0.001})
    out = {r.doc_id: r for r in with_rates(docs, model).collect()}
    assert docs.columns + ["copies"] == with_rates(docs, model).columns and len(out) == 14
    assert out[5].rate < 0.2 and out[0].rate > 0.9 and out[10].rate >= 0
    assert {r.doc_id: r.rate for r in rate_table(found, model).collect()} == {d: r.rate for d, r in out.items()}
    none, found = fit_mixture(docs, labels.limit(0))
    assert rate_table(found, none).count() == 14
    empty, found = fit_mixture(docs.limit(0), labels)
    assert found.count() == 0 and with_rates(docs.limit(0), empty).count() == 0


def check_scores(texts, got, held):
    train = Counter(w for d, t in texts.items() if not held(d) for w in [*split(t), None])
    n, v = sum(train.values()), len(train)
    for r in got:
        tokens = [*split(texts[r.doc_id]), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(tokens), n)
        assert r.n_known == sum(train[w] > 0 for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_scoring_query(spark):
    got = queries.op5_scoring(spark, DATA).collect()
    check_scores(texts_of(spark), got, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    assert len(got) == 1000
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scoring_held_out_gain(spark):
    got = queries.op5_scoring(spark, "/root/testdata/sf0.1").where("held_out").groupBy().sum("base_score", "score").first()
    assert got[1] > 0.97 * got[0]


def test_scoring_edges(spark):
    texts = {1: None, 2: "", 3: "a b a", 4: "A\tb \n", 5: "zz " * 300_000, 6: "a b a"}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n_tokens int")
    check_scores(texts, score_documents(df, "doc_id = 6").collect(), lambda d: d == 6)
    for r in score_documents(df.where("doc_id < 4"), "true").collect():
        assert (r.base_score, r.train_tokens, r.n_known) == (0.0, 0, 0)
    assert score_documents(df.limit(0)).count() == 0
    # every word has its share: the probabilities of all one-word texts and of no word sum to less than one
    words = [f"w{i}" for i in range(300)]
    small = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(1000, "")], "doc_id long, text string")
    got = score_documents(small, "false").collect()
    assert 0.3 < sum(10**r.score for r in got) <= 1.0


def test_pipeline(spark):
    before = texts_of(spark)
    out = corpus_pipeline.run(spark, DATA)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "copies"]
    judged = {r.doc_id: r.kept for r in queries.op6_quality(spark, DATA).collect()}
    assert all(judged[d] for d in rows) and len(rows) > 0.7 * len(before)
    kept = {d: before[d] for d in before if judged[d]}
    gone = brute_lines(kept)
    left = {d: "\n".join(x for i, x in enumerate(kept[d].split("\n")) if i not in set(gone[d])) for d in kept}
    left = {d: t for d, t in left.items() if t.split() or not gone[d]}  # nothing of its own: gone as a whole
    assert len(left) < len(kept)
    from test_substrings_ngrams import brute_components

    component = brute_components(left, 5, Fraction(4, 5))
    single = {d for d in left if component[d][1] == d}
    items = [split(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = set()
    for d in single:
        w = split(left[d])
        mine = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item in items:
            hit = {p for k in range(len(item) - 4) if tuple(item[k : k + 5]) in mine for p in range(k, k + 5)}
            if 2 * len(hit) >= len(item):
                break
        else:
            clean.add(d)
    assert set(rows) == clean
    assert all(r.text == left[d] and (r.n_chars == len(r.text) or not gone[d]) for d, r in rows.items())
    names = [re.sub(" .*", "", n) for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line", "n-gram", "benchmark", "mixing"]


def test_pipeline_on_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
