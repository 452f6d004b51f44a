"""Chat formatting, quality statistics, WARC: against plain Python on whole small tables."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import queries
from veilspark.llm.base import shared_folder
from veilspark.llm.chat import format_chat, learned_text, read_chat
from veilspark.llm.quality import P, Condition, judge_quality, learn_rules, text_statistics
from veilspark.llm.warc import MARK, read_warc, unchunk, write_warc

DATA = "/root/testdata/sf0.01"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(spark, name, root=DATA):
    return spark.read.parquet(f"{root}/{name}.parquet").collect()


def test_chat_query(spark):
    turns = {-1: [("user", queries.PROBE), ("assistant", queries.PROBE)]}
    for r in sorted(rows_of(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op4_chat(spark, DATA).collect()}
    assert got.keys() == turns.keys()
    for key, said in turns.items():
        learned = "".join(t for role, t in said if role == "assistant")
        assert got[key].n_turns == len(said)
        assert got[key].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in said))
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(learned), sha(learned))


CHATS = {
    1: [("user", "a"), ("user", "b"), ("assistant", "c<|im_sep|>d"), ("assistant", "")],
    2: [("user", None), (None, "x")],
    3: [("odd\nrole<n|", "<\\|im_end|>\n<\\\\|<|"), ("assistant", "é😀\n\n<|im_end|>\n")],
}


def test_chat_round_trip_and_merge(spark):
    data = [(c, i, r, t, "z") for c, said in CHATS.items() for i, (r, t) in enumerate(said)]
    df = spark.createDataFrame(data[::-1], "conv_id long, turn long, role string, text string, formatted string")
    out = format_chat(df).withColumns({"t": read_chat(F.col("formatted")), "l": learned_text(F.col("formatted"), F.col("loss"))})
    got = {r.conv_id: r for r in out.collect()}
    for c, said in CHATS.items():
        assert [(t.role, t.text) for t in got[c].t] == [(r or "", t or "") for r, t in said]
        assert got[c].l == "".join(t or "" for r, t in said if r == "assistant")
    assert got[1].formatted.count("<|im_start|>") == 2
    assert format_chat(df.limit(0)).count() == 0


def statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(hit),
    )


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in rows_of(spark, "documents")}
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    good = Counter()
    for r in queries.op6_quality(spark, DATA).collect():
        expected = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            good[labels[r.doc_id], r.kept] += 1
    assert good[1, True] >= 0.98 * (good[1, True] + good[1, False])
    assert good[0, False] >= 0.7 * (good[0, True] + good[0, False])


def test_quality_edges(spark):
    texts = [None, "", " \t\n", "a " * 40, "x\ny\nx\n \nx", "w" * 5000, " ".join(map(str, range(200)))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in text_statistics(df).collect():
        assert tuple(r[P + n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == statistics(texts[r.doc_id])
        assert r.n_words == 1
    assert judge_quality(df.limit(0), []).count() == 0


def test_learned_rule(spark):
    from veilspark.llm.quality import features

    values = ", ".join(f"double((id * {k + 3}) % 17) AS {n}" for k, n in enumerate(features()) if n != "upper")
    df = spark.sql(f"SELECT id AS doc_id, id % 10 = 0 AS bad, {values}, IF(id % 10 = 0, 0.9, 0.1) AS upper FROM range(600)")
    assert learn_rules(df) == [(Condition("upper", True, 0.9),)]
    assert learn_rules(df.where("bad")) == []


def pages_expected(pages):
    digest = {p: sha((h or "").encode()) for p, h in pages}
    size = {p: len((h or "").encode()) for p, h in pages}
    out = {}
    for p, _ in pages:
        first = min(q for q in digest if digest[q] == digest[p]) if size[p] >= 100 else p
        out[p] = (size[p], digest[p], "response" if first == p else "revisit", None if first == p else first)
    return out


def test_warc_query(spark):
    expected = pages_expected([(r.page_id, r.html) for r in rows_of(spark, "pages")])
    got = queries.op7_warc(spark, DATA).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == expected and len(got) == len(expected)


def test_warc_segments_and_copies(spark):
    long = "".join(chr(33 + i * 7 % 90) for i in range(250_000)) + "é" * 40_000
    trap = ("x" * 50 + MARK + "WARC/1.1\r\n" + "\r\n\r\n") * 3
    pages = [(1, long), (2, long), (3, None), (4, ""), (5, "ab"), (6, "ab"), (7, trap), (8, trap), (9, "a" * 100)]
    df = spark.createDataFrame([(p, f"http://é.example/{p}\r\nX: y", h, "q") for p, h in pages], "page_id long, url string, html string, payload string")
    path = shared_folder(spark, "warc-test")
    write_warc(df, path, segment_bytes=1000)
    got = read_warc(spark, path).collect()
    expected = pages_expected(pages)
    assert len(got) == len(pages) and not any(r.error for r in got)
    for r in got:
        size, digest, kind, refers = expected[r.page_id]
        assert (r.type, r.refers_to, r.digest) == (kind, refers, digest)
        if kind == "response":
            assert sha(bytes(r.payload)) == digest
        else:
            assert r.full_length == size
    lines = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    broken = re.sub(r"(?s)WARC/1\.1\r\nWARC-Type: continuation.{0,120}?/3>.*?(?=WARC/1\.1\r\nWARC-Type)", "", lines, count=1)
    assert broken != lines
    other = shared_folder(spark, "warc-broken")
    spark.createDataFrame([(broken,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(other)
    assert sum(r.error is not None for r in read_warc(spark, other).collect()) == 1
    empty = shared_folder(spark, "warc-empty")
    write_warc(df.limit(0), empty)
    assert read_warc(spark, empty).count() == 0


def test_unchunk():
    assert unchunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunk(b"3\r\nab\r\n0\r\n\r\n")
