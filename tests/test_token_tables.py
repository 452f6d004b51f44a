"""Chunks, tokens, words and entities as rows, against the form of arrays."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

import veilspark as v
from veilspark.functions.entities import join_subwords, merge_entities
from veilspark.operators import token_tables as rows
from veilspark.operators.lexical import load_failing, load_lexical
from veilspark.schema import ENTITY, TOKEN, WORD

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = [
    "", " ", None, "Ann Lee", "x" * 150, "Ann Lee " * 40, "a b c " * 25 + "Robinson Stone", "quiet Ann. " * 30,
    "Bob Stone, Maria Gonzales. Ünï Wörd 日本 Alexandria " * 60,
]


def rowset(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("load", [load_lexical, load_failing])
def test_entities_by_chunk_equal_arrays(spark, texts, load):
    df = texts(*TEXTS).withColumn("k", F.when(F.col("id") != 3, F.col("id")))  # one null key
    expected = v.with_entities(df, "text", load)
    got = rows.with_entities_by_chunk(df, "k", load=load, parts=3)
    columns = ("id", "text", "entities", "ml_errors")
    assert rowset(got, *columns) == rowset(expected, *columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_chunks_of_one_text_go_to_many_tasks(spark, texts):
    df = texts("Ann Lee, " * 3000)
    tagged = rows.tag_chunk_rows(rows.chunk_rows(df, "id"), "id", load=load_lexical, parts=4)
    sizes = [r["n"] for r in tagged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < sum(sizes) / 2
    grouped = rows.regroup_chunks(tagged, "id").select("chunks", "tagged").first()
    whole = v.tag_tokens(df, "text", load_lexical).select("chunks", "tagged").first()
    assert grouped == whole


def random_tokens(rng, n):
    tokens, at = [], 0
    for _ in range(n):
        at += rng.choice([0, 1, 2, 3, 9])
        size = rng.randint(1, 6)
        known = rng.random() < 0.8
        word = rng.choice(["", "", "##"]) + "w" * size
        tokens.append((word, rng.choice(["B-PER", "I-CITY", "B-ORG", "I-PER"]), rng.randint(1, 99) / 100, at if known else None, at + size if known else None))
        at += size
    return tokens


def test_words_equal_arrays(spark, monkeypatch):
    monkeypatch.setattr(rows, "CHUNKS_A_BLOCK", 3)
    rng = random.Random(1)
    lists = [(k, random_tokens(rng, rng.randint(0, 60))) for k in range(60)] + [(None, random_tokens(rng, 20)), (99, [("##x", "B-PER", 0.5, 0, 1)] * 3)]
    table = spark.createDataFrame(lists, f"k int, tokens array<{TOKEN.simpleString()}>")
    flat = table.select("k", F.posexplode("tokens").alias("i", "t")).select(
        "k", F.floor(F.col("i") / 4).cast("int").alias("chunk_no"), (F.col("i") % 4).alias("token_no"), "t.*"
    )
    expected = table.select("k", F.posexplode(join_subwords(F.col("tokens"))).alias("word_no", "w")).select("k", "word_no", "w.*")
    got = rows.join_subword_rows(flat, "k")
    assert rowset(got, *expected.columns) == rowset(expected, *expected.columns)
    assert rowset(rows.join_subword_rows(flat.limit(0), "k"), "word") == []


def test_entities_equal_arrays(spark, monkeypatch):
    monkeypatch.setattr(rows, "WORDS_A_BLOCK", 4)
    rng = random.Random(2)
    lists = []
    for k in range(80):
        words, at = [], 0
        for _ in range(rng.randint(0, 40)):
            at += rng.choice([0, 1, 2, 2, 3, 30])
            size = rng.randint(1, 9)
            start = at if rng.random() < 0.9 else None
            end = at + size if rng.random() < 0.95 else None
            words.append(("w", "w" * size, rng.choice(["B-PER", "I-PER", "B-CITY"]), rng.randint(1, 99) / 100, start, end, None))
            at += size
        lists.append((k if k else None, "abcdefghij" * (at // 10 + 1), words))
    table = spark.createDataFrame(lists, f"k int, text string, words array<{WORD.simpleString()}>")
    entities = merge_entities(F.col("words"), F.col("text"))
    expected = table.select("k", F.explode(entities).alias("e")).select("k", "e.*")
    flat = table.select("k", F.posexplode("words").alias("word_no", "w")).select("k", "word_no", "w.*")
    for size, overlap in ((150, 15), (8, 3)):  # short tiles too, so that entities span several
        tiles = rows.tile_rows(rows.chunk_rows(table, "k", size=size, overlap=overlap), "k", size=size, overlap=overlap)
        got = rows.merge_entity_rows(flat, "k", tiles=tiles, size=size, overlap=overlap)
        assert rowset(got, "k", *ENTITY.names) == rowset(expected, "k", *ENTITY.names)
    assert got.where("n_words > 1").count() > 20
    bare = rows.merge_entity_rows(flat, "k")
    assert bare.where("n_words > 1 AND word IS NOT NULL").isEmpty()


def rows_shuffled(df):
    """Rows that the exchanges of the plan have written once ``df`` has run, reused ones once."""

    def walk(node):
        kind, written = node.getClass().getSimpleName(), 0
        if kind == "ReusedExchangeExec":
            return 0
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            written = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        return written + sum(walk(children.apply(i)) for i in range(children.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def words_of(texts):
    """The capitalised words of each text with their places."""
    import re

    return [
        (k, i, m[0], "B-PER", 0.9, m.start(), m.end())
        for k, text in texts for i, m in enumerate(re.finditer("[A-Z][a-z]+", text or ""))
    ]


WORD_ROWS = "k int, word_no int, word string, entity string, score double, start int, end int"


def test_words_and_texts_are_shuffled_once(spark):
    texts = [(k, "Ann Lee went on. " + f"Then came Bob{'b' * k}, who is there. " * 60) for k in range(12)]
    table, words = spark.createDataFrame(texts, "k int, text string"), words_of(texts)
    chunks = rows.chunk_rows(table, "k")
    tiles = rows.tile_rows(chunks, "k")
    got = rows.merge_entity_rows(spark.createDataFrame(words, WORD_ROWS), "k", tiles=tiles)
    shuffled = rows_shuffled(got)
    assert got.where("n_words = 2 AND word = 'Ann Lee'").count() == 12
    assert shuffled < 1.2 * (len(words) + chunks.count())
    assert chunks.count() <= rows_shuffled(tiles) < 1.2 * chunks.count()
    together = rows.merge_entity_rows(spark.createDataFrame(words, WORD_ROWS), "k", tiles=tiles, blocks=False)
    by_text = together.withColumn("no", F.row_number().over(Window.partitionBy("k").orderBy("first_word")))
    assert rows_shuffled(by_text) < 1.2 * (len(words) + chunks.count())
    assert rowset(together, *got.columns) == rowset(got, *got.columns)


def test_entities_over_many_blocks_and_runs(spark, monkeypatch):
    monkeypatch.setattr(rows, "WORDS_A_BLOCK", 4)
    monkeypatch.setattr(rows, "TILES_A_RUN", 2)
    texts = [
        (0, "Ab Cd, " * 30), (1, "Ab Cd, " * 30 + "x y Ef"), (2, "Ab x y Cd"), (3, "Ab"), (None, "y Ab Cd " * 9),
        (4, "Ab y Cd " * 9), (5, None), (6, ""), (7, "Ab Cd Ef x y z " * 9),
    ]
    table, words = spark.createDataFrame(texts, "k int, text string"), words_of(texts)
    words += [(8, 3, "No", "B-PER", 0.9, None, None), (8, 4, "Text", "B-PER", 0.9, 0, 4), (8, 5, "Here", "B-PER", 0.8, 5, 9)]
    flat = spark.createDataFrame(words, WORD_ROWS)
    islands = {}
    for k, no, word, _, score, start, end in words:
        if start is not None and k in islands and start - islands[k][-1][4] <= 2:
            islands[k][-1][1] += 1
            islands[k][-1][4] = end
        elif start is not None:
            islands.setdefault(k, []).append([no, 1, word, start, end])
    of = dict(texts)
    expected = sorted(
        repr((k, no, n, word if n == 1 else of[k][start:end] if k in of else None, start, end))
        for k, found in islands.items() for no, n, word, start, end in found
    )
    for size, overlap in ((150, 15), (8, 3)):
        tiles = rows.tile_rows(rows.chunk_rows(table, "k", size=size, overlap=overlap), "k", size=size, overlap=overlap)
        assert tiles.groupBy("k", "tile").count().where("count > 1").isEmpty()
        for given in (tiles, tiles.select("k", "tile", "text")):
            for blocks in (True, False):
                got = rows.merge_entity_rows(flat, "k", tiles=given, size=size, overlap=overlap, blocks=blocks)
                assert rowset(got, "k", "first_word", "n_words", "word", "start", "end") == expected


def test_whole_pipeline_over_rows(spark, texts, tmp_path):
    """Tokens stored, then words, entities and gates over rows: as the arrays give them."""
    df = texts(*TEXTS)
    tagged = rows.tag_chunk_rows(rows.chunk_rows(df, "id"), "id", load=load_known)
    tagged.write.parquet(str(tmp_path / "tagged"))
    stored = spark.read.parquet(str(tmp_path / "tagged"))
    words = rows.join_subword_rows(rows.token_rows(stored, "id"), "id")
    words = words.withColumn("end", F.coalesce("sub_end", "end"))  # all tokens have places here
    got = rows.keep_entity_rows(rows.merge_entity_rows(words, "id", tiles=rows.tile_rows(stored, "id")))
    expected = v.with_entities(df, "text", load_known).select("id", F.explode("entities").alias("e"))
    expected = expected.select("id", "e.type", F.col("e.value").alias("word"), "e.score", "e.start", "e.end")
    assert rowset(got, *expected.columns) == rowset(expected, *expected.columns)
    assert got.count() > 50


def load_known():
    """Capitalised words, all with their places, long ones in two pieces."""
    import re

    def tag(chunks):
        out = []
        for chunk in chunks:
            tokens = []
            for m in re.finditer("[A-Z][a-z]+", chunk):
                cut = min(5, len(m[0]))
                tokens.append({"word": m[0][:cut], "entity": "B-PER", "score": 0.9, "start": m.start(), "end": m.start() + cut})
                if len(m[0]) > cut:
                    tokens.append({"word": "##" + m[0][cut:], "entity": "B-PER", "score": 0.95, "start": m.start() + cut, "end": m.end()})
            out.append(tokens)
        return out

    return tag
