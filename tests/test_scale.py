"""What keeps memory and time of the tagger and the folds behind it within bounds."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import entities
from veilspark.functions.resolve import resolve_overlaps
from veilspark.operators import tagging
from veilspark.operators.lexical import load_lexical
from veilspark.plans import tables


def test_batches_are_tagged_in_parts(spark, monkeypatch):
    sizes = [3000, None, 0, 3000, 9000, 1]
    rows = pa.array([None if n is None else ["x"] * n for n in sizes], pa.list_(pa.string()))
    parts = list(tagging._parts(rows))
    assert pa.concat_arrays(parts).equals(rows) and len(parts) == 3
    assert [len(part.flatten()) for part in parts] == [6000, 9000, 1]
    monkeypatch.setattr(tagging, "CHUNKS_AT_ONCE", 3)
    df = spark.createDataFrame([(i, "Ann Lee " * (i * 30 % 97)) for i in range(40)], "id int, text string")
    got = tagging.tag_tokens(df.coalesce(1), "text", load_lexical).collect()
    assert len(got) == 40
    for row in got:
        expected = load_lexical()([c["text"] for c in row["chunks"]])
        assert [[t["word"] for t in a["tokens"]] for a in row["tagged"]] == [[t["word"] for t in a] for a in expected]


def test_folds_carry_numbers_only():
    for kind in (entities._ITEM, entities._MERGED):
        assert all(isinstance(f.dataType, (T.IntegerType, T.DoubleType)) for f in kind)


def test_resolution_apart_and_not(spark):
    schema = "id int, s array<struct<type:string,value:string,index:int,source:string,confidence:double>>"

    def span(index, value):
        return ("t", value, index, "ml", 0.9)

    cases = [
        [span(5, "abc"), span(0, "ab")],
        [span(0, "abc"), span(2, "x"), span(3, "y")],
        [span(3, ""), span(3, "x"), span(3, "")],
        [span(-5, "ab"), span(0, "x")],
        [span(0, "ab"), span(1, None), span(4, "c")],
    ]
    df = spark.createDataFrame(list(enumerate(cases)), schema)
    got = df.select("id", F.transform(resolve_overlaps(F.col("s")), lambda s: F.struct(s["index"], s["value"])).alias("r"))
    assert [[tuple(x) for x in r["r"]] for r in got.orderBy("id").collect()] == [
        [(0, "ab"), (5, "abc")],
        [(0, "abc"), (3, "y")],
        [(3, ""), (3, "x"), (3, "")],
        [(0, "x")],
        [(0, "ab"), (4, "c")],
    ]


def test_letters_are_dealt_over_tasks(spark, tmp_path):
    rows = [(k, k % 5) for k in range(50)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    letters = tables.letters(spark, str(tmp_path), "scope")
    assert letters.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["k"] for r in letters.collect()) == list(range(50))
