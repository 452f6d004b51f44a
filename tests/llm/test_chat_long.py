"""Conversations of many turns: the same text, in time that grows with the turns."""

import time

from pyspark.sql import functions as F

from veilspark.llm.chat import END, SEPARATOR, START, format_chat, read_chat


def written(turns):
    out, last = "", None
    for role, text in turns:
        if role == last:
            out += SEPARATOR + text
        else:
            out += (END if last is not None else "") + f"{START}{role}\n{text}"
        last = role
    return out + (END if turns else "")


def format_one(spark, turns):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    start = time.monotonic()
    row = format_chat(df).select("formatted", F.size(read_chat(F.col("formatted"))).alias("n")).first()
    return row["formatted"], row["n"], time.monotonic() - start


def test_runs_of_every_length(spark):
    shapes = ["u", "uu", "uaua", "uuaaau", "u" * 500 + "a" * 500, "ua" * 700, "uuua" * 300 + "s"]
    for shape in shapes:
        turns = [({"u": "user", "a": "assistant", "s": "system"}[c], f"t{i}") for i, c in enumerate(shape)]
        text, n, _ = format_one(spark, turns)
        assert text == written(turns) and n == len(turns)


def test_time_grows_with_the_turns(spark):
    def seconds(n):
        turns = [("assistant" if i % 3 else "user", f"text {i}") for i in range(n)]
        return min(format_one(spark, turns)[2] for _ in range(2))

    seconds(1000)
    # ten times the turns; the square would be a hundred times the seconds
    assert seconds(40_000) < 30 * seconds(4_000) + 1
