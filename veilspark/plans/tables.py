"""The input tables of the registered queries, and texts Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.messages import read_message_stream, read_messages


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_messages(spark, f"{root}/documents.parquet", "text", ("doc_id",))


def pages(spark: SparkSession, root: str) -> DataFrame:
    return read_messages(spark, f"{root}/pages.parquet", "html", ("page_id", "url"))


def conversations(spark: SparkSession, root: str) -> DataFrame:
    return read_messages(
        spark, f"{root}/conversations.parquet", "text", ("conv_id", "turn", "role")
    )


def stream(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table as a stream, be the table a file or a folder of files.

    The path is a pattern that only the table's name fits: given a plain path, the source takes
    it for a folder, and a filter by file name would leave out the files in a table's folder.
    """
    return read_message_stream(spark, f"{root}/{name}.parque[t]", schema)


def _padded(value: Column, width: int, fill: str = "0") -> Column:
    return F.lpad(value.cast("string"), width, fill)


def message_text(k: Column) -> Column:
    """One of eighteen sentences, one per pattern, filled in with digits of the key."""
    part = F.lit
    templates = [
        [part("ssn "), _padded(k % 900 + 100, 3), part("-"), _padded(k % 90 + 10, 2), part("-"), _padded(k, 4)],
        [part("card 4111-"), _padded(k, 4), part("-2222-3333")],
        [part("CVV: "), _padded(k % 1000, 3)],
        [part("policy number: POL-2024-"), _padded(k, 7)],
        [part("MRN: 12-345-"), _padded(k, 5)],
        [part("VIN: 1HGCM826"), _padded(k, 9)],
        [part("routing number: "), _padded(k, 9, "1")],
        [part("account no. "), _padded(k, 12, "7")],
        [part("passport # C"), _padded(k, 8)],
        [part("driver's license number: D"), _padded(k, 7)],
        [part("mail user"), k.cast("string"), part("@example.com")],
        [part("call (206) 555-"), _padded(k, 4)],
        [part("zip "), _padded(k, 5, "9")],
        [part("ip 10.0."), (k % 256).cast("string"), part(".7")],
        [part("DOB: 01/02/19"), _padded(k % 100, 2)],
        [part("ask Dr. Ann Lee")],
        [part("my name is Ann Lee")],
        [part("at Acme Widget Corporation")],
    ]
    text = F.when(k % len(templates) == 0, F.concat(*templates[0]))
    for i, parts in enumerate(templates[1:], 1):
        text = text.when(k % len(templates) == i, F.concat(*parts))
    return text


def messages(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """A message per customer: ``k``, ``scope`` (the nation) and ``text``.

    ``parts`` deals the customers over so many tasks before the texts are made of them.
    """
    customers = spark.read.parquet(f"{root}/customer.parquet")
    rows = customers.select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("scope")
    )
    dealt = rows if parts is None else rows.repartition(parts)
    return dealt.withColumn("text", message_text(F.col("k")))


def letters(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """The messages behind a salutation: entities both clear of pattern hits and inside them.

    Their keys are read from very few and small file splits, which would leave the tagger's work
    to as few tasks: they are dealt over as many as a shuffle has.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat(F.lit("Dear Bob Stone, "), F.col("text"))
    return messages(spark, root, parts).select("k", *more, text.alias("text"))


def settings(spark: SparkSession, root: str) -> DataFrame:
    """Settings of some nations, with gaps that the defaults fill."""
    nation = spark.read.parquet(f"{root}/nation.parquet").where("n_nationkey < 20")
    n = F.col("n_nationkey")
    return nation.select(
        n.cast("string").alias("scope"),
        F.when(n % 3 == 1, F.lit(False)).when(n % 3 == 2, F.lit(True)).alias("enabled"),
        F.when(n % 4 == 1, F.lit("hybrid")).when(n % 4 == 2, F.lit("")).alias("maskingMode"),
        F.when(n % 5 == 1, F.lit(False)).alias("useML"),
    )


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """A decision for three of four messages."""
    k = F.col("c_custkey")
    choice = (
        F.when(k % 4 == 0, "protected").when(k % 4 == 1, "original").when(k % 4 == 2, "cancel")
    )
    rows = spark.read.parquet(f"{root}/customer.parquet").select(k.alias("k"), choice.alias("choice"))
    return rows.where(F.col("choice").isNotNull())
