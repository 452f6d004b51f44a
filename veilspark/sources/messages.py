"""Reading texts and writing them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_messages(
    spark: SparkSession,
    path: str | list[str],
    text: str = "text",
    keys: tuple[str, ...] = (),
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """The key columns and the text of a table of messages; nothing else is read.

    ``partitions`` shuffles the texts into that many parts, for a few files of one row group
    each, which no more tasks than files can read.  Without it texts stay where they are read.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.load(path).select(*keys, text)
    return rows if partitions is None else rows.repartition(partitions)


def read_message_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Messages as they arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_masked(
    df: DataFrame,
    path: str,
    text: str = "text",
    masked: str = "masked",
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: tuple[str, ...] = (),
) -> None:
    """Write the rows with their text replaced by the masked one."""
    out = df.drop("detections").withColumn(text, df[masked]).drop(masked)
    out.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)
