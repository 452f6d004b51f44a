"""Tables, shared folders and small helpers of the operators in this package."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

# Fixed value: what separates words, as the inside of a Java or RE2 character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """The rows written to the shared folder and read back.

    Cuts lineage: an executor lost later costs the reading of its part of the table, not
    the stages that made it.  ``instead``: an earlier staged table that nothing reads once this
    one is written; it is removed.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if instead is not None:
        drop_staged(instead)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries removed now.

    Spark removes them once the driver has collected the plans they belong to, which it has no
    reason to do between the steps of a query that needs little of its memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(df: DataFrame) -> None:
    """Remove the folder behind a staged table."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        remove_folder(df.sparkSession, folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def python_words(text: Column) -> Column:
    """Words as an array of strings: runs of anything but ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
