"""A folder holding which value each placeholder last stood for, per scope.

The folder has one sub-folder per write, ``batch=GENERATION.NUMBER.RUN``.  Only sub-folders
whose write was completed count, so a job that dies half-way leaves the former state readable.
A run is a stream's checkpoint; its numbers are those of its triggers.  A run that has nothing
in the latest generation opens a new one, so a new checkpoint, or a stream that goes on after
the store was rewritten, is later than what is there and replaces nothing.  A rewrite is a
generation of the run ``all``; whatever is older than the last completed one does not count.
The values are the very data that masking hides: keep the folder as safe as the originals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MAPPING


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def folder_is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was completed."""
    fs, marker = _hadoop_path(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


WHOLE = "all"  # the run of rewrites


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int, str, str]]:
    """Generation, number, run and path of all sub-folders, oldest first."""
    fs, root = _hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = []
    for name in names:
        if name.startswith("batch="):
            generation, number, run = name.removeprefix("batch=").split(".")
            found.append((int(generation), int(number), run, f"{path}/{name}"))
    return sorted(found)


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Completed sub-folders that count."""
    fs = _hadoop_path(spark, path)[0]
    done = [f for f in _folders(spark, path) if fs.exists(_hadoop_path(spark, f"{f[3]}/_SUCCESS")[1])]
    whole = max((f[0] for f in done if f[2] == WHOLE), default=0)
    return [f[3] for f in done if f[0] >= whole]


def _write(mappings: DataFrame, path: str, generation: int, number: int, run: str) -> str:
    folder = f"{path}/batch={generation:010d}.{number:019d}.{run}"
    mappings.select("scope", "mask", "value").write.mode("overwrite").parquet(folder)
    return folder


def write_batch(
    mappings: DataFrame, path: str, batch: int, keep_empty: bool = True, run: str = "batches"
) -> None:
    """Add one batch of a run; writing the same batch again replaces it."""
    spark = mappings.sparkSession
    former = _folders(spark, path)
    latest = max((f[0] for f in former), default=0)
    known = any(f[0] == latest and f[2] == run for f in former)
    folder = _write(mappings, path, latest if known else latest + 1, batch, run)
    if not keep_empty and spark.read.schema(MAPPING).parquet(folder).isEmpty():
        fs, written = _hadoop_path(spark, folder)
        fs.delete(written, True)


def save_mappings(mappings: DataFrame, path: str) -> None:
    """Make ``mappings`` (scope, mask, value) the whole content of the store."""
    spark = mappings.sparkSession
    former = _folders(spark, path)
    _write(mappings, path, max((f[0] for f in former), default=0) + 1, 0, WHOLE)
    for *_, folder in former:
        fs, old = _hadoop_path(spark, folder)
        fs.delete(old, True)


def load_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Content of the store; empty if there is none."""
    batches = _batches(spark, path)
    if not batches:
        return spark.createDataFrame([], MAPPING)
    rows = spark.read.schema(MAPPING).option("basePath", path).parquet(*batches)
    if len(batches) == 1:
        return rows.select("scope", "mask", "value")
    return rows.groupBy("scope", "mask").agg(
        F.max_by("value", F.col("batch")).alias("value")
    )


def compact_mappings(spark: SparkSession, path: str) -> None:
    """Rewrite a store of many batches as one.  No stream may be writing to it meanwhile."""
    save_mappings(load_mappings(spark, path), path)
