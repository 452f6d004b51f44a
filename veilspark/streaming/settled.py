"""Streams under settings that change while they run.

Settings are a log: rows of scope, ``enabled``, ``maskingMode``, ``useML`` and a growing
version.  A streaming join would keep the files it listed when the query was planned, so the
log is read anew at every trigger, and the trigger works with the log as of the highest version
it saw.  That version is noted before anything is written, beside the stream's checkpoint: a
trigger run again after a failure takes the noted version, whatever has been added since, and
replaces its own output.  So each row's ``settings_version`` says what it was treated with, and
the whole output is what batches over the same rows and versions give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import nonblank, only_pii
from ..operators.mappings import latest_mappings, span_mapping_rows
from ..operators.mask import mask_columns, mask_messages
from ..operators.settings import apply_settings, latest_settings
from ..operators.tagging import Tagger
from ..schema import SETTINGS
from ..session import checkpoint_root
from ..sources.mapping_store import folder_is_complete, write_batch

Settings = Callable[[], DataFrame]


def settings_log(
    spark: SparkSession, path: str, version: str = "version", kind: T.DataType | None = None
) -> Settings:
    """A reader of a log of settings in a folder; empty while the folder is not there.

    The log may be appended to while streams read it; versions only grow.
    """
    schema = T.StructType([*SETTINGS.fields, T.StructField(version, kind or T.LongType())])

    def read() -> DataFrame:
        if not folder_is_complete(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    return read


def settings_as_of(log: DataFrame, at: object, version: str = "version") -> DataFrame:
    """One row per scope: its latest settings up to the version ``at``; none if that is null."""
    return latest_settings(log.where(F.col(version) <= F.lit(at)), version)


def mask_settled(
    messages: DataFrame,
    settings: DataFrame,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    scope: str = "scope",
    cascade: bool = False,
) -> DataFrame:
    """All messages with their masked text; those of scopes that are off stay as they are."""
    known = apply_settings(messages, settings, scope)
    if cascade:
        return mask_columns(known.withColumn("masked", known[text]), ["masked"], "enabled")
    return mask_messages(known, text, load, "enabled", "useML")


def alert_settled(
    messages: DataFrame, settings: DataFrame, text: str = "text", scope: str = "scope"
) -> DataFrame:
    """Messages in which a pattern matches, of scopes that are on."""
    known = apply_settings(messages, settings, scope).where("enabled")
    return only_pii(known, text).select(*messages.columns)


def _settled(
    messages: DataFrame,
    settings: Settings,
    version: str,
    name: str,
    checkpoint: str | None,
    interval: str | None,
    write: Callable[[DataFrame, DataFrame, object, int, str], None],
) -> StreamingQuery:
    spark = messages.sparkSession
    location = checkpoint or f"{checkpoint_root(spark)}/streams/{name}"
    run = "run" + hashlib.sha256(location.encode()).hexdigest()[:16]

    def at_trigger(rows: DataFrame, batch: int) -> None:
        note = f"{location}/settings/{batch:019d}"
        log = settings()
        if not folder_is_complete(spark, note):
            log.agg(F.max(version).alias("at")).write.mode("overwrite").parquet(note)
        at = spark.read.parquet(note).first()["at"]
        kind = log.schema[version].dataType
        write(rows, settings_as_of(log, at, version), F.lit(at).cast(kind), batch, run)

    writer = messages.writeStream.queryName(name).option("checkpointLocation", location)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.foreachBatch(at_trigger).start()


def write_settled(
    messages: DataFrame,
    settings: Settings,
    act: Callable[[DataFrame, DataFrame], DataFrame],
    path: str,
    name: str,
    version: str = "version",
    checkpoint: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Write what ``act(messages, settings)`` makes of each trigger, and ``settings_version``.

    ``act`` is ``mask_settled``, ``alert_settled`` or any function of a batch.  Every trigger has
    a folder of its own, ``batch=RUN-NUMBER``, which a trigger run again replaces.  Without
    ``interval``, up to what is there now.
    """

    def write(rows: DataFrame, now: DataFrame, at: Column, batch: int, run: str) -> None:
        done = act(rows, now).withColumn("settings_version", at)
        done.write.mode("overwrite").parquet(f"{path}/batch={run}-{batch:019d}")

    return _settled(messages, settings, version, name, checkpoint, interval, write)


def flush_settled(
    messages: DataFrame,
    settings: Settings,
    path: str,
    order: Column,
    name: str,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    scope: str = "scope",
    version: str = "version",
    checkpoint: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Keep a mapping store up to date with what is masked under the settings.

    A later trigger wins over an earlier one, and within a trigger ``order`` decides, so there
    is no streaming state to keep: the store holds it.  Scopes that are off add nothing.
    """

    def write(rows: DataFrame, now: DataFrame, at: Column, batch: int, run: str) -> None:
        found = mask_settled(nonblank(rows, text), now, text, load, scope).drop("masked")
        entries = latest_mappings(span_mapping_rows(found, scope, order))
        write_batch(entries, path, batch, keep_empty=False, run=run)

    return _settled(messages, settings, version, name, checkpoint, interval, write)
