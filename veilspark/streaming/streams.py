"""Masking, alerting and mapping stores over streams of messages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import nonblank, only_pii
from ..operators.mappings import latest_mappings, span_mapping_rows
from ..operators.mask import mask_columns, mask_messages
from ..operators.tagging import Tagger
from ..session import checkpoint_root
from ..sources.mapping_log import compact_logged, log_batch
from ..sources.mapping_store import compact_mappings, write_batch
from .forgetting import forgetting_mappings

FLUSH_INTERVAL = "5 seconds"


def mask_stream(
    messages: DataFrame,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    cascade: bool = False,
) -> DataFrame:
    """All messages of a stream with their masked text, blank ones as they are; stateless."""
    if cascade:
        return mask_columns(messages.withColumn("masked", messages[text]), ["masked"])
    return mask_messages(messages, text, load)


def alert_stream(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages of a stream in which a pattern matches."""
    return only_pii(messages, text)


def _writer(df: DataFrame, name: str, checkpoint: str | None, interval: str | None, clock: bool = False):
    location = checkpoint or f"{checkpoint_root(df.sparkSession)}/streams/{name}"
    writer = df.writeStream.queryName(name).option("checkpointLocation", location)
    if interval:
        return writer.trigger(processingTime=interval)
    # state that waits for the clock always asks for one more batch: take what is there as one
    return writer.trigger(once=True) if clock else writer.trigger(availableNow=True)


def write_stream(
    df: DataFrame,
    path: str,
    name: str,
    checkpoint: str | None = None,
    interval: str | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append a stateless stream to a folder; without ``interval``, up to what is there now."""
    return _writer(df, name, checkpoint, interval).format(fmt).outputMode("append").start(path)


def flush_mappings(
    messages: DataFrame,
    path: str,
    scope: str,
    order: Column,
    name: str,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    checkpoint: str | None = None,
    interval: str | None = FLUSH_INTERVAL,
    compact_every: int | None = None,
    logged: bool = False,
    forget_after: float | None = None,
) -> StreamingQuery:
    """Keep a mapping store up to date with what span masking replaces in a stream.

    The state is one value per scope and mask.  Each trigger writes only the entries that
    changed, as a batch of its own, and nothing if none did; a trigger run again after a
    failure replaces its batch.  With ``compact_every``, the store is rewritten as one folder
    after that many triggers; no other stream may be writing to it then.  With ``logged``, the
    store is one with a commit log, which other streams may write to and rewrite at any time.
    With ``forget_after``, the state of a scope and mask without a message for that many seconds
    is given up (see ``forgetting_mappings``); its entry stays in the store.  Without an
    ``interval``, such a stream takes what is there now as one batch.
    """
    location = checkpoint or f"{checkpoint_root(messages.sparkSession)}/streams/{name}"
    run = "run" + hashlib.sha256(location.encode()).hexdigest()[:16]
    found = mask_messages(nonblank(messages, text), text, load).drop("masked")
    rows = span_mapping_rows(found, scope, order)
    state = latest_mappings(rows) if forget_after is None else forgetting_mappings(rows, forget_after)

    def flush_logged(changed: DataFrame, batch: int) -> None:
        log_batch(changed, path, batch, run)
        if compact_every and batch % compact_every == compact_every - 1:
            compact_logged(changed.sparkSession, path)

    def flush(changed: DataFrame, batch: int) -> None:
        write_batch(changed, path, batch, keep_empty=False, run=run)
        if compact_every and batch % compact_every == compact_every - 1:
            compact_mappings(changed.sparkSession, path)

    return (
        _writer(state, name, location, interval, forget_after is not None)
        .outputMode("update")
        .foreachBatch(flush_logged if logged else flush)
        .start()
    )
