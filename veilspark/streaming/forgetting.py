"""The latest value per scope and mask of a stream, with state that idle scopes give back.

State is one value per scope and mask and its place in the order.  What has had no message for
a time is dropped from the state; the mapping store, which the stream feeds, keeps it.  Rows
are reduced in each task before they meet by key, so that a scope with a third of all messages
sends a row per task and mask.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY, PLACE = ["scope", "mask"], ["message", "no"]
ENTRY = "scope string, mask string, value string"
ROWS_HELD = 100_000
_FIRST = -(2**63)


def _long(order: Column, kind: T.DataType) -> Column:
    """The order as a long; a null comes first, as in ``latest_mappings``."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(order.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        number = F.unix_date(order)
    elif isinstance(kind, T.IntegralType):
        number = order.cast("long")
    else:
        raise TypeError(f"messages are ordered by a whole number, a date or a time, not by {kind.simpleString()}")
    return F.coalesce(number, F.lit(_FIRST))


def _last(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(PLACE, kind="stable").drop_duplicates(KEY, keep="last")


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last row of each key among those held, handed on when too many are held."""
    held = None
    for frame in frames:
        held = _last(frame if held is None else pd.concat([held, frame]))
        if len(held) >= ROWS_HELD:
            yield held
            held = None
    if held is not None:
        yield held


def forgetting_mappings(rows: DataFrame, forget_after: float) -> DataFrame:
    """What ``latest_mappings`` gives for a stream, from state that is kept for some seconds.

    A row is given whenever a later value than the known one comes.  The seconds count from the
    last message with that scope and mask, by the clock.  After that, also a message that is
    earlier in the order than the forgotten one counts as new.
    """
    kind = rows.schema["written"].dataType["_message"].dataType
    milliseconds = max(1, round(forget_after * 1000))
    flat = rows.select(
        *KEY, "value", _long(F.col("written._message"), kind).alias("message"), F.col("written._no").cast("long").alias("no")
    )
    reduced = flat.mapInPandas(_reduced, f"{ENTRY}, message long, no long")

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = tuple(state.get) if state.exists else None
        best, value = before, None
        for frame in frames:
            row = frame.sort_values(PLACE, kind="stable").iloc[-1]
            place = (int(row["message"]), int(row["no"]))
            if best is None or place >= best:
                best, value = place, row["value"]
        if value is not None:
            state.update(best)
            yield pd.DataFrame({"scope": [key[0]], "mask": [key[1]], "value": [value]})
        state.setTimeoutDuration(milliseconds)

    return reduced.groupBy(*KEY).applyInPandasWithState(
        keep, ENTRY, "message long, no long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
