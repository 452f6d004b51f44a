"""Masking over DataFrames of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.resolve import mask_spans
from ..functions.spans import mask_cascade
from .detect import detect_pii
from .tagging import Tagger


def mask_columns(df: DataFrame, columns: list[str], enabled: str | None = None) -> DataFrame:
    """Cascade-mask several text columns of a row, each on its own."""

    def masked(name: str) -> Column:
        changed = mask_cascade(F.col(name))
        if enabled is None:
            return changed
        return F.when(F.coalesce(F.col(enabled), F.lit(True)), changed).otherwise(F.col(name))

    return df.withColumns({name: masked(name) for name in columns})


def mask_messages(
    df: DataFrame,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    enabled: str | None = None,
    use_ml: str | None = None,
    out: str = "masked",
    metrics: Observation | None = None,
) -> DataFrame:
    """Add ``detections`` and the span-masked text."""
    found = detect_pii(df, text, load, enabled, use_ml, metrics=metrics)
    return found.withColumn(out, mask_spans(F.col(text), F.col("detections")))


def mask_changed(df: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """Only the rows the cascade changes, with their masked text.

    A filter on the masked text would be pushed below it and mask every text twice.  A
    generator over the rows to keep computes it once.
    """
    change = F.filter(F.array(mask_cascade(F.col(text))), lambda m: m != F.col(text))
    return df.withColumn(out, F.explode(change))
