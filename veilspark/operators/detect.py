"""Detection over DataFrames of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.arrays import empty, let
from ..functions.entities import detect_hybrid
from ..functions.spans import detect_regex, find_spans, first_pii_type, has_pii
from ..functions.text import is_blank
from ..schema import DETECTION
from .tagging import Tagger, with_entities


def detections(text: Column, entities: Column | None = None, enabled: Column | None = None) -> Column:
    """Detections of one text: none if disabled or empty, patterns, and entities if given.

    A null ``entities`` means that the tagger had no answer: patterns only.
    """
    found = detect_regex(text)
    if entities is not None:
        found = let(
            found,
            lambda spans: F.when(entities.isNull(), spans).otherwise(
                detect_hybrid(spans, entities)
            ),
        )
    active = text != ""
    if enabled is not None:
        active = active & F.coalesce(enabled, F.lit(True))
    return F.when(active, found).otherwise(empty(DETECTION))


def detect_pii(
    df: DataFrame,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    enabled: str | None = None,
    use_ml: str | None = None,
    out: str = "detections",
    errors: str = "ml_errors",
    metrics: Observation | None = None,
) -> DataFrame:
    """Add the detections of ``text``.

    With ``load``, a tagger is run as well, and ``errors`` is the number of chunks of the text
    on which it failed; for those the patterns alone count.  ``enabled`` and ``use_ml`` name boolean columns
    that switch detection and the tagger off per row.  ``metrics`` gathers figures of the
    tagging as the rows pass by, see ``observe_tagging``.
    """
    flag = F.col(enabled) if enabled else None
    if load is None:
        return df.withColumn(out, detections(F.col(text), enabled=flag))
    wanted = F.lit(True)
    for name in (enabled, use_ml):
        if name:
            wanted = wanted & F.coalesce(F.col(name), F.lit(True))
    # rows that do not want the tagger show it no text, so they cost no inference
    shown = df.withColumn("_shown", F.when(wanted, F.col(text)))
    tagged = with_entities(shown, "_shown", load, "_entities", errors, metrics)
    entities = F.when(F.col("_shown").isNotNull(), F.col("_entities"))
    return tagged.withColumn(out, detections(F.col(text), entities, flag)).drop(
        "_shown", "_entities"
    )


def detection_rows(df: DataFrame, *keys: str, text: str = "text", name: str | None = None) -> DataFrame:
    """One row per pattern hit, of one pattern or of all, with its ordinal in the text."""
    # the generator takes the expression itself: over a named column the optimizer would
    # also compute it a second time to filter out empty arrays
    spans = detect_regex(F.col(text)) if name is None else find_spans(F.col(text), name)
    return df.select(*keys, F.posexplode(spans).alias("ordinal", "hit")).select(
        *keys, "ordinal", "hit.*"
    )


def count_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of raw hits per type; counted before the shuffle, so skew does not matter."""
    kinds = F.transform(detect_regex(F.col(text)), lambda s: s["type"])
    return (
        df.select(F.explode(kinds).alias("type"))
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def flag_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``has_pii`` and the first pattern that fired."""
    return df.withColumn("first_type", first_pii_type(F.col(text))).withColumn(
        "has_pii", F.col("first_type").isNotNull()
    )


def only_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has at least one hit."""
    return df.where(has_pii(F.col(text)))


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with visible text."""
    return df.where(~is_blank(F.col(text)))
