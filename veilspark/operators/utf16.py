"""Detection and masking that count as an engine of UTF-16 strings does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.entities import chunk_text, detect_ml
from ..functions.resolve import mask_spans
from ..functions.utf16 import from_utf16, n_astral, narrow, utf16_index, widen
from .detect import detections
from .tagging import Tagger, token_tagger


def _unit_tokens(answer: Column, chunk: Column) -> Column:
    """A tagger's answer for a narrow chunk, in units."""

    def unit(place: Column) -> Column:
        return place + n_astral(F.substring(chunk, F.lit(1), place))

    def token(t: Column) -> Column:
        return F.struct(
            widen(t["word"]).alias("word"), t["entity"].alias("entity"), t["score"].alias("score"),
            unit(t["start"]).alias("start"), unit(t["end"]).alias("end"),
        )

    return F.struct(F.transform(answer["tokens"], token).alias("tokens"), answer["error"].alias("error"))


def mask_messages_utf16(
    df: DataFrame,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    code_points: bool = False,
    out: str = "masked",
) -> DataFrame:
    """Add ``detections`` and the span-masked text as ``mask_messages`` does, counted in units.

    ``index`` of a detection is in UTF-16 units, or with ``code_points`` the same place in code
    points; chunk borders and the rules on lengths are in units.  A chunk border inside a
    character shows the tagger U+FFFD for its half.  Values and texts are as they are written.
    """
    wide = df.withColumn("_wide", widen(F.col(text)))
    entities = None
    if load is not None:
        tag = token_tagger(load)
        chunks = chunk_text(F.col("_wide"))
        wide = wide.withColumn("_chunks", chunks)
        wide = wide.withColumn("_shown", F.transform("_chunks", lambda c: narrow(c["text"])))
        wide = wide.withColumn("_tagged", tag(F.col("_shown")))
        wide = wide.withColumn("_tagged", F.zip_with("_tagged", "_shown", _unit_tokens))
        failed = F.size(F.filter("_tagged", lambda a: a["error"].isNotNull()))
        wide = wide.withColumn("ml_errors", F.greatest(failed, F.lit(0)))
        entities = detect_ml(F.col("_wide"), F.col("_chunks"), F.col("_tagged"))
        wide = wide.withColumn("_entities", entities)
        entities = F.when(F.col(text).isNotNull(), F.col("_entities"))
    found = wide.withColumn("_found", detections(F.col("_wide"), entities))

    def shown(index: Column | None) -> Column:
        def one(d: Column) -> Column:
            at = d["index"] if index is None else from_utf16(index, d["index"])
            return d.withField("value", narrow(d["value"])).withField("index", at)

        return F.transform("_found", one)

    listed = let(utf16_index(F.col(text)), shown) if code_points else shown(None)
    return found.withColumns({
        "detections": listed, out: narrow(mask_spans(F.col("_wide"), F.col("_found")))
    }).drop("_wide", "_chunks", "_shown", "_tagged", "_entities", "_found")
