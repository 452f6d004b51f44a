"""Previews of what would be sent, and the decisions taken on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html
from .detect import nonblank
from .joins import join_lookup
from .mask import mask_messages
from .tagging import Tagger


def preview(
    df: DataFrame,
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    enabled: str | None = None,
    use_ml: str | None = None,
) -> DataFrame:
    """Add the preview of every visible text; blank texts have none.

    ``n_detected`` counts raw detections, before overlaps are resolved.  A text for which
    ``enabled`` is false gets a preview in which nothing was found.
    """
    masked = mask_messages(nonblank(df, text), text, load, enabled, use_ml)
    n = F.col("n_detected")
    found = n > 0
    return (
        masked.withColumn("n_detected", F.size("detections"))
        .drop("detections")
        .withColumn("has_pii", found)
        .withColumn(
            "title",
            F.when(found, "PII Detected - Review Before Sending").otherwise("Ready to Send"),
        )
        .withColumn(
            "subtitle",
            F.when(
                found,
                F.concat(
                    F.lit("Found "),
                    n.cast("string"),
                    F.when(n == 1, " sensitive item").otherwise(" sensitive items"),
                    F.lit(" that will be protected"),
                ),
            ).otherwise("No sensitive information detected - safe to send"),
        )
    )


def preview_html(previews: DataFrame, text: str = "text", masked: str = "masked") -> DataFrame:
    """Add both texts as they are put into an HTML report; the masked one only if PII was found."""
    return previews.withColumn("original_html", escape_html(F.col(text))).withColumn(
        "masked_html", F.when(F.col("has_pii"), escape_html(F.col(masked)))
    )


def _sending(decisions: DataFrame, keys: list[str]) -> DataFrame:
    return decisions.select(*keys, "choice").where(F.col("choice").isin("protected", "original"))


def resolve_decisions(
    previews: DataFrame,
    decisions: DataFrame,
    keys: list[str],
    text: str = "text",
    out: str = "sent",
) -> DataFrame:
    """Text to send per decided preview; ``decisions`` has ``keys`` and ``choice``.

    ``protected`` sends the masked text (the original where nothing was found), ``original``
    the original; ``cancel``, and previews without a decision, send nothing.
    """
    joined = join_lookup(previews, _sending(decisions, keys), keys, "inner")
    protect = (F.col("choice") == "protected") & F.col("has_pii")
    return joined.withColumn(out, F.when(protect, F.col("masked")).otherwise(F.col(text)))


def send_decided(
    df: DataFrame,
    decisions: DataFrame,
    keys: list[str],
    text: str = "text",
    load: Callable[[], Tagger] | None = None,
    out: str = "sent",
) -> DataFrame:
    """``resolve_decisions`` straight from the messages, where no preview is to be kept.

    The decisions are joined first, so that only texts sent as ``protected`` are scanned,
    and a join that must shuffle moves the texts alone.  A decided message without visible
    text is sent as it is.
    """
    joined = join_lookup(df, _sending(decisions, keys), keys, "inner")
    flagged = joined.withColumn("_protect", F.col("choice") == "protected")
    sent = mask_messages(flagged, text, load, enabled="_protect", out=out)
    return sent.drop("_protect", "detections")
