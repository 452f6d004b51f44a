"""Which value a placeholder last stood for.

Mappings hold the very values that masking hides: nothing here runs unless it is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resolve import span_mappings
from ..functions.spans import cascade_mappings


def mapping_rows(
    df: DataFrame, scope: str, order: Column, pairs: Column
) -> DataFrame:
    """One row per recorded pair: scope, mask, value and its place in the order."""
    return df.select(
        F.col(scope).cast("string").alias("scope"),
        order.alias("_message"),
        F.posexplode(pairs).alias("_no", "pair"),
    ).select("scope", "pair.mask", "pair.value", F.struct("_message", "_no").alias("written"))


def cascade_mapping_rows(df: DataFrame, scope: str, order: Column, text: str = "text") -> DataFrame:
    return mapping_rows(df, scope, order, cascade_mappings(F.col(text)))


def span_mapping_rows(
    df: DataFrame, scope: str, order: Column, spans: str = "detections"
) -> DataFrame:
    return mapping_rows(df, scope, order, span_mappings(F.col(spans)))


def latest_mappings(rows: DataFrame) -> DataFrame:
    """Last value written per scope and mask.

    The aggregate is reduced before the shuffle to one row per scope and mask in each
    task, so a scope that wrote most of the rows is no heavier than another.
    """
    return rows.groupBy("scope", "mask").agg(F.max_by("value", "written").alias("value"))
