"""Connected components of a table of links, by labels that jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected with.

    Every round takes the smallest label among the neighbours, then the label of that label,
    so the rounds grow with the logarithm of a component's width.  Each round is written to
    the shared folder; only the number of changes comes to the driver.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = staged(both.where("node <> other").distinct(), "links")
    label = staged(
        both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "labels"
    )
    while True:
        theirs = label.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        near = both.join(theirs, "other").groupBy("node").agg(F.min("theirs").alias("near"))
        own = label.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("middle")
        )
        jump = label.select(F.col("node").alias("middle"), F.col("component").alias("far"))
        after = own.join(jump, "middle").select("node", "before", F.least("middle", "far").alias("component"))
        after = staged(after, "labels")
        label = after.select("node", "component")
        if after.where("before <> component").isEmpty():
            return label
