"""Per-scope settings: who is masked, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import field_text
from .joins import SALTS, join_lookup

# The settings of a scope that has none.
DEFAULTS = {"enabled": True, "maskingMode": "regex", "useML": True}


def latest_settings(log: DataFrame, version: str = "version") -> DataFrame:
    """One row per scope from a log of settings: the one with the highest version."""
    fields = F.struct("enabled", "maskingMode", "useML")
    return (
        log.groupBy("scope").agg(F.max_by(fields, F.col(version)).alias("s")).select("scope", "s.*")
    )


def update_settings(log: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """The log with the changes of ``(scope, enabled, version)`` appended.

    A change carries over the masking mode that its scope had in the log at the version of
    the change, and always turns the tagger on.
    """
    columns = ("scope", "enabled", "maskingMode", "useML", version)
    rows = log.select(*columns, F.struct("maskingMode").alias("_mode"))
    new = changes.select("scope", "enabled", F.lit(True).alias("useML"), version)
    both = rows.unionByName(new, allowMissingColumns=True)
    before = Window.partitionBy("scope").orderBy(version, F.col("_mode").isNull())
    before = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mode = F.last("_mode", ignorenulls=True).over(before)["maskingMode"]
    return both.withColumn("maskingMode", mode).select(*columns)


def _one_per_scope(settings: DataFrame, version: str) -> DataFrame:
    if settings.isStreaming:
        return settings
    settings = settings.where("scope IS NOT NULL")
    if version in settings.columns:
        return latest_settings(settings, version)
    fields = F.first(F.struct(*DEFAULTS))
    twice = F.raise_error(F.concat(F.lit("settings occur twice for scope "), F.col("scope")))
    one = F.when(F.count(F.lit(1)) == 1, fields).otherwise(twice)
    return settings.groupBy("scope").agg(one.alias("s")).select("scope", "s.*")


def apply_settings(
    df: DataFrame, settings: DataFrame, scope: str = "scope", version: str = "version"
) -> DataFrame:
    """Add ``enabled``, ``maskingMode`` and ``useML`` of each row's scope, defaults filled in.

    Of a log with a column ``version`` the latest row of a scope counts; without one, a scope
    that occurs twice is an error.
    """
    side = _one_per_scope(settings, version).select(F.col("scope").alias(scope), *DEFAULTS)
    joined = join_lookup(df, side, [scope], "left", SALTS)
    mode = field_text(F.col("maskingMode"), F.lit(DEFAULTS["maskingMode"]))
    return joined.withColumns({
        "enabled": F.coalesce("enabled", F.lit(DEFAULTS["enabled"])),
        "maskingMode": F.coalesce(mode, F.lit(DEFAULTS["maskingMode"])),
        "useML": F.coalesce("useML", F.lit(DEFAULTS["useML"])),
    })
