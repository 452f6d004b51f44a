"""Joins: texts with side tables, and stored entities with stored spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.resolve import overlaps

# Many texts may share a key: deal them over as many parts as a shuffle has.
SALTS = None


def join_lookup(
    texts: DataFrame, side: DataFrame, keys: list[str], how: str, salts: int | None = 1
) -> DataFrame:
    """Join ``texts`` with a narrow ``side``; whether the side is broadcast is the planner's choice.

    With ``salts``, every row of the side is repeated that often and the texts of a key are
    dealt over the repetitions by a hash of their columns, so that a join which shuffles does
    not send all texts of a hot key to one task.  None stands for the number of shuffle
    partitions, so that a hot key can reach every task of the stage.
    """
    if salts is None:
        salts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts == 1 or side.isStreaming:
        return texts.join(side, keys, how)
    hashed = [f.name for f in texts.schema if not _unhashable(f.dataType)]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return texts.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


def _unhashable(kind: T.DataType) -> bool:
    return any(name in kind.simpleString() for name in ("map<", "variant"))


_BLOCK_BITS = 8  # spans meet in blocks of 256 characters


def without_overlaps(
    entities: DataFrame, spans: DataFrame, keys: list[str], number: str
) -> DataFrame:
    """Entities that overlap no span of the same text: an interval anti join of two tables.

    ``entities`` has ``keys``, ``number`` (unique per text), ``start`` and ``end``; ``spans``
    has ``keys``, ``index`` and ``value``.  For texts still at hand, ``detect_hybrid`` does
    the same without a join.  Both sides are laid out over blocks of the text, so rows of one
    text meet only where they are near each other, and equal spans of copies are merged
    before they are shuffled.  Entities carry their columns through the join, so what made
    them runs once.  An entity without a key or a place overlaps nothing.
    """

    def blocks(low: Column, high: Column) -> Column:
        first = F.shiftright(F.greatest(low, F.lit(0)), _BLOCK_BITS)
        last = F.shiftright(F.greatest(high, F.lit(0)), _BLOCK_BITS)
        return F.explode_outer(F.sequence(first, last)).alias("_block")

    index = F.col("index")
    stop = index + F.length("value")
    low, high = F.least("start", "end"), F.greatest("start", "end")
    placed = F.col("start").isNotNull() & F.col("end").isNotNull()
    keyless = reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    probe = entities.select(
        F.struct(*entities.columns).alias("_row"),
        *keys,
        number,
        F.when(keyless, F.monotonically_increasing_id()).alias("_keyless"),
        F.col("start").alias("_from"),
        F.col("end").alias("_to"),
        blocks(F.when(placed, low), F.when(placed, high)),
    )
    cover = spans.select(
        *[F.col(key).alias(f"_{key}") for key in keys],
        index.alias("_index"),
        stop.alias("_stop"),
        blocks(index, stop).alias("_cover"),
    ).distinct()
    near = F.col("_block") == F.col("_cover")
    for key in keys:
        near = near & (F.col(key) == F.col(f"_{key}"))
    met = probe.join(
        cover,
        near & overlaps(F.col("_index"), F.col("_stop"), F.col("_from"), F.col("_to")),
        "left",
    )
    judged = met.groupBy(*keys, number, "_keyless").agg(
        F.bool_or(F.col("_index").isNotNull()).alias("_hit"), F.any_value("_row").alias("_row")
    )
    return judged.where(~F.col("_hit")).select("_row.*")
