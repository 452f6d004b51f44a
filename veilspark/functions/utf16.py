"""Offsets in UTF-16 units, for texts with characters outside the basic plane.

Spark counts code points; where offsets, lengths and chunk borders must be those of an engine
that counts UTF-16 units, every operator can run on the widened text instead: behind each
character that takes two units stands a filler, so that one code point is one unit.  ``narrow``
takes the fillers out again.  For offsets alone, ``utf16_index`` counts such characters up to
every block of the text, and maps offsets both ways without walking from its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let, running_total, text_blocks

# A code point that is no character: it stands in no text.
FILLER = "￿"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_OTHER = r"[^\x{10000}-\x{10FFFF}]++"
_BLOCK_BITS = 8  # of text_blocks

INDEX = T.StructType([
    T.StructField("blocks", T.ArrayType(T.StringType())),
    T.StructField("before", T.ArrayType(T.IntegerType())),
])


def widen(text: Column) -> Column:
    """One code point per UTF-16 unit; a filler that the text has itself becomes U+FFFD."""
    clean = F.replace(text, F.lit(FILLER), F.lit("�"))
    return F.regexp_replace(clean, f"({_ASTRAL})", f"$1{FILLER}")


def narrow(text: Column) -> Column:
    """The text behind a widened one or a cut of it; half a character becomes U+FFFD."""
    whole = F.regexp_replace(text, f"({_ASTRAL})(?!{FILLER})", "�")
    whole = F.regexp_replace(whole, f"({_ASTRAL}){FILLER}", "$1")
    return F.replace(whole, F.lit(FILLER), F.lit("�"))


def n_astral(text: Column) -> Column:
    """Characters of the text that take two units."""
    return F.length(F.regexp_replace(text, _OTHER, ""))


def utf16_index(text: Column) -> Column:
    """The text in blocks, and how many characters of two units stand before each."""
    return let(
        text_blocks(text),
        lambda blocks: F.struct(
            blocks.alias("blocks"), running_total(F.transform(blocks, n_astral)).alias("before")
        ),
    )


def to_utf16(index: Column, offset: Column) -> Column:
    """UTF-16 units before a code point."""
    block = F.shiftright(offset, _BLOCK_BITS)
    last = F.least(block, F.size(index["blocks"]) - 1)
    inner = F.substring(F.get(index["blocks"], last), F.lit(1), offset - F.shiftleft(last, _BLOCK_BITS))
    return F.when(F.size(index["blocks"]) == 0, offset).otherwise(
        offset + F.get(index["before"], last) + n_astral(inner)
    )


def from_utf16(index: Column, units: Column) -> Column:
    """Code points before a UTF-16 unit; of the second half of a character, those before it."""
    starts = F.transform(index["before"], lambda n, i: n + F.shiftleft(i, _BLOCK_BITS))
    block = F.greatest(F.size(F.filter(starts, lambda s: s <= units)) - 1, F.lit(0))

    def inside(at: Column) -> Column:
        rest = units - F.get(index["before"], at) - F.shiftleft(at, _BLOCK_BITS)
        wide = widen(F.get(index["blocks"], at))
        head = F.substring(wide, F.lit(1), rest)
        fillers = F.length(head) - F.length(F.replace(head, F.lit(FILLER), F.lit("")))
        half = F.substring(wide, rest + 1, F.lit(1)) == FILLER
        return F.shiftleft(at, _BLOCK_BITS) + rest - fillers - half.cast("int")

    return F.when(F.size(index["blocks"]) == 0, units).otherwise(let(block, inside))
