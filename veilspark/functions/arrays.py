"""Small building blocks over array columns: binding, slicing, sequential folds.

Spark has no sequential scan over an array, and an ``aggregate`` that appends to one
output array copies that array, with all that is in it, at every step.  ``fold_emit`` appends
to blocks instead, as many as each has elements, which leaves the least to copy.  Steps are
cheap as long as state and output are a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_BITS = 8  # text_blocks: 256 characters per block
_TEXT_BLOCK = 1 << _TEXT_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    An aggregate over nothing hands its start value to its finish.  ``transform`` over an
    array of one would do as well, but Spark derives the type of nested ``transform`` calls
    anew for every row, in time exponential in their depth.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def empty(element: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(element))


def outcome(state: Column, emitted: Column) -> Column:
    """What one step of ``fold_emit`` returns."""
    return F.struct(state.alias("state"), emitted.alias("out"))


def fold_emit(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    element: T.DataType,
) -> Column:
    """Left fold over ``items`` returning everything the steps emitted, in order.

    ``step(state, item)`` returns ``outcome(next state, array of emitted values)``.
    """

    def one(acc: Column, item: Column) -> Column:
        return let(
            step(acc["state"], item),
            lambda r: outcome(r["state"], F.concat(acc["out"], r["out"])),
        )

    def run(bound: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(bound))).cast("int")

        def block(acc: Column, first: Column) -> Column:
            # sliced here, not by a transform before, which would copy every item
            return F.aggregate(
                F.slice(bound, first, size),
                outcome(acc["state"], empty(element)),
                one,
                lambda done: outcome(done["state"], F.array_append(acc["out"], done["out"])),
            )

        start = outcome(zero, empty(T.ArrayType(element)))
        firsts = F.sequence(F.lit(1), F.size(bound), size)
        return F.when(
            F.size(bound) > 0, F.flatten(F.aggregate(firsts, start, block)["out"])
        ).otherwise(empty(element))

    return let(items, run)


def running_total(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array."""
    return fold_emit(
        lengths,
        F.lit(0),
        lambda total, n: outcome(total + n, F.array(total)),
        T.IntegerType(),
    )


def text_blocks(text: Column) -> Column:
    """The text cut into fixed-size blocks, so that ``cut`` need not walk from its start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _TEXT_BLOCK), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from zero-based ``start`` of the text behind ``blocks``."""
    first = F.shiftright(start, _TEXT_BITS)
    last = F.shiftright(start + length - 1, _TEXT_BITS)
    window = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    inner = F.substring(window, start.bitwiseAND(_TEXT_BLOCK - 1) + 1, length)
    return F.when((length > 0) & (start >= 0), inner).otherwise(F.lit(""))
