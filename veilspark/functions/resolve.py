"""Overlap resolution and span masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DETECTION
from .arrays import cut, empty, fold_emit, let, outcome, text_blocks
from .labels import mask_label


def span_end(span: Column) -> Column:
    return span["index"] + F.length(span["value"])


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open interval overlap."""
    return (start_a < end_b) & (start_b < end_a)


def resolve_overlaps(spans: Column) -> Column:
    """Keep the leftmost spans: stable sort by index, drop what overlaps a kept span.

    The result is sorted by index.  An empty value overlaps only a span it lies inside.
    """

    def step(kept: Column, item: Column) -> Column:
        solid = item["end"] > item["index"]
        blocked = (item["index"] < kept["end"]) & (solid | (item["index"] > kept["index"]))
        state = F.when(
            ~blocked & solid, F.struct(item["index"].alias("index"), item["end"].alias("end"))
        ).otherwise(kept)
        none = empty(T.IntegerType())
        return outcome(state, F.when(blocked, none).otherwise(F.array(item["no"])))

    def fold(bound: Column) -> Column:
        # numbers only, as items are copied: the ordinal keeps the sort stable and names the span
        order = F.sort_array(
            F.transform(
                bound,
                lambda s, i: F.struct(s["index"].alias("index"), i.alias("no"), span_end(s).alias("end")),
            )
        )
        start = F.struct(F.lit(-1).alias("index"), F.lit(-1).alias("end"))

        def keep(ordered: Column) -> Column:
            # nearly always all are apart, and no fold is needed to see that all stay
            apart = F.forall(
                F.sequence(F.lit(1), F.size(ordered) - 1),
                lambda i: (ordered[i - 1]["end"] <= ordered[i]["index"])
                & (ordered[i - 1]["end"] > ordered[i - 1]["index"]),
            )
            plain = (ordered[0]["index"] >= 0) & apart
            numbers = F.when(plain, F.transform(ordered, lambda x: x["no"])).otherwise(
                fold_emit(ordered, start, step, T.IntegerType())
            )
            return F.transform(numbers, lambda no: bound[no])

        return F.when(F.size(bound) > 1, let(order, keep)).otherwise(bound)

    return let(spans, fold)


def mask_spans(text: Column, spans: Column) -> Column:
    """Replace the spans that survive ``resolve_overlaps`` by their placeholders.

    A surviving span whose value is not what the text has at its place stays in clear, but
    still blocks the spans it overlaps.
    """

    def rebuild(t: Column, kept: Column, blocks: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(
                let(kept[F.greatest(i - 1, F.lit(0))], span_end)
            )
            actual = cut(blocks, span["index"], F.length(span["value"]))
            return F.concat(
                let(before, lambda at: cut(blocks, at, span["index"] - at)),
                let(
                    actual,
                    lambda a: F.when(a == span["value"], mask_label(span["type"])).otherwise(a),
                ),
            )

        tail = let(
            span_end(F.element_at(kept, -1)), lambda at: cut(blocks, at, F.length(t) - at)
        )
        return F.concat(F.array_join(F.transform(kept, piece), ""), tail)

    def masked(t: Column) -> Column:
        return let(
            resolve_overlaps(spans),
            lambda kept: F.when(
                F.size(kept) > 0,
                let(text_blocks(t), lambda blocks: rebuild(t, kept, blocks)),
            ).otherwise(t),
        )

    return let(text, masked)


def span_mappings(spans: Column) -> Column:
    """The (mask, value) pairs span masking records, in order: right to left.

    Spans skipped because the text differs are recorded as well.
    """
    return F.reverse(
        F.transform(
            resolve_overlaps(spans),
            lambda s: F.struct(mask_label(s["type"]).alias("mask"), s["value"].alias("value")),
        )
    )
