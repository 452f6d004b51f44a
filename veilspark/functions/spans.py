"""Pattern detectors, detection over all patterns, and the cascade masker.

All of them are column expressions over one text: they need no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DETECTION
from .arrays import empty, let, running_total
from .labels import mask_for, mask_label
from .patterns import DIGITS, KEYWORDS, PATTERN_NAMES, SCANS, java_pattern

# Private-use characters set around each match.  No pattern can match them.
_OPEN, _CLOSE = "\uE000", "\uE001"

def _gates(text: Column) -> Column:
    """One flag per pattern, false where the pattern certainly has no match."""

    def flags(digits: Column, keyword: Column) -> Column:
        fields = []
        for name in PATTERN_NAMES:
            scan = SCANS[name]
            flag = keyword if scan.keyword else digits if scan.digits else F.lit(True)
            if scan.literal:
                flag = flag & text.contains(scan.literal)
            if scan.gate:
                flag = flag & text.rlike(scan.gate)
            fields.append(flag.alias(name))
        return F.struct(*fields)

    return let(
        text.rlike(DIGITS),
        lambda digits: let(
            digits & text.rlike(KEYWORDS), lambda keyword: flags(digits, keyword)
        ),
    )


def _with_gates(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(text, lambda t: let(_gates(t), lambda gates: body(t, gates)))


def _marked(text: Column, gate: Column, name: str) -> Column:
    """Pattern name and the text with its matches marked; a null text if there is none."""
    hit = gate & text.rlike(java_pattern(name))
    marked = F.regexp_replace(text, java_pattern(name), f"{_OPEN}$0{_CLOSE}")
    return F.struct(F.lit(name).alias("type"), F.when(hit, marked).alias("marked"))


def _unmarked(marks: Column) -> Column:
    """Spans of an array of marked texts, one after another."""

    def spans(mark: Column, parts: Column, at: Column) -> Column:
        return F.transform(
            F.slice(parts, 2, F.size(parts) - 1),
            lambda part, i: F.struct(
                mark["type"].alias("type"),
                F.substring_index(part, _CLOSE, 1).alias("value"),
                # every earlier match left one closing mark in the running length
                (at[i + 1] - i).alias("index"),
                F.lit("regex").alias("source"),
                F.lit(1.0).alias("confidence"),
            ),
        )

    def build(mark: Column) -> Column:
        return let(
            F.split(mark["marked"], _OPEN),
            lambda parts: let(
                running_total(F.transform(parts, F.length)), lambda at: spans(mark, parts, at)
            ),
        )

    found = F.filter(marks, lambda m: m["marked"].isNotNull())
    return F.coalesce(F.flatten(F.transform(found, build)), empty(DETECTION))


def _without_marks(text: Column) -> Column:
    """The text, with any marks it may itself contain replaced by another symbol."""
    return F.when(
        text.contains(_OPEN) | text.contains(_CLOSE),
        F.translate(text, _OPEN + _CLOSE, "\uFFFD\uFFFD"),
    ).otherwise(text)


def find_spans(text: Column, name: str) -> Column:
    """All non-overlapping matches of one pattern, left to right."""
    return _with_gates(
        _without_marks(text), lambda t, gates: _unmarked(F.array(_marked(t, gates[name], name)))
    )


def detect_regex(text: Column) -> Column:
    """Matches of every pattern in priority order; overlaps are kept."""
    return _with_gates(
        _without_marks(text),
        lambda t, gates: _unmarked(F.array(*[_marked(t, gates[n], n) for n in PATTERN_NAMES])),
    )


def has_pattern(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(java_pattern(name)), F.lit(False))


def _any(text: Column, gates: Column) -> Column:
    found = F.lit(False)
    for name in PATTERN_NAMES:
        found = found | (gates[name] & text.rlike(java_pattern(name)))
    return F.coalesce(found, F.lit(False))


def has_pii(text: Column) -> Column:
    """True as soon as one pattern matches."""
    return _with_gates(text, _any)


def first_pii_type(text: Column) -> Column:
    """Name of the first pattern, in priority order, that matches; null if none does."""

    def chain(t: Column, gates: Column) -> Column:
        found = F.when(F.lit(False), F.lit(""))
        for name in PATTERN_NAMES:
            found = found.when(gates[name] & t.rlike(java_pattern(name)), F.lit(name))
        return found

    return _with_gates(text, chain)


def mask_cascade(text: Column) -> Column:
    """Replace the patterns one after another, each in the text the former ones left.

    The gates of the original text stay valid for the masked one: placeholders contain no
    digits, and their letters never start at a word boundary that a pattern could use.
    """

    def chain(t: Column, gates: Column) -> Column:
        def step(current: Column, names: tuple[str, ...]) -> Column:
            if not names:
                return current
            name = names[0]
            replaced = F.when(
                gates[name], F.regexp_replace(current, java_pattern(name), mask_for(name))
            ).otherwise(current)
            return let(replaced, lambda after: step(after, names[1:]))

        return F.when(_any(t, gates), step(t, PATTERN_NAMES)).otherwise(t)

    return _with_gates(text, chain)


def cascade_mappings(text: Column) -> Column:
    """The (mask, value) pairs the cascade masker replaces, in the order it does so."""

    def chain(t: Column, gates: Column) -> Column:
        def step(current: Column, marks: list[Column], names: tuple[str, ...]) -> Column:
            if not names:
                return _unmarked(F.array(*marks))
            name = names[0]
            after = F.when(
                gates[name], F.regexp_replace(current, java_pattern(name), mask_for(name))
            ).otherwise(current)
            seen = marks + [_marked(current, gates[name], name)]
            return let(after, lambda nxt: step(nxt, seen, names[1:]))

        return F.when(_any(t, gates), step(t, [], PATTERN_NAMES)).otherwise(empty(DETECTION))

    return F.transform(
        _with_gates(_without_marks(text), chain),
        lambda s: F.struct(mask_label(s["type"]).alias("mask"), s["value"].alias("value")),
    )
