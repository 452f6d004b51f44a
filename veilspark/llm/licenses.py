"""License scans: ordered signature rules over words, in DataFrame expressions only.

A text is lower-cased (A-Z only) and split into words.  The words that open a gate of any rule
are looked up first; only a text with one goes further.  There its words are numbered,
``' 0:mit  1:license '``, so that a match of a rule's pattern carries its place with it, and
only rules with a gate among the text's words are tried.

Overlapping detections: one that lies inside another (or has the same words) goes, if the
other is of the same or a stronger level; of equals the earlier rule stays.  The sorted
detections are swept once, with the furthest end so far of every level.

``labels`` has those of the detections left and those of the base phrases, which no detection
suppresses.  ``score`` is the confidence of the strongest level found, a base phrase counting
as a name.

Everything is map-only: no shuffle, no state across rows, and the rules are a literal.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows and ids
are judged one by one; an empty table gives no rows; columns other than the id and the text are
not looked at, so their names cannot clash; texts are scanned whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import empty, fold_emit, let, outcome
from .base import text_or_empty
from .license_rules import Rule, parse

# What separates words once A-Z are lower-cased, and the base phrases.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CONFIDENCE = (1.0, 0.99, 0.95, 0.8, 0.3)  # of levels 1 to 5
BASE_LEVEL = 4
BASE_GATES = ("license",)

_RULE = "array<struct<no:int,level:int,label:string,gates:array<string>,pattern:string>>"
DETECTION = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("rule", T.IntegerType()),
    T.StructField("label", T.StringType()),
])


def _words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, SEPARATOR), lambda w: w != "")


def _rule_table(rules: list[Rule]) -> Column:
    rows = [
        {"no": r.no, "level": r.level, "label": r.label, "gates": r.gates, "pattern": r.pattern}
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE)


def _phrase_starts(numbered: Column, phrase: str) -> Column:
    first, *rest = phrase.split(" ")
    pattern = f" ([0-9]+):{first}" + "".join(f"  [0-9]+:{w}" for w in rest) + " "
    return F.regexp_extract_all(numbered, F.lit(pattern), F.lit(1))


def _place(match: Column, pattern: str) -> Column:
    return F.regexp_extract(match, pattern, 1).cast("int")


def _found(numbered: Column, present: Column, rules: Column) -> Column:
    """All detections, sorted for the sweep: by start, then the longer and stronger first."""
    tried = F.filter(rules, lambda r: F.arrays_overlap(r["gates"], present))

    def of(rule: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(numbered, rule["pattern"], F.lit(0)),
            lambda m: F.struct(
                _place(m, "^ ([0-9]+):").alias("start"),
                (-1 - _place(m, "([0-9]+):[^ ]* $")).alias("minus_end"),
                rule["level"].alias("level"),
                rule["no"].alias("rule"),
                rule["label"].alias("label"),
            ),
        )

    return F.sort_array(F.flatten(F.transform(tried, of)))


def _kept(found: Column, levels: int) -> Column:
    """The detections that no other one of their level or a stronger one holds."""

    def step(ends: Column, d: Column) -> Column:
        end = -d["minus_end"]
        held = F.exists(F.slice(ends, F.lit(1), d["level"]), lambda e: e >= end)
        further = F.transform(
            ends, lambda e, i: F.when(i + 1 == d["level"], F.greatest(e, end)).otherwise(e)
        )
        out = F.struct(d["start"], end.alias("end"), d["level"], d["rule"], d["label"])
        return outcome(further, F.when(held, empty(DETECTION)).otherwise(F.array(out)))

    return fold_emit(found, F.array_repeat(F.lit(-1), levels), step, DETECTION)


def _scan(text: Column, present: Column, rules: list[Rule]) -> Column:
    levels = max((r.level for r in rules), default=1)
    starts = F.array(*[F.lit(name) for name in BASE])

    def judge(numbered: Column) -> Column:
        places = [_phrase_starts(numbered, p) for p in BASE.values()]
        return F.struct(
            F.map_from_arrays(starts, F.array(*places)).alias("base"),
            _kept(_found(numbered, present, _rule_table(rules)), levels).alias("detections"),
        )

    words = _words(F.translate(text, UPPER, LOWER))
    numbered = F.array_join(
        F.transform(words, lambda w, i: F.concat(F.lit(" "), i, F.lit(":"), w, F.lit(" "))), ""
    )
    return let(numbered, judge)


def scan_licenses(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """Per row: id, ``n_words``, ``base`` (label to word places of its phrase), ``detections``,
    ``base_labels``, ``labels``, ``first_word``, ``last_word``, ``n_base``, ``score``."""
    rules = parse() if rules is None else rules
    gates = sorted({*BASE_GATES, *(g for r in rules for g in r.gates)})
    # Full lower case holds every gate that A-Z alone would, and as many words.
    looked = let(
        _words(F.lower("body")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.array_intersect(F.expr(f"array({', '.join(map(repr, gates))})"), w).alias("present"),
        ),
    )
    seen = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("body")).withColumn("seen", looked)
    scan = F.when(
        F.size("seen.present") > 0,
        _scan(F.col("body"), F.col("seen.present"), rules),
    )
    found = seen.select("id", "seen.n_words", scan.alias("scan")).select(
        "id",
        "n_words",
        F.transform_values(
            F.coalesce("scan.base", F.create_map().cast("map<string,array<string>>")),
            lambda k, v: v.cast("array<long>"),
        ).alias("base"),
        F.coalesce("scan.detections", empty(DETECTION)).alias("detections"),
    )
    places = F.flatten(F.map_values("base"))
    base_labels = F.array_sort(F.map_keys(F.map_filter("base", lambda k, v: F.size(v) > 0)))
    labels = F.array_sort(
        F.array_union(base_labels, F.transform("detections", lambda d: d["label"]))
    )
    confidence = F.expr(f"array({', '.join(f'{c}D' for c in CONFIDENCE)})")
    best = F.least(
        F.array_min(F.transform("detections", lambda d: d["level"])),
        F.when(F.size(places) > 0, BASE_LEVEL),
    )
    return found.select(
        F.col("id").alias(id),
        "n_words",
        "base",
        "detections",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        base_labels.alias("base_labels"),
        labels.alias("labels"),
        F.when(best.isNull(), 0.0).otherwise(F.element_at(confidence, best)).alias("score"),
    )
