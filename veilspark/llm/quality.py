"""Quality rules: decision lists learned from labels, in DataFrame expressions only.

``text_statistics`` counts, per text, what the rules look at.  ``learn_rules`` grows and
prunes conjunctions of thresholds by sequential covering: every step is an aggregation of
the labelled rows into a histogram of a fixed size, from which the driver picks the next
condition.  ``verdict`` turns the ordered rules into one conditional expression.

The learner sees at most ``labelled_rows`` rows of the labels (20,000 by default), chosen by
a hash of their id; everything else covers all rows.

Defined cases: a null text has no words and fails the base rule; documents without a label
are judged like all others; a document labelled twice counts once, with its worst label;
without labels of both kinds no rule is learned and the base rule alone decides; an empty
table gives no rows; repeated rows are judged one by one; other columns are kept, those of
the statistics are prefixed to stay clear of theirs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .base import SPACE, python_words, staged, text_or_empty

P = "_q_"  # prefix of the columns added beside a document's own
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_upper", "n_digits", "n_marks",
)
WINDOW = 8


def _kept_only(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the class, counted."""
    return F.length(F.regexp_replace(text, f"[^{chars}]++", "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in the text."""

    def pairs(h: Column, step: int) -> Column:
        return F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))),
            F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )

    def covered(w: Column) -> Column:
        at = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        F.get(s, i + 1)["h"].eqNullSafe(x["h"])
                        | F.get(s, i - 1)["h"].eqNullSafe(x["h"]),
                        x["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return F.sort_array(again)

        def total(p: Column) -> Column:
            lengths = F.transform(
                p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))
            )
            return F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)

        return let(let(at, starts), total)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    h1 = F.transform(words, lambda x: F.xxhash64(x))
    h8 = let(h1, lambda a: let(pairs(a, 1), lambda b: let(pairs(b, 2), lambda c: pairs(c, 4))))
    return let(h8, count).cast("long")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and, prefixed with ``P``, the counts named in ``COUNTS``."""
    body = text_or_empty(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counts = let(
        python_words(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")),
    )
    line_counts = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"),
        ),
    )
    wide = docs.withColumns({P + "w": counts, P + "l": line_counts})
    return wide.withColumns({
        P + "n_words": F.col(P + "w.n"),
        P + "word_chars": F.length(body) - _kept_only(body, SPACE),
        P + "n_symbols": _kept_only(body, r"#*$%&|<>"),
        P + "n_dup_lines": F.col(P + "l.d"),
        P + "n_repeat_words": F.col(P + "w.r"),
        P + "n_lines": F.col(P + "l.n"),
        P + "n_upper": _kept_only(body, "A-Z"),
        P + "n_digits": _kept_only(body, "0-9"),
        P + "n_marks": _kept_only(body, "!?"),
    }).drop(P + "w", P + "l")


def base_failed() -> Column:
    n = F.col(P + "n_words")
    return (n < 20) | (100 * F.col(P + "n_repeat_words") > 30 * n)


def features() -> dict[str, Column]:
    """Ratios the rules put thresholds on."""
    c = {name: F.col(P + name).cast("double") for name in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))
    chars = F.greatest(c["word_chars"], F.lit(1.0))
    lines = F.greatest(c["n_lines"], F.lit(1.0))
    return {
        "words": c["n_words"],
        "word_length": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words,
        "dup_lines": c["n_dup_lines"] / lines,
        "repeats": c["n_repeat_words"] / words,
        "line_words": c["n_words"] / lines,
        "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "marks": c["n_marks"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at least the threshold, or else below it
    threshold: float

    def holds(self, value: Column) -> Column:
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def labelled_sample(labels: DataFrame, labelled_rows: int) -> DataFrame:
    """At most so many labelled ids, ``doc_id`` and ``bad``, chosen by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    each = known.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)


def _holds(rule: Rule, at: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(at[c.feature])
    return out


def learn_rules(
    examples: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 3,
    bins: int = 24,
    precision: float = 0.9,
    least: int = 5,
) -> list[Rule]:
    """Rules for ``bad`` rows, best found first.  ``examples``: ``doc_id``, ``bad``, the features.

    Two thirds of the rows grow rules, one third prunes them: of the prefixes of a grown
    rule that with the best (p - n) / (p + n) stays, and only if it is right for the share
    ``precision`` of the ``least`` rows or more that it covers there.
    """
    names = list(features())
    at = {n: F.col(n) for n in names}
    grow_part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) != 0
    steps = [i / bins for i in range(1, bins)]
    quantiles = examples.groupBy("bad").agg(
        *[F.percentile_approx(n, F.lit(steps), 2000).alias(n) for n in names]
    )
    found = {bool(r["bad"]): r for r in quantiles.collect()}  # two rows
    if len(found) < 2:
        return []
    cuts = {n: sorted({*found[True][n], *found[False][n]}) for n in names}

    def place(i: int, n: str) -> Column:
        below = F.filter(F.array(*map(F.lit, cuts[n])), lambda t: t <= at[n])
        return F.struct(F.lit(i).alias("f"), F.size(below).alias("b"))

    items = F.array(*[place(i, n) for i, n in enumerate(names)])

    def histogram(where: Column) -> dict[int, list[list[int]]]:
        """For each feature and bin, good and bad rows.  At most features x bins x 2 rows."""
        counted = examples.where(where).select("bad", F.explode(items).alias("x"))
        table = {i: [[0, 0] for _ in range(len(cuts[n]) + 1)] for i, n in enumerate(names)}
        for r in counted.groupBy("x.f", "x.b", "bad").count().collect():
            table[r["f"]][r["b"]][bool(r["bad"])] += r["count"]
        return table

    rules: list[Rule] = []
    open_rows = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            table = histogram(grow_part & open_rows & _holds(rule, at))
            good, bad = (sum(b[k] for b in table[0]) for k in (0, 1))
            if not bad or (rule and not good):
                break
            start = math.log2(bad / (bad + good))
            best = (0.0, None)
            for i, n in enumerate(names):
                low = [0, 0]
                for b, cut in enumerate(cuts[n]):
                    low = [low[0] + table[i][b][0], low[1] + table[i][b][1]]
                    for above, (g, p) in ((True, (good - low[0], bad - low[1])), (False, low)):
                        if p >= least:
                            gain = p * (math.log2(p / (p + g)) - start)
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(n, above, float(cut)))
            if best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        counts = examples.where(~grow_part & open_rows).agg(*[
            F.count_if(_holds(rule[: k + 1], at) & (F.col("bad") == F.lit(b))).alias(f"{'gp'[b]}{k}")
            for k in range(len(rule)) for b in (False, True)
        ]).first()
        worth = [
            ((counts[f"p{k}"] - counts[f"g{k}"]) / max(1, counts[f"p{k}"] + counts[f"g{k}"]), -k)
            for k in range(len(rule))
        ]
        k = -max(worth)[1]
        p, g = counts[f"p{k}"], counts[f"g{k}"]
        if p + g < least or p < precision * (p + g):
            break
        rules.append(rule[: k + 1])
        open_rows = open_rows & ~_holds(rules[-1], at)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Whether a document with statistics is kept: the base rule, then the rules in order."""
    at = features()
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(_holds(rule, at), F.lit(False))
    return out.otherwise(F.lit(True))


def fit_quality_rules(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = 20_000, **options
) -> list[Rule]:
    """Rules learned from the labelled documents; at most ``labelled_rows`` are looked at."""
    # ids and a flag of at most labelled_rows rows: 24 bytes each
    sample = F.broadcast(labelled_sample(labels, labelled_rows))
    known = docs.select("doc_id", "text").join(sample, "doc_id")
    at = features()
    examples = text_statistics(known).where(~base_failed())
    examples = examples.select("doc_id", "bad", *[at[n].alias(n) for n in at])
    return learn_rules(staged(examples, "quality-examples"), **options)


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns with the statistics, ``base_failed`` and ``kept``, prefixed with ``P``.

    Columns that are called so already are replaced.
    """
    wide = text_statistics(docs).withColumn(P + "base_failed", base_failed())
    return wide.withColumn(P + "kept", verdict(rules))
