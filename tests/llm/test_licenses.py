"""License scans against plain Python, rule by rule, and the defined cases."""

import re

import pytest

from veilspark.llm.license_rules import Rule, parse
from veilspark.llm.licenses import BASE, BASE_LEVEL, CONFIDENCE, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(text, rules):
    words = WORD.findall((text or "").translate(UPPER))
    numbered = "".join(f" {i}:{w} " for i, w in enumerate(words))
    base = sorted(
        (i, label)
        for label, phrase in BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    found = []
    for r in rules:
        for m in re.finditer(r.pattern, numbered):
            places = re.findall(r" ([0-9]+):", m[0])
            found.append((int(places[0]), int(places[-1]) + 1, r.level, r.no, r.label))

    def held(d):
        return any(
            o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2]
            and (o[0] < d[0] or o[1] > d[1] or o[2:4] < d[2:4])
            for o in found
        )

    kept = sorted(d for d in found if not held(d))
    levels = [d[2] for d in kept] + [BASE_LEVEL] * bool(base)
    return (
        len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
        sorted({b[1] for b in base}), sorted({b[1] for b in base} | {d[4] for d in kept}),
        CONFIDENCE[min(levels) - 1] if levels else 0.0, kept,
    )


def run(spark, texts, rules=None):
    rows = [(i, t, "x", 1, ["y"]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id int, text string, labels string, n_words int, seen array<string>")
    got = scan_licenses(table, rules=rules).orderBy("doc_id").collect()
    return [
        (
            r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"],
            sorted((d["start"], d["end"], d["level"], d["rule"], d["label"]) for d in r["detections"]),
        )
        for r in got
    ]


def example(words, choice):
    """One text that a pattern matches: every choice and option taken the ``choice``-th way."""
    out = words
    inner = re.compile(r"\(\?:([^()]*)\)(\?|\{1,12\})?")
    while inner.search(out):
        def pick(m):
            ways = m[1].split("|")
            taken = ways[choice % len(ways)]
            return "" if m[2] == "?" and choice % 2 else taken
        out = inner.sub(pick, out)
    out = out.replace(r"\S+", "wörd").replace("[éÉ]", "é").replace("[cs]", "cs"[choice % 2]).replace("[bc]", "bc"[choice % 2]).replace("[0-9]", "1")
    return re.sub(r"(.)\?", "" if choice % 2 else r"\1", out)


def test_every_rule_is_found_in_its_own_examples(spark):
    """So the gates of each rule are right, and every pattern can match."""
    rules = parse()
    assert len(rules) >= 200 and len({r.words for r in rules}) == len(rules)
    texts = [example(r.words, c).upper() for r in rules for c in range(4)]
    got = run(spark, texts)
    for i, (text, row) in enumerate(zip(texts, got)):
        assert re.search(rules[i // 4].pattern, "".join(f" {n}:{w} " for n, w in enumerate(WORD.findall(text.translate(UPPER)))))
        assert row == brute(text, rules), (rules[i // 4], text)
        assert row[7], (rules[i // 4], text)


def test_phrases_across_marks_and_suppression(spark):
    texts = [
        "MIT-License; the mit\n\nlicense. Mit licenses, LİCENSE mit",
        "Licensed under the GNU Lesser General Public License, version 2.1 or the Apache License, Version 2.0.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "all rights reserved. All Rights Reserved",
        "mit license mit license mit licence",
        "K mit", "submit license", "mit license" + "é", "日本 MIT 日本 License", "MIT日本 License",
    ]
    got = run(spark, texts)
    assert got == [brute(t, parse()) for t in texts]
    assert [r[1] for r in got] == [2, 2, 1, 0, 0, 2, 0, 0, 0, 0, 0]
    assert got[1][4] == ["apache", "gpl"] and {"lgpl-2.1", "apache-2.0"} <= set(got[1][5])
    assert got[3][5] == ["gpl-3.0-or-later"] and got[3][6] == 1.0
    assert len(got[2][7]) == 1


def test_defined_cases(spark):
    rules = parse()
    long = "x " * 30_000 + "mit license " * 3_000 + "spdx license identifier isc " * 500
    texts = [None, "", " \n ", long, "mit license", "mit license"]
    assert run(spark, texts) == [brute(t, rules) for t in texts]
    assert run(spark, []) == []
    assert run(spark, ["mit license"], rules=[]) == [brute("mit license", [])]


def test_equal_intervals_and_levels(spark):
    rules = [
        Rule(0, 4, ("a",), "weak-long", "a b c"),
        Rule(1, 2, ("b",), "strong-short", "b c"),
        Rule(2, 4, ("c",), "inside", "c"),
        Rule(3, 4, ("a",), "same", "a b c"),
        Rule(4, 2, ("c",), "partly", "c d"),
    ]
    got = run(spark, ["a b c d", "c", "b c"], rules)
    assert got == [brute(t, rules) for t in ("a b c d", "c", "b c")]
    assert got[0][5] == ["partly", "strong-short", "weak-long"]


@pytest.mark.parametrize("word", ["Exchange", "Python", "Arrow"])
def test_plan_is_map_only_and_native(spark, word):
    table = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = scan_licenses(table)._jdf.queryExecution().executedPlan().toString()
    assert word not in plan
