import re

import pytest
from llm_fixtures import DOCS, documents, edge_documents
from pyspark.sql import functions as F

from tidemark.llm.license_rules import BASE
from tidemark.llm.licenses import Rule, gate_of, license_digest, license_scan, pattern_of, rules

TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\");", "MIT License mit-license, MIT  LICENSE", "GNU General Public License version 3 or later", "cc by-nc-sa 4.0 and CC BY", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated", "gnué general public license", "the GNU General\n * Public\tLicense", "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit license" * 3, "mit license " * 3000, "licenKe İ mit İlicense", "https://creativecommons.org/licenses/by-nc/4.0/ https://www.apache.org/licenses/LICENSE-2.0", "All rights reserved. See the LICENSE file", "no license at all",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spaced = "".join(f" {w} " for w in words)
    spans = []
    for r in rules():
        for m in re.finditer(r.pattern, spaced):
            a = spaced[: m.start()].count(" ") // 2
            spans.append((r, a, a + m[0].count(" ") // 2 - 1))
    kept = [(r, a, b) for r, a, b in spans if not any(
        x <= a and y >= b and (s.level > r.level or s.level == r.level and (y - x > b - a or (x, y) == (a, b) and s.rule < r.rule)) for s, x, y in spans)]
    base = [(label, k) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    scores = [r.score for r, _, _ in kept] + [0.75] * bool(base)
    at = [k for _, k in base]
    join = lambda labels: ",".join(sorted(set(labels)))
    return len(words), len(base), min(at, default=None), max(at, default=None), join(label for label, _ in base), join([label for label, _ in base] + [r.label for r, _, _ in kept]), max(scores, default=0.0)


def test_equals_brute_force(spark):
    rows = edge_documents() + [(500 + k, x, "en", "a", 1) for k, x in enumerate(TEXTS) if len(x) < 10_000]
    got = license_digest(documents(spark, rows, extra=True)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r[0], *brute(r[1]))) for r in rows)


def test_every_rule_finds_its_own_words(spark):
    """Each rule's words are found by it behind its gate: none is dead."""
    samples = []
    for r in rules():
        said = re.sub(r"\(\?: (.*?) \)\?", r" \1 ", r.pattern).replace("[^ ]+", "thing").replace("[cs]", "c")
        samples.append((r.rule, re.sub(r"\(\?:([^|)]*)\|[^)]*\)", r"\1", said)))
    found = spark.createDataFrame(samples, "rule int, text string").transform(license_scan).select("rule", F.col("licenses.all.rule").alias("seen")).collect()
    assert [r.rule for r in found if r.rule not in r.seen] == [] and len(samples) > 300


def test_gates_hold_in_every_match():
    for r in rules():
        assert f" {r.gate} " in re.sub(r"\(\?:[^)]*\)\??", " ", r.pattern), r
    assert pattern_of("a b? c/d *") == " a (?: b )? (?:c|d)  [^ ]+ " and gate_of("the apache license") == "apache"


def test_places_and_containment(spark):
    found = license_scan(spark.createDataFrame([("so the GNU General Public License version 3 and the MIT license", 1)], "text string, n_words int")).first()
    assert found.n_words == 1 and found.licenses.n_words == 12
    assert [(s.label, s.first, s.last) for s in found.licenses.kept] == [("gpl-3.0", 2, 7), ("mit", 10, 11)]
    assert {(s.label, s.first, s.last) for s in found.licenses.all} >= {("gpl", 2, 5), ("gpl", 3, 5), ("gpl-3.0", 2, 7)}


def test_own_rules_and_many_places(spark):
    own = [Rule(0, "x", 1, 0.4, "abc", pattern_of("abc def")), Rule(1, "y", 2, 0.6, "ghi", pattern_of("ghi abc def"))]
    row = license_scan(documents(spark, [(1, "ghi abc def, " * 2000 + "abc def", "en", "a", 1)]), using=own).first().licenses
    assert len(row.all) == 4001 and [(s.label, s.first) for s in row.kept[-2:]] == [("y", 5997), ("x", 6000)] and len(row.kept) == 2001


def test_plan_is_native_and_narrow(spark, capsys):
    license_digest(documents(spark)).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange hashpartitioning", "Join"))


def test_clashing_name_no_rules_and_empty_table(spark):
    assert license_scan(documents(spark).withColumn("Licenses", F.lit(1))).columns[-2:] == ["Licenses", "licenses_"]
    with pytest.raises(ValueError):
        license_scan(documents(spark), using=[])
    assert license_digest(spark.createDataFrame([], DOCS)).collect() == []
