"""License scan: ordered signature rules behind a keyword gate, overlaps settled by priority and containment.

A document stays in one row and nothing is shuffled: its words are cut once, a set intersection with
the rules' keywords says which rules can hold, and only those run, each by one regular expression over
the words.  Matches become intervals of words.  Only SQL functions are used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, FREQUENT, SECTIONS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, digits and non-ASCII of lower-cased text.  As ranges that a word may hold: a negated class of ranges takes ten times as long.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
OPEN, CLOSE = "\x01", "\x02"
SPAN = "struct<label:string,level:int,rule:int,score:double,first:int,last:int>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads text in which each word stands between two blanks of its own; a text without the word ``gate`` has no match."""

    rule: int
    label: str
    level: int
    score: float
    gate: str
    pattern: str


def pattern_of(words: str) -> str:
    """The regular expression of a rule's words (see ``license_rules``)."""
    out = []
    for token in words.split():
        optional, body = token.endswith("?"), token
        body = body[:-1] if optional else body
        body = "[^ ]+" if body == "*" else f"(?:{body.replace('/', '|')})" if "/" in body else body
        out.append(f"(?: {body} )?" if optional else f" {body} ")
    return "".join(out)


def gate_of(words: str) -> str:
    """A word that every match holds: the longest that is not frequent, else the longest."""
    plain = [t for t in words.split() if re.fullmatch("[a-z0-9]+", t)]
    return max(plain, key=lambda t: (t not in FREQUENT, len(t)))


def rules() -> list[Rule]:
    """All rules in order of priority."""
    lines = [(level, score, *line.split(": ", 1)) for level, score, text in SECTIONS for line in text.strip().splitlines()]
    return [Rule(k, label, level, score, gate_of(words), pattern_of(words)) for k, (level, score, label, words) in enumerate(lines)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.transform(F.array(value), use)[0]


def _n_words(text: Column) -> Column:
    """Words in a piece of spaced text: each has two blanks."""
    return F.floor((F.length(text) - F.length(F.translate(text, " ", ""))) / 2).cast("int")


def _spans(text: Column, rule: Column) -> Column:
    """Intervals [first, last] of words that the rule matches."""
    marked = F.split(F.regexp_replace(text, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}")), OPEN)

    def step(s: Column, part: Column) -> Column:
        size = _n_words(F.substring_index(part, CLOSE, 1))
        span = F.struct(rule["label"].alias("label"), rule["level"].alias("level"), rule["rule"].alias("rule"), rule["score"].alias("score"), s["at"].alias("first"), (s["at"] + size - 1).alias("last"))
        return F.struct((s["at"] + _n_words(part)).alias("at"), F.array_append(s["out"], span).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return _let(marked, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.struct(_n_words(p[0]).alias("at"), none.alias("out")), step, lambda s: s["out"]))


def _settled(found: Column, levels: int) -> Column:
    """Without the intervals that lie in one of a higher level, in a longer one of their own, or in an
    equal one of an earlier rule.  Read by start, an interval falls if one before it, of its level or a
    higher one, ends no sooner."""
    keyed = F.transform(found, lambda d: F.struct(d["first"].alias("a"), (-d["last"]).alias("b"), (-d["level"]).alias("c"), d["rule"].alias("d"), d.alias("span")))

    def step(s: Column, k: Column) -> Column:
        d = k["span"]
        ends = F.transform(s["ends"], lambda e, i: F.when((i < d["level"]) & (d["last"] > e), d["last"]).otherwise(e))
        covered = s["ends"][d["level"] - 1] >= d["last"]
        return F.struct(ends.alias("ends"), F.when(covered, s["out"]).otherwise(F.array_append(s["out"], d)).alias("out"))

    start = F.struct(F.array_repeat(F.lit(-1), levels).alias("ends"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(F.array_sort(keyed), start, step, lambda s: s["out"])


def license_spans(text: Column, using: list[Rule] | None = None) -> Column:
    """struct<n_words int, all array<span>, kept array<span>> of a text; a null text has no words.

    ``all`` holds every match in order of rule and place, ``kept`` those that overlaps leave.  A span
    has label, level, rule (its number), score and its first and last word, from 0.
    """
    chosen = rules() if using is None else using
    if not chosen:
        raise ValueError("no rules")
    listed = F.from_json(F.lit(json.dumps([asdict(r) for r in chosen])), "array<struct<rule:int,label:string,level:int,score:double,gate:string,pattern:string>>")
    gates = F.array(*[F.lit(g) for g in sorted({r.gate for r in chosen})])
    none = F.array().cast(f"array<{SPAN}>")

    def scan(words: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        hits = lambda t: _let(F.array_intersect(gates, words), lambda g: F.flatten(F.transform(F.filter(listed, lambda r: F.array_contains(g, r["gate"])), lambda r: _spans(t, r))))
        found = F.when(F.arrays_overlap(words, gates), _let(spaced, hits)).otherwise(none)
        return _let(found, lambda f: F.struct(F.size(words).alias("n_words"), f.alias("all"), F.when(F.size(f) > 0, _settled(f, max(r.level for r in chosen))).otherwise(none).alias("kept")))

    return _let(F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)), scan)


def license_scan(docs: DataFrame, text: str = "text", using: list[Rule] | None = None) -> DataFrame:
    """All columns of the table and ``licenses`` (see ``license_spans``), one row per row.

    Null and empty texts have no words and no spans; repeated rows each get their own; an empty table
    stays empty.  Where the table has a column ``licenses``, the new one gets underscores until it is free.
    """
    name = "licenses"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, license_spans(F.col(f"`{text}`"), using))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of the base phrases), first_word, last_word, base_labels,
    labels (base ones and those of kept spans) and score (the highest of base and kept spans, else 0)."""
    every = rules()
    base = [r.rule for r in every if any(r.pattern == pattern_of(p) and r.label == label for p, label in BASE.items())]
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), license_spans(F.col(f"`{text}`"), every).alias("l"))
    found = found.select("doc_id", F.col("l.n_words").cast("long").alias("n_words"), F.filter("l.all", lambda s: s["rule"].isin(base)).alias("base"), F.col("l.kept").alias("kept"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").cast("long").alias("first_word"), F.array_max("base.first").cast("long").alias("last_word"),
        _joined(F.col("base.label")).alias("base_labels"), _joined(F.concat("base.label", "kept.label")).alias("labels"), F.coalesce(F.array_max(F.concat("base.score", "kept.score")), F.lit(0.0)).alias("score"))
