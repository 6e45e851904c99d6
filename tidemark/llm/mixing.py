"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents.  The
whole part is taken; the fractional parts are settled in pairs: words move from one document of a
pair to the other, at random in the direction that keeps both expectations, until one fraction is
0 or 1.  The words of a source are kept by every move, so what the mix takes from a source differs
from its target by the rounding of one last document.  Pairs are settled in leaves of bounded size;
the one fraction that each leaf leaves over goes up a tree with a fixed fan-in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

WORD = r"[^\x20\x09-\x0D]+"
LEAF_ROWS = 4096
FAN_IN = 64
RESERVE_ROWS = 256
EDGE = 1e-12


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, rows, target) from (source, size).  Sources in code point order, null
    last, take the weights in turn; a target above ``most`` times its source's size is cut there and
    the excess is shared by weight among the others: target = min(cap, level x weight) with the one
    level that adds up.  The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_full", F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_full", F.col("_cap") / F.col("_w"))
    everything, rest = Window.partitionBy(), by_fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
    done = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("_level", (F.col("_total") - done) / F.sum("_w").over(rest)).withColumn("_at", F.row_number().over(by_fill))
    first = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_at", "_level"))).over(everything)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(first * F.col("_w"), F.col("_cap")))
    return per.select("source", "source_size", "rows", target.alias("target"))


def duel(size_a: float, p_a: float, size_b: float, p_b: float, u: float) -> tuple[float, float]:
    """Move words between two fractions until one is 0 or 1, keeping both expectations and the sum of size x fraction."""
    up = min(size_a * (1 - p_a), size_b * p_b)
    down = min(size_a * p_a, size_b * (1 - p_b))
    step = up if u * (up + down) < down else -down
    return p_a + step / size_a, p_b - step / size_b


def settled(p: float) -> float | None:
    return 0.0 if p <= EDGE else 1.0 if p >= 1 - EDGE else None


def chain(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int:
    """Settle all but at most one fraction by duels, largest documents first; its index, or -1.  ``p`` is changed."""
    draws, left = rng.random(len(p)), -1
    for i in range(len(p)):
        if settled(p[i]) is not None:
            p[i] = settled(p[i])
            continue
        if left < 0:
            left = i
            continue
        a, b = duel(sizes[left], p[left], sizes[i], p[i], draws[i])
        p[left], p[i] = (x if settled(x) is None else settled(x) for x in (a, b))
        left = left if 0 < p[left] < 1 else i if 0 < p[i] < 1 else -1
    return left


def spread(sizes: np.ndarray, p: np.ndarray, first: int, rng: np.random.Generator) -> None:
    """Settle all fractions: ``first`` (or -1) and then the largest document, each against the whole
    group of smaller ones, which share one fraction, so that the last rounding is of a small document.
    A document that the group can't settle in both directions waits; those that waited settle one
    another, and the last one's fraction is rounded to the nearest, the only step that moves a sum."""
    rest = [i for i in range(len(p)) if i != first and 0 < p[i] < 1]
    order = ([first] if first >= 0 else []) + rest
    words = np.concatenate([np.cumsum(sizes[order][::-1])[::-1], [0.0]])
    q, draws, waits = p[rest[0]] if rest else 0.0, rng.random(len(order)), []
    for k, i in enumerate(order):
        mine, group = (p[i] if i == first else q), words[k + 1]
        if settled(mine) is None and group * q >= sizes[i] * (1 - mine) and group * (1 - q) >= sizes[i] * mine:
            mine, q = duel(sizes[i], mine, group, q, draws[k])
        p[i] = mine if settled(mine) is None else settled(mine)
        q = q if settled(q) is None else settled(q)
        if 0 < p[i] < 1:
            waits.append(i)
    if waits:
        part = p[waits]
        chain(sizes[waits], part, rng)
        p[waits] = part
    p[:] = np.round(p)


def _settle(level: int, last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["reserve", "size", "doc_id", "tie"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{pdf.source[0]}/{pdf.node[0]}".encode()))
        sizes, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float).copy()
        plain = (~pdf["reserve"]).to_numpy()
        head = int(plain.sum())
        part = p[:head].copy()
        left = chain(sizes[:head], part, rng) if head else -1
        p[:head] = part
        if last:
            spread(sizes, p, left, rng)
        pdf["p"] = p
        pdf["open"] = [0 < x < 1 for x in p]
        return pdf

    return run


ROW = "doc_id long, tie long, source string, size long, source_size long, target double, whole long, p double, reserve boolean, node long, open boolean"


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 17) -> DataFrame:
    """Copies of each document in the mix: doc_id, tie (a hash of its text), source, size, source_size, target, copies.

    A null text has size 0 and, like any document without words, no copies.  Null sources are one
    source, last in order; null doc_ids are kept as they are.  Rows with the same doc_id, text and
    source are settled one by one; which of them gets a copy makes no difference.  Other columns are
    not looked at.  An empty table gives no rows.  Draws depend on the rows alone, so reruns agree.
    Only ids, hashes and sizes are shuffled; a source of any size is cut into leaves.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
    )
    base = kept(base, "mix-sizes")
    targets = kept(source_targets(base, weights=weights, share=share, most=most), "mix-targets")
    largest = targets.agg(F.max("rows")).first()[0] or 0
    spot = F.xxhash64(F.lit(seed), "doc_id", "tie")
    leaves = F.ceil(F.col("rows") / LEAF_ROWS).cast("long")
    rows = base.join(targets, base.source.eqNullSafe(targets.source)).drop(targets.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_r", F.when(F.col("size") > 0, ratio).otherwise(0.0)).withColumn("whole", F.floor(F.col("_r") + EDGE).cast("long"))
    reserve = (leaves <= 1) | (F.pmod(F.shiftright(spot, 20), F.lit(1 << 30)) < F.lit(float(RESERVE_ROWS << 30)) / F.col("rows"))
    rows = rows.select(
        "doc_id", "tie", "source", "size", "source_size", "target", "whole", F.greatest(F.col("_r") - F.col("whole"), F.lit(0.0)).alias("p"), reserve.alias("reserve"),
        F.when(leaves <= 1, 0).otherwise(F.pmod(spot, leaves)).cast("long").alias("node"), F.lit(True).alias("open"),
    )
    done, nodes, level = [], -(-largest // LEAF_ROWS), 0
    while True:
        last = nodes <= 1
        if last:
            rows = rows.withColumn("node", F.lit(0).cast("long"))
        waits = None if last else rows.where("reserve")
        out = (rows if last else rows.where("NOT reserve")).groupBy("source", "node").applyInPandas(_settle(level, last, seed), ROW)
        out = kept(out, f"mix-level-{level}")
        done.append(out.where("NOT open"))
        if last:
            break
        rows = out.where("open").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).unionByName(waits)
        nodes, level = -(-nodes // FAN_IN), level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("doc_id", "tie", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each repeated as often as it was drawn, with all columns.

    Joined by a hash of doc_id, text hash and source, and by these themselves, so the texts are shuffled
    once.  Rows equal in all three are numbered, and the first ones take the larger draws.
    """
    key, most = ["__id", "__tie", "__source"], int(np.ceil(options.get("most", 3.0)))
    drawn = mixed_sizes(docs, doc_id, text, source, **options).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"), "copies")
    right = drawn.groupBy(*key).agg(*[F.count_if(F.col("copies") >= k).alias(f"__g{k}") for k in range(1, most + 1)]).withColumn("__key", F.xxhash64(*key))
    right = right.toDF(*[c if c.startswith("__g") else f"__r{c}" for c in right.columns])
    left = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__tie": F.xxhash64(F.col(text)), "__source": F.col(source).cast("string")}).withColumn("__key", F.xxhash64(*key))
    same = left["__key"] == right["__r__key"]
    for c in key:
        same = same & left[c].eqNullSafe(right[f"__r{c}"])
    rows = left.join(right, same).withColumn("__row", F.row_number().over(Window.partitionBy("__key", *key).orderBy(F.lit(1))))
    copies = sum((F.when(F.col("__row") <= F.col(f"__g{k}"), 1).otherwise(0) for k in range(1, most + 1)), F.lit(0))
    return rows.withColumn("__n", copies).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
