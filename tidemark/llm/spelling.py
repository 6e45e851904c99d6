"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Two words, the longer of L code points, are one edit apart exactly if their common prefix and their
common suffix together reach L - 1.  So the one or the other reaches half of L, and near words share a
group: the words of L and of L - 1 code points with the same first, or the same last, L // 2.  The words
of a group are rows of a padded matrix of code points; matrices are compared row by row with themselves,
a tile at a time, which gives prefix and suffix of every pair.

A group of more than ``tile`` words is cut again by the same rule on what its words have not in
common.  The cuts end where one place is left, and such a group has no more words than the alphabet has
letters: every tile is bounded, no pair is left out, and each pair is met in one group only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_ranges, drop, groups_of, kept

RUN, TILE, RATIO = r"[A-Za-zÀ-ÿ]+", 256, 10
CELLS = 1 << 18
#: Keys of at least this many rows go to their finer groups at once, not through one task.
HOT_ROWS, HOT_KEYS = 100_000, 100
GROUP = "key long, band int, lo int, hi int, cap int"


# ---------------------------------------------------------------- words


def document_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", run: str = RUN, shortest: int = 7, least: int = 2, delete_one_in: int = 31) -> DataFrame:
    """(word, n): the runs of letters in whole texts, A-Z lower-cased, that have at least ``shortest`` code
    points and stand at least ``least`` times.

    Where ``delete_one_in`` divides the unsigned crc32 h of ``<doc_id>:<run>``, the run loses its code
    point h % length first (0: no run does).  A null text has no runs, a null doc_id is an empty string
    there; repeated rows count again; other columns are not read.
    """
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(run.removesuffix("+") + f"{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"))
    if delete_one_in:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % delete_one_in == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- groups


def _cut(rows: DataFrame) -> DataFrame:
    """Each row in its two finer groups.  ``lo`` and ``hi`` are the lengths of the shared head and tail,
    ``cap`` the common prefix from which on a pair belongs to the sister group."""
    half = F.floor((F.col("band") - F.col("lo") - F.col("hi")) / 2).cast("int")
    head = F.substring("word", F.col("lo") + 1, half)
    tail = F.substring("word", F.length("word") - F.col("hi") - half + 1, half)
    sides = F.array(
        F.struct(F.xxhash64("key", F.lit("head"), head).alias("key"), (F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.col("cap").alias("cap")),
        F.struct(F.xxhash64("key", F.lit("tail"), tail).alias("key"), F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi"), F.least("cap", F.col("lo") + half).alias("cap")))
    return rows.select("word", "n", "band", F.explode(sides).alias("s")).select("s.key", "band", "s.lo", "s.hi", "s.cap", "word", "n")


def _first(words: DataFrame) -> DataFrame:
    """Words as the longer ones of a band and as the shorter ones of the next."""
    band = F.explode(F.array(F.length("word"), F.length("word") + 1))
    return words.select("word", "n", band.alias("band")).select(F.col("band").cast("long").alias("key"), "band", F.lit(0).alias("lo"), F.lit(0).alias("hi"), (F.col("band") + 1).alias("cap"), "word", "n")


# ---------------------------------------------------------------- tiles


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after another, and where each string starts (the end last)."""
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    lead = (raw & 0xC0) != 0x80
    starts = np.concatenate([[0], np.cumsum(lead)])[offs - offs[0]]
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), starts


def _pairs(points: np.ndarray, starts: np.ndarray, members: np.ndarray, bounds: np.ndarray, band: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all near pairs of these groups of one band; ``members[bounds[g]:bounds[g + 1]]`` are the
    rows of group g, ``limits`` its (lo, hi, cap).  The groups stand side by side as equal tiles."""
    sizes = np.diff(bounds)
    side = int(sizes.max())
    slot = np.repeat(np.arange(len(sizes)) * side, sizes) + concat_ranges(np.zeros(len(sizes), np.int64), sizes)
    row = np.full(len(sizes) * side, -1)
    row[slot] = members
    length = np.diff(starts)[members]
    at = np.repeat(starts[members], length)
    step = concat_ranges(np.zeros(len(members), np.int64), length)
    kind = np.uint8 if int(points.max()) < 255 else np.uint32
    value = (points[at + step] + np.uint32(1)).astype(kind)  # 0 pads
    tall = np.zeros((2, band, len(row)), kind)
    tall[0, step, np.repeat(slot, length)] = value
    tall[1, np.repeat(length, length) - 1 - step, np.repeat(slot, length)] = value
    tall = tall.reshape(2, band, len(sizes), side)
    size = np.zeros(len(row), np.int32)
    size[slot] = length
    size = size.reshape(len(sizes), side)
    left, right = [], []
    block = max(1, CELLS // side)  # rows of a tile that are compared at once
    for a in range(0, side, block):
        b = min(side, a + block)
        for g in range(0, len(sizes), max(1, CELLS // ((b - a) * side))):
            h = min(len(sizes), g + max(1, CELLS // ((b - a) * side)))
            common = []
            for half in tall:
                run = np.zeros((h - g, b - a, side), np.int32 if band > 250 else np.uint8)
                alive = np.ones(run.shape, bool)
                for plane in half:
                    alive &= plane[g:h, a:b, None] == plane[g:h, None, :]
                    if not alive.any():
                        break
                    run += alive
                common.append(run.astype(np.int32))
            lo, hi, cap = (limits[g:h, k][:, None, None] for k in range(3))
            ok = (common[0] + common[1] >= band - 1) & (common[0] >= lo) & (common[1] >= hi) & (common[0] < cap)
            ok &= np.maximum(size[g:h, a:b, None], size[g:h, None, :]) == band
            ok &= (np.minimum(size[g:h, a:b, None], size[g:h, None, :]) > 0) & (np.arange(a, b)[:, None] < np.arange(side)[None, :])
            of, i, j = np.nonzero(ok)
            left.append(row[(of + g) * side + i + a])
            right.append(row[(of + g) * side + j])
    return np.concatenate(left), np.concatenate(right)


def _tiles(tile: int):
    """Task: rows sorted by key in; out come, per word and batch, the number of near words and the best of
    them, and the rows of groups that are still too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, passing = None, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            key = now.column("key").to_numpy()
            if passing is not None:
                n = int(np.searchsorted(key, passing, side="right"))
                yield from _large(now.slice(0, n))
                now, passing = now.slice(n), passing if n == len(key) else None
            if carry is not None:
                now = pa.concat_tables([carry, now])
            if not len(now):
                continue
            now = now.combine_chunks()
            cuts = groups_of(now.column("key").to_numpy())
            last = now.slice(int(cuts[-2]))
            band, lo, hi = (last.column(k)[0].as_py() for k in ("band", "lo", "hi"))
            if len(last) > tile and band - lo - hi > 1:
                passing, carry = last.column("key").to_numpy()[0], None
                yield from _large(last)
            else:
                carry = last
            yield from _done(now.slice(0, int(cuts[-2])), cuts[:-1], tile)
        if carry is not None:
            yield from _done(carry.combine_chunks(), np.array([0, len(carry)]), tile)

    return run


NEAR = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("cap", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _large(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if len(rows):
        for name, kind in (("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())):
            rows = rows.append_column(name, pa.nulls(len(rows), kind))
        yield from rows.cast(NEAR).combine_chunks().to_batches()


def _done(rows: pa.Table, cuts: np.ndarray, tile: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    rows = rows.combine_chunks()
    sizes = np.diff(cuts)
    band, lo, hi, cap = (rows.column(k).to_numpy() for k in ("band", "lo", "hi", "cap"))
    first = cuts[:-1]
    large = (sizes > tile) & (band[first] - lo[first] - hi[first] > 1)
    yield from _large(rows.take(pa.array(concat_ranges(first[large], sizes[large]))))
    points, starts = code_points(rows.column("word").chunk(0))
    shape = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    left, right = [], []
    todo = np.flatnonzero(~large & (sizes > 1))
    order = todo[np.lexsort((shape[todo], band[first[todo]]))]
    runs = groups_of(band[first[order]].astype(np.int64) << 8 | shape[order]) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(runs[:-1], runs[1:], strict=True):
        some = order[a:b]
        members = concat_ranges(first[some], sizes[some])
        limits = np.stack([lo[first[some]], hi[first[some]], cap[first[some]]], axis=1)
        i, j = _pairs(points, starts, members, np.concatenate([[0], np.cumsum(sizes[some])]), int(band[first[some[0]]]), limits)
        left += [i, j]
        right += [j, i]
    if not left or not sum(map(len, left)):
        return
    i, j = np.concatenate(left), np.concatenate(right)
    n = rows.column("n").to_numpy()
    rank = np.empty(len(rows), np.int64)
    rank[pc.sort_indices(rows.column("word")).to_numpy()] = np.arange(len(rows))
    code = pc.dictionary_encode(rows.column("word").chunk(0)).indices.to_numpy()
    order = np.lexsort((rank[j], -n[j], code[i]))
    i, j = i[order], j[order]
    cuts = groups_of(code[i])
    own, best = pa.array(i[cuts[:-1]]), pa.array(j[cuts[:-1]])
    word, count = rows.column("word"), rows.column("n")
    yield from pa.table({**{k: pa.nulls(len(own), NEAR.field(k).type) for k in ("key", "band", "lo", "hi", "cap")}, "word": word.take(own), "n": count.take(own),
                         "n_near": pa.array(np.diff(cuts)), "form": word.take(best), "form_n": count.take(best)}).cast(NEAR).combine_chunks().to_batches()


# ---------------------------------------------------------------- the operator


def _hot(rows: DataFrame) -> list[int]:
    """Keys with very many rows, by a mergeable sketch of bounded size.  Only the place of work depends on them."""
    found = rows.agg(F.expr(f"approx_top_k(key, {HOT_KEYS}, {100 * HOT_KEYS})").alias("top")).first().top
    return [r.item for r in found if r["count"] >= HOT_ROWS]


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table of distinct words of at least two code points: the number of near
    words, and of them the one of largest n, ties to the smallest in code-point order (nulls: none)."""
    words = words.select("word", "n")
    level, found, scratch = _cut(_first(words)), [], []
    for _ in range(64):  # a cut halves what is left of a word; a string has fewer than 2 ** 64 code points
        hot = _hot(level)
        at_once = F.col("key").isin(hot) & (F.col("band") - F.col("lo") - F.col("hi") > 1) if hot else F.lit(False)
        out = kept(level.where(~at_once).repartition("key").sortWithinPartitions("key").mapInArrow(_tiles(tile), GROUP + ", word string, n long, n_near long, form string, form_n long"), "tiles")
        scratch.append(out)
        found.append(out.where("key IS NULL").select("word", "n", "n_near", "form", "form_n"))
        large = out.where("key IS NOT NULL").select("key", "band", "lo", "hi", "cap", "word", "n")
        if hot:
            large = large.unionByName(level.where(at_once))
        elif large.isEmpty():
            break
        level = _cut(large)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    for part in found:
        every = every.unionByName(part)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    result = kept(every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    drop(*scratch)
    return result


def spelling_variants(words: DataFrame, *, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is its near word of largest n (ties: smallest
    in code-point order), if that is at least ``ratio`` times the word's own n, else null; its root is
    the last of the forms that follow from it, the word itself if there is none.

    ``words`` has one row per word (at least two code points) and n >= 1; an empty table gives none.  As n
    grows ``ratio``-fold with every form, a chain is no longer than its logarithm, and doubling ends it.
    """
    near = near_words(words, tile)
    counts = F.col("form_n") >= ratio * F.col("n")
    near = near.select("word", "n", "n_near", F.when(counts, F.col("form")).alias("form"), F.when(counts, F.col("form_n")).alias("form_n"))
    root = kept(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "root")
    most = near.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio)))) if ratio > 1 else 0):
        last, root = root, kept(root.join(root.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "root")
        drop(last)
    return near.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
