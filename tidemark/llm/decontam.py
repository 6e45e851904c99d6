"""Benchmark decontamination with a positional inverted index that is split by documents.

Each shard of the index is one row: the sorted terms (64-bit word hashes) of a run of documents and,
per term, the sorted positions where it stands.  Test phrases are sent to all shards in blocks of
bounded size.  In a shard a phrase takes the postings of its rarest term, shifted to the phrase's
start, and intersects them with the postings of the next rarest, until none is left or all terms
agree.  With ``slack`` a term may stand that many words from its place (proximity).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_WORD, LOWER, binary, concat_ranges, drop, groups_of, kept, text_slices, word_bounds, word_hashes

#: Words of a phrase; positions left free between documents, so that no match crosses them.
WINDOW = 13
GAP = 128
BLOCK_WORDS = 1 << 20
CANDIDATES = 1 << 20
INDEX = "shard string, ids array<bigint>, marks array<bigint>, first binary, words binary, terms binary, at binary, places binary"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: ids of its documents, first position and number of words of each, and the
    postings.  Lower-cases A-Z; words are runs of letters, digits and non-ASCII.  A null text has no
    words; ids may be null or repeat.  Nothing is shuffled; the
    index is stored in the shared folder, so that all searches see the same shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "text"):
                low = LOWER[raw]
                starts, ends, first = word_bounds(low, offs, LETTER_WORD)
                words = np.diff(first)
                hashes = word_hashes(low, starts, ends)
                rows = np.arange(len(words), dtype=np.int64)
                place = np.arange(len(hashes), dtype=np.int64) + np.repeat(rows * GAP, words)
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                at = groups_of(ordered)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{number}"]), _list(batch.column(0)[i:j]), _list(batch.column(1)[i:j]), binary([first[:-1] + rows * GAP]), binary([words.astype(np.int32)]),
                     binary([ordered[at[:-1]]]), binary([at.astype(np.int32)]), binary([place[order].astype(np.int32)])],
                    ["shard", "ids", "marks", "first", "words", "terms", "at", "places"],
                )
                number += 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    return kept(rows.mapInArrow(run, INDEX), "index")


def _list(column: pa.Array) -> pa.Array:
    return pa.array([column.to_pylist()], pa.list_(pa.int64()))


class Phrases:
    """A block of test phrases as term hashes, with the item and the window number of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        terms, sizes, self.item, self.number = [], [], [], []
        for item, text in items:
            raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), LETTER_WORD)
            words = word_hashes(raw, starts, ends)
            n = min(len(words), window)
            for k in range(len(words) - n + 1 if n else 0):
                row = np.zeros(window, np.uint64)
                row[:n] = words[k : k + n]
                terms.append(row)
                sizes.append(n)
                self.item.append(item)
                self.number.append(k)
        self.terms = np.array(terms, np.uint64).reshape(-1, window)
        self.sizes = np.array(sizes, np.int64)


class Shard:
    """Postings of one index row."""

    def __init__(self, terms: bytes, at: bytes, places: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.at = np.frombuffer(at, np.int32).astype(np.int64)
        self.places = np.frombuffer(places, np.int32).astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.at)) << 32) | self.places

    def find(self, phrases: Phrases, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first place, last place) of every match."""
        none = np.zeros(0, np.int64)
        width = phrases.terms.shape[1]
        used = np.arange(width) < phrases.sizes[:, None]
        if not len(self.terms) or not len(used):
            return none, none, none
        term = np.minimum(np.searchsorted(self.terms, phrases.terms), len(self.terms) - 1)
        there = (self.terms[term] == phrases.terms) | ~used
        live = np.flatnonzero(there.all(axis=1))
        if not len(live):
            return none, none, none
        lengths = np.where(used[live], np.diff(self.at)[term[live]], np.iinfo(np.int64).max)
        ranked = np.argsort(lengths, axis=1, kind="stable")
        rarest = lengths[np.arange(len(live)), ranked[:, 0]]
        found = []
        cuts = np.flatnonzero(np.diff(np.cumsum(rarest) // CANDIDATES)) + 1
        for part in np.split(np.arange(len(live)), cuts):
            row, step = live[part], ranked[part]
            n, offset = rarest[part], step[:, 0]
            which = np.repeat(np.arange(len(part)), n)
            place = self.places[concat_ranges(self.at[term[row, offset]], n)]
            start, low, high = place - offset[which], place, place
            for k in range(1, width):
                more = phrases.sizes[row[which]] > k
                if not more.any():
                    break
                at = step[which, k]
                want = start + at
                head = term[row[which], at] << 32
                spot = np.minimum(np.searchsorted(self.keys, head | np.maximum(want - slack, 0)), len(self.keys) - 1)
                got = self.keys[spot]
                ok = ~more | ((got >= head) & (got <= (head | np.maximum(want + slack, 0))) & (got >= (head | np.maximum(want - slack, 0))) & (want + slack >= 0))
                got = np.where(more, got & 0xFFFFFFFF, low)
                which, start, low, high = which[ok], start[ok], np.minimum(low, got)[ok], np.maximum(high, got)[ok]
                if not len(which):
                    break
            found.append((row[which], low, high))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks that hold about ``block_words`` words each."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (5 * block_words)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        yield Phrases([(r.item or "", r.text or "") for r in rows], window)


MATCH = "shard string, row int, doc_id long, item string, window int, first_word int, last_word int"


def matches(index: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slack: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every match of every phrase: shard and row (the document), item, window number, first and last
    word (from 0 in the document).  Phrases are ``window`` consecutive item words, or all words of a
    shorter item.  With ``slack`` each word may stand so many words away from its place in the phrase,
    measured from the rarest one."""
    if window + slack >= GAP:
        raise ValueError(f"window + slack must be less than {GAP}")
    out = None
    for phrases in _blocks(benchmark, item_id, text, window, block_words):

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for shard in _rows(batches):
                which, low, high, doc = _found(shard, phrases, slack)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "shard": shard["shard"], "row": doc.astype(np.int32), "doc_id": pd.array([shard["ids"][d] for d in doc], "Int64"), "item": [phrases.item[w] for w in which],
                    "window": np.array([phrases.number[w] for w in which], np.int32), "first_word": low.astype(np.int32), "last_word": high.astype(np.int32)}), preserve_index=False,
                    schema=pa.schema([("shard", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()), ("item", pa.string()), ("window", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

        found = index.mapInArrow(run, MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(c)[k].as_py() for c, n in enumerate(batch.schema.names)}


def _found(shard: dict, phrases: Phrases, slack: int) -> tuple[np.ndarray, ...]:
    which, low, high = Shard(shard["terms"], shard["at"], shard["places"]).find(phrases, slack)
    first = np.frombuffer(shard["first"], np.int64)
    doc = np.searchsorted(first, low, side="right") - 1
    return which, low - first[doc], high - first[doc], doc


HITS = "shard string, row int, doc_id long, mark long, n_words long, firsts array<int>, lasts array<int>, items array<string>"


def contamination(index: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW, one_in: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a phrase), n_items (items
    that occur), items_sha256 (of the sorted item_ids, comma-joined; a null id is empty) and
    contaminated: n_hit > 0 and one_in * n_hit >= n_words.  Items without words match nothing;
    documents without words have no hits; an empty benchmark leaves all documents clean."""
    parts = []
    for number, phrases in enumerate(_blocks(benchmark, item_id, text, window, block_words)):

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, number=number) -> Iterator[pa.RecordBatch]:
            for shard in _rows(batches):
                which, low, high, doc = _found(shard, phrases, 0)
                words = np.frombuffer(shard["words"], np.int32)
                order = np.lexsort((low, doc))
                which, low, high, doc = which[order], low[order], high[order], doc[order]
                bounds = np.searchsorted(doc, np.arange(len(words) + 1))
                rows = [r for r in range(len(words)) if number == 0 or bounds[r] < bounds[r + 1]]
                cut = lambda x, r: x[bounds[r] : bounds[r + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard["shard"]] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array([shard["ids"][r] for r in rows], pa.int64()), pa.array([shard["marks"][r] for r in rows], pa.int64()), pa.array([int(words[r]) for r in rows], pa.int64()),
                    pa.array([cut(low, r).tolist() for r in rows], pa.list_(pa.int32())), pa.array([cut(high, r).tolist() for r in rows], pa.list_(pa.int32())),
                    pa.array([sorted({phrases.item[w] for w in cut(which, r)}) for r in rows], pa.list_(pa.string())),
                ], ["shard", "row", "doc_id", "mark", "n_words", "firsts", "lasts", "items"])

        def judged(batches: Iterator[pa.RecordBatch], run=run) -> Iterator[pa.RecordBatch]:
            return _verdicts(run(batches), one_in)

        parts.append((run, judged))
    if len(parts) == 1:
        return index.mapInArrow(parts[0][1], VERDICT)
    hits = None
    for run, _ in parts:
        more = index.mapInArrow(run, HITS)
        hits = more if hits is None else hits.unionByName(more)
    hits = hits.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("firsts", "lasts", "items")])
    return hits.mapInArrow(lambda batches: _verdicts(batches, one_in), VERDICT)


VERDICT = "doc_id long, mark long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdicts(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = batch.to_pydict()
        n_hit, shas, n_items = [], [], []
        for firsts, lasts, items in zip(b["firsts"], b["lasts"], b["items"], strict=True):
            n, end = 0, -1
            for f, t in sorted(zip(firsts, lasts, strict=True)):
                n, end = n + max(0, t - max(f - 1, end)), max(end, t)
            ids = sorted(set(items))
            n_hit.append(n)
            n_items.append(len(ids))
            shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        bad = [h > 0 and one_in * h >= w for h, w in zip(n_hit, b["n_words"], strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array(b["doc_id"], pa.int64()), pa.array(b["mark"], pa.int64()), pa.array(b["n_words"], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
            pa.array(shas, pa.string()), pa.array(bad, pa.bool_()),
        ], ["doc_id", "mark", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, with all columns; ``mark`` tells rows of one id apart."""
    index = build_index(docs, doc_id, text)
    verdicts = contamination(index, benchmark, **options)
    bad = kept(verdicts.where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("mark").alias("__mark")).distinct(), "contaminated")
    drop(index)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__bad")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__mark"))
    return docs.join(bad, same, "left_anti")
