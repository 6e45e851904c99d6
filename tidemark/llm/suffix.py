"""Removal of repeated byte strings by merging shards' suffix blocks.

Each shard (a run of texts) parses its bytes into phrases that start at content-defined marks: the
minima of a gram hash in every window of W grams, so a phrase has at most W bytes and equal text gives
equal phrases, W bytes away from where it stops being equal.  The shard's suffixes at phrase starts are
sorted by their next DEPTH phrases, with what stands before each (the shard's transform of the parse).

Shards are merged by refining the interleaving of these blocks instead of sorting suffixes again:

1. blocks of suffixes that share DEPTH phrases: a block with one suffix in all shards is closed;
2. a block in which every suffix also has the same bytes before and behind, as far as the strings
   of ``length`` bytes around its phrases reach, is one repeated interval as a whole;
3. other blocks are refined to the strings of ``length`` bytes themselves; those with two or more
   places are the repeated intervals.

Shards send each block and each string once, with a mark if it has more places there, so a string
that most texts hold costs one entry per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_slices, concat_ranges, file_system, groups_of, kept, n_blocks, prefix_hash, shared_dir, span_hash, text_slices, write_file

LENGTH = 400
GRAM = 8
DEPTH = 3
OPEN, WHOLE, SPLIT = 0, 1, 2


def window_for(length: int) -> int:
    """The largest W for which a string holds, W bytes from both ends, DEPTH phrases in any position."""
    return (length - GRAM) // (DEPTH + 3)


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over x[i : i + w] at every i for which that is inside."""
    have, done = x, 1
    while done < w:
        step = min(done, w - done)
        have, done = pick(have[: len(have) - step], have[step:]), done + step
    return have


def marks(prefix: np.ndarray, offs: np.ndarray, w: int) -> np.ndarray:
    """Places whose gram hash is the least of some w grams in a row of one text."""
    n = len(prefix) - 1
    if n < GRAM + w:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    gram = (span_hash(prefix, at, at + GRAM) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(gram, w, np.minimum)
    crossing = offs[1:-1]
    bad = np.zeros(len(least) + 1, np.int64)  # windows that reach over the end of a text
    np.add.at(bad, np.clip(crossing - (w + GRAM - 2), 0, len(least)), 1)
    np.add.at(bad, np.clip(crossing, 0, len(least)), -1)
    least = np.where(np.cumsum(bad[:-1]) > 0, np.uint32(0), least)
    padded = np.concatenate([np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32)])
    most = _slide(padded, w, np.maximum)
    return np.flatnonzero(most[: len(gram)] == gram)


def suffix_blocks(prefix: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, key, around): the strings of ``length`` bytes whose first mark at
    least W from their start is the same, by the hash of its DEPTH phrases, and by that of all bytes
    these strings hold."""
    w = window_for(length)
    mark = marks(prefix, offs, w)
    text = np.searchsorted(offs, mark, side="right") - 1
    begin, end = offs[text], offs[text + 1]
    previous = np.concatenate([[-1], mark[:-1]])
    same = np.concatenate([[False], text[1:] == text[:-1]])
    low = np.where(same, np.maximum(begin, previous - w + 1), begin)
    high = np.minimum(end - length, mark - w)
    ok = np.flatnonzero(low <= high)
    core_end = mark[np.minimum(ok + DEPTH, len(mark) - 1)]
    low, high, mark = low[ok], high[ok], mark[ok]
    key = span_hash(prefix, mark, core_end)
    around = span_hash(prefix, low, high + length) + (mark - low).astype(np.uint64)
    return low, high, key, around


# ---------------------------------------------------------------- rounds


def _shards(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([part | number]), pa.array([batch.column(0)[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(1)[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([raw.tobytes()], pa.binary()), pa.array([offs.tobytes()], pa.binary())],
                                                 ["shard", "ids", "marks", "raw", "offs"])
                number += 1

    return docs.mapInArrow(run, "shard long, ids array<bigint>, marks array<bigint>, raw binary, offs binary")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = [batch.column(c)[r] for c in range(5)]
            raw = np.frombuffer(row[3].as_buffer(), np.uint8)
            yield row[0].as_py(), row[1].as_py(), row[2].as_py(), raw, np.frombuffer(row[4].as_py(), np.int64)


SENT = "block int, shard long, key binary, around binary, more binary"


def _send(shard: int, blocks: int, key: np.ndarray, around: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Each key once, by block, with the first ``around`` and a byte: 1 more places, 2 different arounds."""
    order, ordered, _ = block_slices(key, blocks)
    starts = groups_of(ordered)
    n = np.diff(starts)
    more = (n > 1).astype(np.uint8)
    keys = ordered[starts[:-1]]
    first = around
    if around is not None and len(key):
        a = around[order]
        first, differs = a[starts[:-1]], np.concatenate([[False], a[1:] != a[:-1]])
        differs[starts[:-1]] = False
        more |= (np.add.reduceat(differs, starts[:-1]) > 0).astype(np.uint8) << 1
    _, _, cuts = block_slices(keys, blocks)
    for b in range(blocks):
        i, j = cuts[b], cuts[b + 1]
        if i < j:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([shard]), *(pa.array([x[i:j].tobytes() if x is not None else b""], pa.binary()) for x in (keys, first, more))], ["block", "shard", "key", "around", "more"])


def _merge(table: pa.Table) -> pa.Table:
    """One block of the interleaving: for each entry of each shard, whether its key is closed (one
    place), whole (one surrounding everywhere) or split."""
    read = lambda c, t: [np.frombuffer(x.as_py(), t) for x in table.column(c)]
    keys, arounds, more = read("key", np.uint64), read("around", np.uint64), np.concatenate(read("more", np.uint8))
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    key = np.concatenate(keys)
    around = np.concatenate(arounds) if any(len(a) for a in arounds) else None
    order = np.argsort(key)
    starts = groups_of(key[order])
    n, m = np.diff(starts), more[order]
    many = (n > 1) | (np.bitwise_or.reduceat(m, starts[:-1]) & 1 > 0)
    state = np.where(many, WHOLE, OPEN).astype(np.uint8)
    if around is not None:
        a = around[order]
        differs = np.concatenate([[False], a[1:] != a[:-1]])
        differs[starts[:-1]] = False
        split = (np.add.reduceat(differs, starts[:-1]) > 0) | (np.bitwise_or.reduceat(m, starts[:-1]) & 2 > 0)
        state[split & many] = SPLIT
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(state, n)
    return pa.table({"shard": table.column("shard"), "block": table.column("block"), "state": pa.array([x.tobytes() for x in np.split(out, sizes)], pa.binary())})


def _round(sent: DataFrame, folder: str) -> None:
    """Merge what the shards sent, and write the answers to each shard as one file in the shared folder."""

    def write(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy())
        shard = table.column("shard")[0].as_py()
        write_file(f"{folder}/{shard}", [b"".join(table.column("state")[int(k)].as_py() for k in order)])
        return pa.table({"shard": pa.array([shard])})

    answers = sent.groupBy("block").applyInArrow(_merge, "shard long, block int, state binary")
    answers.groupBy("shard").applyInArrow(write, "shard long").write.format("noop").mode("overwrite").save()


def _answers(folder: str, shard: int, key: np.ndarray) -> np.ndarray:
    """The state of each of the shard's keys: answers are in order of the distinct keys."""
    if not len(key):
        return np.zeros(0, np.uint8)
    system, at = file_system(f"{folder}/{shard}")
    with system.open_input_stream(at) as f:
        states = np.frombuffer(f.read(), np.uint8)
    return states[np.searchsorted(np.unique(key), key)]


def _split_strings(prefix: np.ndarray, blocks: tuple, state: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all strings in blocks that have to be refined."""
    low, high = blocks[0][state == SPLIT], blocks[1][state == SPLIT]
    starts = concat_ranges(low, high - low + 1)
    return starts, span_hash(prefix, starts, starts + length)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, mark (hash of the text), n_bytes, spans (maximal removed runs of bytes, half
    open), kept (the remaining bytes).  A byte is removed if a string of ``length`` bytes over it also
    starts anywhere else, in the same text too; strings are those of the input and never cross texts.

    A null text is empty; texts shorter than ``length`` are kept whole; repeated rows are copies like
    any other.  An empty table gives no rows.  Rows keep their place, so ids may be null or repeat.
    """
    if window_for(length) < 2:
        raise ValueError(f"length must be at least {2 * (DEPTH + 3) + GRAM}")
    spark = docs.sparkSession
    n, folder = n_blocks(spark), f"{shared_dir(spark, 'suffix')}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    shards = kept(_shards(rows), "shards", "zstd")

    def send_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _, raw, offs in _open(batches):
            _, _, key, around = suffix_blocks(prefix_hash(raw), offs, length)
            yield from _send(shard, n, key, around)

    def send_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _, raw, offs in _open(batches):
            prefix = prefix_hash(raw)
            blocks = suffix_blocks(prefix, offs, length)
            state = _answers(f"{folder}/blocks", shard, blocks[2])
            _, hashes = _split_strings(prefix, blocks, state, length)
            yield from _send(shard, n, hashes, None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, tags, raw, offs in _open(batches):
            prefix = prefix_hash(raw)
            blocks = suffix_blocks(prefix, offs, length)
            state = _answers(f"{folder}/blocks", shard, blocks[2])
            starts, hashes = _split_strings(prefix, blocks, state, length)
            low, high = blocks[0][state == WHOLE], blocks[1][state == WHOLE]
            hit = starts[_answers(f"{folder}/strings", shard, hashes) == WHOLE]
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, low, 1)
            np.add.at(cover, high + length, -1)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            out = []
            for k, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                own = gone[x:y]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans = [{"start": int(s), "end": int(t)} for s, t in zip(edge[::2], edge[1::2], strict=True)]
                out.append((ids[k], tags[k], y - x, spans, raw[x:y][~own].tobytes() if spans else raw[x:y].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], ["doc_id", "mark", "n_bytes", "spans", "kept"])

    _round(shards.mapInArrow(send_blocks, SENT), f"{folder}/blocks")
    _round(shards.mapInArrow(send_strings, SENT), f"{folder}/strings")
    return shards.mapInArrow(cut, "doc_id long, mark long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def span_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
