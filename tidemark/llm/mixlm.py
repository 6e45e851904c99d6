"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end.  Every running word that training texts hold is coded by
bits that the words before it predict (``contexts``), and by its count.  Any word, for where it is new,
is coded by its spelling: the bits of its bytes, each predicted from several hashed contexts (the
last 0 to 3 bytes, the whole beginning of the word).  The predictions are added up in the logistic
domain with weights that a gate (place in the word) selects; weights are learned online, and an
adaptive map from the mixed prediction to what was seen refines it.  A document's own past sets how
likely its next word is a new one.

Words are exchanged in blocks of their hash, each once per run of texts, and every different word of
the corpus is spelled once, as it is new once; its tables of bit counts have a fixed size.  Running
words are exchanged in shards of the two words before them; these and word counts grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PLAIN_WORD, block_slices, concat_ranges, drop, groups_of, kept, mix, n_blocks, shared_dir, string_hash, text_slices, word_bounds, word_hashes
from .contexts import SHARD_WORDS, SIZES, Asks, Coder, answers, column_of, packed, sizes_of, unpacked

RUN_BYTES = 8 << 20
END = b"\n"
#: Classes of texts (a power of two), features they are told apart by, passes over the corpus after each split.
CLASSES, FEATURES, CLASS_PASSES = 4, 4096, 4
#: Parts that sums of class counts are added up in.
CLASS_PARTS = 64
#: Words of the whole corpus's distribution that a class's counts are smoothed with.
CLASS_PRIOR = 200.0
CONTEXTS = 5
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
GATES = 8
BUCKETS = 33
BATCH = 1 << 15
RATE = 0.02
#: Weight, in words, of the corpus's rate of new words against a document's own.
NEW_PRIOR = 50.0
#: (strength of the corpus's model, discount) of the predictors that count a document's own words.
OWN_WORDS = ((20.0, 0.5), (100.0, 0.6), (500.0, 0.8))
#: Tokens whose probabilities are mixed at a time, about.
SCORED = 1 << 17
LN10 = float(np.log(10.0))


# ---------------------------------------------------------------- classes of documents


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52)).astype(np.int64)


def text_kinds(hashes: np.ndarray, first: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The class of each text: that under which its words are likeliest; the first of equal ones."""
    return kinds_of(features(hashes), first, logs)


def kinds_of(feature: np.ndarray, first: np.ndarray, logs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs[feature], axis=0)])
    return (total[first[1:]] - total[first[:-1]]).argmax(axis=1)


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.sum(_arrays(table, "counts", np.int64), axis=0).tobytes()], pa.binary())})


def feature_rows(docs: DataFrame) -> DataFrame:
    """The features of all training texts' words, and the number of words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in text_slices(batch, "text"):
                low = LOWER[raw]
                starts, ends, first = word_bounds(low, offs, PLAIN_WORD)
                found = features(word_hashes(low, starts, ends)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([packed(x)], pa.binary()) for x in (found, np.diff(first))], ["features", "words"])

    return docs.where("NOT held AND text IS NOT NULL").select("text").mapInArrow(run, "features binary, words binary")


def class_counts(docs: DataFrame, logs: np.ndarray) -> np.ndarray:
    """(feature, class): words of all training texts, each text in the class that ``logs`` give it."""
    return _class_counts(feature_rows(docs), logs)


def _class_counts(rows: DataFrame, logs: np.ndarray) -> np.ndarray:
    classes = logs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(FEATURES * classes, np.int64)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, per = unpacked(a, np.uint16).astype(np.int64), unpacked(b, np.int64)
                kind = np.repeat(kinds_of(found, np.concatenate([[0], np.cumsum(per)]), logs), per) if classes > 1 else 0
                sums += np.bincount(found * classes + kind, minlength=len(sums))
        if sums.any():
            parts = sums.reshape(CLASS_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASS_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    got = rows.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary").orderBy("part").collect()
    if not got:
        return np.zeros((FEATURES, classes), np.int64)
    return np.frombuffer(b"".join(bytes(r.counts) for r in got), np.int64).reshape(FEATURES, classes)


def document_classes(docs: DataFrame) -> np.ndarray:
    """Log probabilities (feature, class) of CLASSES word distributions, fitted by hard assignment of all
    training texts: the corpus's distribution is split in two by a sign per feature and fitted by
    CLASS_PASSES sums over the corpus, then each half again.  The classes only choose which counts a
    word of a text adds to; no labels are used.  Texts are cut into words once; the sums read features."""
    rows = kept(feature_rows(docs), "lm-features")
    logs = _fitted_classes(rows)
    drop(rows)
    return logs


def _fitted_classes(rows: DataFrame) -> np.ndarray:
    fitted = lambda counts: np.log((counts + 0.1) / (counts + 0.1).sum(axis=0))
    counts = _class_counts(rows, np.zeros((FEATURES, 1)))
    if not counts.any():
        return np.zeros((FEATURES, CLASSES))
    logs = fitted(counts)
    while logs.shape[1] < CLASSES:
        sign = np.where(mix(np.arange(FEATURES, dtype=np.uint64) + np.uint64(logs.shape[1] << 32)) >> np.uint64(63), 0.1, -0.1)[:, None]
        logs = np.concatenate([logs + np.log(1 + sign), logs + np.log(1 - sign)], axis=1)
        logs -= np.log(np.exp(logs).sum(axis=0))
        for _ in range(CLASS_PASSES):
            logs = fitted(_class_counts(rows, logs))
    return logs


# ---------------------------------------------------------------- words of the corpus


def _scan(docs: DataFrame, blocks: int, logs: np.ndarray) -> DataFrame:
    """Per run of texts: ``tokens`` (ids, held_out, number of tokens per text, index of each token in
    the run's sorted words) and, per block, ``words`` (hashes, training counts, lengths, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        end_hash = np.array([string_hash(END)], np.uint64)
        texts: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            run_id = part << 24 | number
            data = np.concatenate([t[0] for t in texts] + [np.frombuffer(END, np.uint8)])
            base = np.cumsum([0] + [len(t[0]) for t in texts])
            starts = np.concatenate([t[1] + b for t, b in zip(texts, base, strict=False)])
            lens = np.concatenate([t[2] for t in texts])
            hashes = np.concatenate([t[3] for t in texts])
            n = np.concatenate([t[4] for t in texts])
            ends = np.cumsum(n) - 1  # the end token of each text is already counted
            h = np.empty(len(hashes) + len(n), np.uint64)
            is_end = np.zeros(len(h), bool)
            is_end[ends] = True
            h[is_end], h[~is_end] = end_hash, hashes
            at, size = np.full(len(h), len(data) - 1, np.int64), np.ones(len(h), np.int64)
            at[~is_end], size[~is_end] = starts, lens
            learn = np.concatenate([t[5] for t in texts])
            unique, first, which = np.unique(h, return_index=True, return_inverse=True)
            kind = np.concatenate([t[8] for t in texts])
            taught = np.repeat(learn, n)
            counts = np.bincount((which * CLASSES + np.repeat(kind, n))[taught], minlength=len(unique) * CLASSES).reshape(-1, CLASSES)
            ids, out = sum((t[6] for t in texts), []), sum((t[7] for t in texts), [])
            yield _row("tokens", run_id, -1, [which.astype(np.uint32), n.astype(np.int64)], ids, out)
            _, _, cuts = block_slices(unique, blocks)
            for b in range(blocks):
                i, j = cuts[b], cuts[b + 1]
                if i < j:
                    sizes = size[first[i:j]]
                    yield _row("words", run_id, b, [unique[i:j], counts[i:j].astype(np.int64), sizes.astype(np.int32), data[concat_ranges(at[first[i:j]], sizes)]])

        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "text"):
                low = LOWER[raw]
                starts, ends, first = word_bounds(low, offs, PLAIN_WORD)
                out, hashes = batch.column(1)[i:j].to_pylist(), word_hashes(low, starts, ends)
                kind = text_kinds(hashes, first, logs)
                texts.append((low, starts, ends - starts, hashes, np.diff(first) + 1, ~np.array(out, bool), batch.column(0)[i:j].to_pylist(), out, kind))
                held += len(low) + j - i
                if held >= RUN_BYTES:
                    yield from flush()
                    texts, held, number = [], 0, number + 1
        if texts:
            yield from flush()

    return docs.mapInArrow(run, PACKED)


PACKED = "kind string, run long, block int, a binary, b binary, c binary, d binary, ids array<bigint>, held array<boolean>"


def _row(kind: str, run: int, block: int, arrays: list[np.ndarray], ids: list | None = None, held: list | None = None) -> pa.RecordBatch:
    parts = [packed(a) for a in arrays] + [None] * (4 - len(arrays))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([run], pa.int64()), pa.array([block], pa.int32()), *(pa.array([p], pa.binary()) for p in parts), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_()))],
        ["kind", "run", "block", "a", "b", "c", "d", "ids", "held"])


def _arrays(table: pa.Table | pa.RecordBatch, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in table.column(table.schema.names.index(column))]


def _vocabulary(table: pa.Table) -> pa.Table:
    """One block: each word with its training count, and for every run where its words are in it."""
    runs = table.column("run").to_pylist()
    hashes, counts, sizes, data = (column_of(table, c, t) for c, t in zip("abcd", (np.uint64, np.int64, np.int32, np.uint8), strict=True))
    per_run = np.array([len(h) for h in hashes])
    h, n, size, text = (np.concatenate(x) for x in (hashes, counts, sizes, data))
    del counts, sizes, data
    order = np.argsort(h, kind="stable")
    starts = groups_of(h[order])
    total = np.add.reduceat(n.reshape(-1, CLASSES)[order], starts[:-1], axis=0)
    at = (np.cumsum(size, dtype=np.int64) - size)[order[starts[:-1]]]
    size = size[order[starts[:-1]]].astype(np.int64)
    where = np.empty(len(h), np.int32)
    where[order] = np.repeat(np.arange(len(total)), np.diff(starts))
    refs = np.split(where, np.cumsum(per_run)[:-1])
    rows = [("vocab", -1, packed(total), packed(size.astype(np.int32)), packed(text[concat_ranges(at, size)]))] + [("refs", r, packed(w), None, None) for r, w in zip(runs, refs, strict=True)]
    block = table.column("block")[0].as_py()
    cols = list(zip(*rows, strict=True))
    return pa.table({"kind": pa.array(cols[0]), "block": pa.array([block] * len(rows), pa.int32()), "run": pa.array(cols[1], pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip("abc", cols[2:], strict=True)}})


# ---------------------------------------------------------------- spelling


def letters(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each with a space after it; hashes of their contexts; their gates."""
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]), 0x20, np.int64)
    first = ends - sizes - 1
    out[concat_ranges(first, sizes)] = data
    place = np.arange(len(out)) - np.repeat(first, sizes + 1)
    before = np.zeros((4, len(out)), np.uint64)
    for k in range(1, 4):
        before[k, k:] = np.where(place[k:] >= k, out[:-k] + 1, 0)
    powers = (out + 1).astype(np.uint64) * _powers(place)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers)])
    prefix = total[np.arange(len(out))] - np.repeat(total[first], sizes + 1)
    mixed = [np.zeros(len(out), np.uint64), before[1], before[1] << np.uint64(9) | before[2], before[1] << np.uint64(18) | before[2] << np.uint64(9) | before[3], prefix]
    contexts = np.stack([(mix(m * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) for k, m in enumerate(mixed)])
    return out, contexts, np.minimum(place, GATES - 1)


_place_powers = np.multiply.accumulate(np.concatenate([[1], np.full(4095, 0x5851F42D4C957F2D, np.uint64)]).astype(np.uint64))


def _powers(place: np.ndarray) -> np.ndarray:
    """A power per place; places far out, where words are long, take it modulo the table."""
    return _place_powers[place & 4095]


def nodes(out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the bytes, highest first: what the node of the bits so far adds to a slot, and the bit."""
    for k in range(8):
        node = (out >> (8 - k)) | (1 << k)
        yield (node * 0x9E3779B1 & (SLOTS - 1)).astype(np.int32), (out >> (7 - k)) & 1


def batches_of(sizes: np.ndarray, data: np.ndarray, pick: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, sizes, bytes) of the words in parts of about BATCH words or 8 x BATCH bytes."""
    at = np.cumsum(sizes) - sizes
    index = np.arange(len(sizes)) if pick is None else np.flatnonzero(pick)
    total = np.cumsum(sizes[index] + 1)
    cut = np.flatnonzero(np.diff(total // (8 * BATCH))) + 1
    for part in np.split(index, cut):
        if len(part):
            yield part, sizes[part], data[concat_ranges(at[part], sizes[part])]


def count_bits(sizes: np.ndarray, data: np.ndarray, seen: np.ndarray, into: np.ndarray) -> None:
    """Add each word of the training texts once to the tables (context, slot, bit)."""
    for _, s, d in batches_of(sizes, data, seen):
        out, contexts, _ = letters(s, d)
        for extra, bit in nodes(out):
            for k in range(CONTEXTS):
                into[k] += np.bincount((contexts[k] ^ extra) * 2 + bit, minlength=2 * SLOTS).astype(np.float32).reshape(SLOTS, 2)


def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def learn_weights(words: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Online gradient steps over words that stand once in training, each predicted from the tables
    without itself; the weights, the refining map's counts (gate, bucket, bit) and the bits seen."""
    weights, seen, bits = np.full((GATES, CONTEXTS), 0.3), np.zeros((GATES, BUCKETS, 2)), 0
    for counts, sizes, data in words:
        for _, s, d in batches_of(sizes, data, counts == 1):
            out, contexts, gate = letters(s, d)
            share = np.maximum(np.bincount(gate, minlength=GATES), 1)[:, None]
            for extra, bit in nodes(out):
                x = np.empty((CONTEXTS, len(out)), np.float32)
                for k in range(CONTEXTS):
                    both = tables[k][contexts[k] ^ extra]
                    x[k] = stretch(np.maximum(both[:, 0] - (bit == 0), 0), np.maximum(both[:, 1] - (bit == 1), 0))
                dot = np.einsum("kn,kn->n", x, weights[gate].T)
                seen += np.bincount((gate * BUCKETS + bucket(dot)) * 2 + bit, minlength=seen.size).reshape(seen.shape)
                error = bit - squash(dot)
                step = np.stack([np.bincount(gate, error * x[k], minlength=GATES) for k in range(CONTEXTS)], axis=1)
                weights += RATE * 8 * step / share
            bits += 8 * len(out)
    return weights, seen, bits


class Speller:
    """The learned tables, weights and map; ``log10`` gives each word's spelling probability."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, seen: np.ndarray):
        self.stretched = np.stack([stretch(t[:, 0], t[:, 1]) for t in tables])
        self.weights = weights.astype(np.float32)
        centre = squash((np.arange(BUCKETS) - BUCKETS // 2) / 2.0)
        self.map = ((seen[:, :, 1] + 20 * centre) / (seen.sum(axis=2) + 20)).astype(np.float32)

    def log10(self, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
        result = np.zeros(len(sizes))
        for part, s, d in batches_of(sizes, data):
            out, contexts, gate = letters(s, d)
            w, total = self.weights[gate].T.copy(), np.zeros(len(out), np.float32)
            for extra, bit in nodes(out):
                dot = np.zeros(len(out), np.float32)
                for k in range(CONTEXTS):
                    dot += w[k] * self.stretched[k][contexts[k] ^ extra]
                p = (squash(dot) + self.map[gate, bucket(dot)]) / 2
                total += np.log(np.where(bit == 1, p, 1 - p))
            result[part] = np.add.reduceat(total.astype(np.float64), np.cumsum(s + 1) - s - 1) / LN10
        return result


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, counts by word and class, lengths, bytes)."""
    for batch in batches:
        for block, a, b, c in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("block", "a", "b", "c")), strict=True):
            yield block, unpacked(a, np.int64).reshape(-1, CLASSES), unpacked(b, np.int32).astype(np.int64), unpacked(c, np.uint8)


def places(classes: np.ndarray) -> np.ndarray:
    """The number of each word among those of its class."""
    order = np.argsort(classes, kind="stable")
    starts = groups_of(classes[order])
    out = np.empty(len(classes), np.int64)
    out[order] = np.arange(len(classes)) - np.repeat(starts[:-1], np.diff(starts))
    return out


# ---------------------------------------------------------------- a document's own past


def before_of(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sum of what stands before each token in its document."""
    total = np.cumsum(x) - x
    return total - np.repeat(total[np.cumsum(per) - per], per)


def gated(each: list[np.ndarray], per: np.ndarray) -> np.ndarray:
    """Log probabilities of a mixture whose weights are a softmax over what each part has gained on the document so far."""
    gate = np.stack([before_of(x, per) for x in each])
    gate -= gate.max(axis=0)
    share = np.log(sum(np.exp(g) for g in gate))
    for g, x in zip(gate, each, strict=True):
        g += x
        g -= share
    most = gate.max(axis=0)
    gate -= most
    return most + np.log(sum(np.exp(g) for g in gate))


def either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the sum of two probabilities, the second of which is not 0."""
    most = np.maximum(a, b)
    return most + np.log(np.exp(a - most) + np.exp(b - most))


def adapted(which: np.ndarray, counts: np.ndarray, classes: np.ndarray, spelled: np.ndarray, per: np.ndarray, per_class: np.ndarray, new: float, running: np.ndarray) -> np.ndarray:
    """Natural log probability of each token.  A word has what the words before it give it (``running``, if it
    is not new) or, per class of texts, the class's count smoothed by the corpus's, or else its spelling;
    these are mixed.  That is the base of four predictors that trust the document's own words more or
    less, which are mixed in turn."""
    place, n = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per), max(per_class.sum(), 1)
    p_new = (NEW_PRIOR * new + before_of((counts == 0).astype(np.int64), per)) / (NEW_PRIOR + place)
    spell = np.log(p_new) + spelled
    with np.errstate(divide="ignore"):
        known = np.log(1 - p_new)
        prior = CLASS_PRIOR * counts / n
        by_class = [either(known + np.log((classes[which, k] + prior) / (per_class[k] + CLASS_PRIOR)), spell) for k in range(CLASSES)]
        base = gated([*by_class, either(known + np.where(counts > 0, running, -np.inf), spell)], per)
        key = np.repeat(np.arange(len(per)), per) * np.int64(which.max() + 1) + which
        order = np.argsort(key, kind="stable")
        at = groups_of(key[order])
        seen = np.empty(len(which), np.int64)
        seen[order] = np.arange(len(which)) - np.repeat(at[:-1], np.diff(at))
        kinds = before_of((seen == 0).astype(np.int64), per)
        return gated([base] + [either(np.log(np.maximum(seen - d, 0)), np.log(t + d * kinds) + base) - np.log(place + t) for t, d in OWN_WORDS], per)


# ---------------------------------------------------------------- the operator


def lm_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-0.1
    unigram, log10), score (this model, log10) and bits_per_byte of the words with one separator each.

    Learns from rows where ``held_out`` is false or null.  A null or empty text is just the end; a word
    of any length is spelled out; repeated rows count as often as they stand.  Without training texts
    all words are new and the spelling tables are empty.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = n_blocks(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))
    scan_path = f"{shared_dir(spark, 'lm')}/scan"
    _scan(rows, blocks, document_classes(rows)).write.option("compression", "zstd").partitionBy("kind").parquet(scan_path)
    scan = spark.read.schema(PACKED).parquet(scan_path)
    words = scan.where("kind = 'words'").select("block", "run", "a", "b", "c", "d").groupBy("block").applyInArrow(_vocabulary, "kind string, block int, run long, a binary, b binary, c binary")
    words_path = f"{shared_dir(spark, 'lm')}/words"
    words.write.option("compression", "zstd").partitionBy("kind").parquet(words_path)
    drop(f"{scan_path}/kind=words")
    words = spark.read.schema("kind string, block int, run long, a binary, b binary, c binary").parquet(words_path)
    vocab = words.where("kind = 'vocab'").select("block", "a", "b", "c")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, counts, _, _ in _blocks_of(batches):
            all_of = counts.sum(axis=1)
            said = all_of[all_of > 0]
            by_size = [np.bincount(sizes_of(said), minlength=SIZES), np.bincount(sizes_of(said), said, SIZES).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int((said == 1).sum())]), pa.array([counts.sum(axis=0).tolist()]), *(pa.array([x.tolist()]) for x in by_size)], ["block", "once", "classes", "words", "tokens"])

    found = vocab.mapInArrow(totals, "block int, once long, classes array<long>, words array<long>, tokens array<long>").orderBy("block").collect()
    added_up = lambda column, size: np.sum([r[column] for r in found], axis=0, dtype=np.int64) if found else np.zeros(size, np.int64)
    per_class, sized = added_up("classes", CLASSES).astype(float), added_up("words", SIZES)
    coder, once = Coder(sized, added_up("tokens", SIZES)), sum(r.once for r in found)
    n, v = int(per_class.sum()), coder.n_words
    shards = max(blocks, n // SHARD_WORDS)
    #: the first rank of each class of counts in each block
    first_ranks = {r.block: coder.start + before for r, before in zip(found, np.cumsum([np.zeros(SIZES, np.int64), *[r.words for r in found]], axis=0)[:-1], strict=True)}

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((CONTEXTS, SLOTS, 2), np.float32)
        for _, counts, sizes, data in _blocks_of(batches):
            count_bits(sizes, data, counts.sum(axis=1) > 0, into)
        for k in range(CONTEXTS):
            for part in range(64):
                yield pa.RecordBatch.from_arrays([pa.array([k * 64 + part], pa.int32()), pa.array([into[k].reshape(64, -1)[part].tobytes()], pa.binary())], ["part", "counts"])

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.sum(_arrays(table, "counts", np.float32), axis=0, dtype=np.float32).tobytes()], pa.binary())})

    few = vocab.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    summed = few.mapInArrow(tables, "part int, counts binary").groupBy("part").applyInArrow(added, "part int, counts binary").orderBy("part").collect()
    bits = np.zeros((CONTEXTS, SLOTS, 2), np.float32)
    if summed:
        bits = np.frombuffer(b"".join(bytes(r.counts) for r in summed), np.float32).reshape(CONTEXTS, SLOTS, 2)
    shared = spark.sparkContext.broadcast(bits)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen, done = learn_weights(((c.sum(axis=1), s, d) for _, c, s, d in _blocks_of(batches)), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()]), pa.array([seen.ravel().tolist()]), pa.array([done], pa.int64())], ["w", "seen", "bits"])

    got = few.mapInArrow(weights, "w array<double>, seen array<double>, bits long").where("bits > 0").collect()
    share = np.array([r.bits for r in got], float)
    learned = np.average([r.w for r in got], axis=0, weights=share).reshape(GATES, CONTEXTS) if len(got) else np.full((GATES, CONTEXTS), 0.3)
    seen = np.sum([r.seen for r in got], axis=0).reshape(GATES, BUCKETS, 2) if len(got) else np.zeros((GATES, BUCKETS, 2))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value, learned, seen)
        for block, counts, sizes, data in _blocks_of(batches):
            all_of = counts.sum(axis=1)
            size = sizes_of(np.maximum(all_of, 1))
            ranks = np.full(len(size), -1, np.int64)
            said = np.flatnonzero(all_of > 0)
            ranks[said] = first_ranks[block][size[said]] + places(size[said])
            arrays = [counts, speller.log10(sizes, data).astype(np.float32), sizes.astype(np.int32), ranks]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([packed(x)], pa.binary()) for x in arrays)], ["block", "classes", "logs", "sizes", "ranks"])

    scored = few.mapInArrow(spelled, "block int, classes binary, logs binary, sizes binary, ranks binary")

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        of = {c: column_of(right, c, kind)[0] for c, kind in WORD_COLUMNS.items()}
        of["classes"] = of["classes"].reshape(-1, CLASSES)
        refs = column_of(left, "a", np.int32)
        return pa.table({"run": left.column("run"), "block": left.column("block"), **{c: pa.array([packed(x[r]) for r in refs], pa.binary()) for c, x in of.items()}})

    refs = words.where("kind = 'refs'").select("block", "run", "a")
    found_path = f"{shared_dir(spark, 'lm')}/found"
    found_type = "run long, block int, classes binary, logs binary, sizes binary, ranks binary"
    refs.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(looked_up, found_type).write.parquet(found_path)
    drop(words_path)
    found = spark.read.schema(found_type).parquet(found_path)
    tokens = scan.where("kind = 'tokens'").select("run", "a", "b", "ids", "held").groupBy("run")

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        asks = _asks_of(left, _words_of(right, ["ranks"])["ranks"], coder.n_words, shards).rows()
        run = left.column("run")[0].as_py()
        return pa.table({"run": pa.array([run] * len(asks), pa.int64()), "shard": pa.array([s for s, _ in asks], pa.int32()), **{c: pa.array([x[k] for _, x in asks], pa.binary()) for k, c in enumerate("abcde")}})

    asks = tokens.cogroup(found.select("run", "block", "ranks").groupBy("run")).applyInArrow(asked, "run long, shard int, a binary, b binary, c binary, d binary, e binary")
    answers_path = f"{shared_dir(spark, 'lm')}/answers"
    asks.groupBy("shard").applyInArrow(lambda table: answers(table, coder), "run long, shard int, costs binary").write.parquet(answers_path)
    told = spark.read.schema("run long, shard int, costs binary").parquet(answers_path)
    new = min(1.0, max((once + 1) / (n + 2), 1e-6)) if n else 1.0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        by_kind = [right.filter(right.column(c).is_valid()) for c in ("block", "shard")]
        of, costs = _words_of(by_kind[0], list(WORD_COLUMNS)), by_kind[1].sort_by("shard")
        counts, logs, sizes, ranks = of["classes"].sum(axis=1), of["logs"], of["sizes"], of["ranks"]
        which, per = column_of(left, "a", np.uint32)[0].astype(np.int64), column_of(left, "b", np.int64)[0]
        plain = np.full(len(ranks), -np.inf)
        plain[ranks >= 0] = coder.alone(ranks[ranks >= 0])
        told = np.concatenate([np.zeros(0, np.uint16), *column_of(costs, "costs", np.uint16)])
        running = _asks_of(left, ranks, coder.n_words, shards).answered(plain, which, told)
        c, log = counts[which], logs[which].astype(float)
        first = np.cumsum(per) - per
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x
        # texts don't read each other's past, so a part of a run's texts at a time
        ends = np.concatenate([[0], np.cumsum(per)])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(first // SCORED)) + 1, [len(per)]])
        of_texts = [(slice(ends[i], ends[j]), per[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        points = sums(np.concatenate([adapted(which[s], c[s], of["classes"], log[s] * LN10, p, per_class, new, running[s]) for s, p in of_texts])) / LN10
        byte = sums(sizes[which].astype(np.int64) + 1)
        return pa.table({
            "doc_id": pa.array(left.column("ids")[0].as_py(), pa.int64()), "held_out": pa.array(left.column("held")[0].as_py(), pa.bool_()), "n_tokens": pa.array(per), "n_known": pa.array(sums((c > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(per), n, np.int64)), "base_score": pa.array(sums(np.log10((c + 0.1) / (n + 0.1 * (v + 1))))), "score": pa.array(points), "bits_per_byte": pa.array(-points * np.log2(10.0) / byte),
        })

    either = found.withColumn("shard", F.lit(None).cast("int")).unionByName(told, allowMissingColumns=True)
    return tokens.cogroup(either.groupBy("run")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


WORD_COLUMNS = {"classes": np.int64, "logs": np.float32, "sizes": np.int32, "ranks": np.int64}


def _words_of(table: pa.Table, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of a run's words, which lie in blocks."""
    blocks = table.sort_by("block")
    of = {c: np.concatenate(column_of(blocks, c, WORD_COLUMNS[c])) for c in columns}
    return of | ({"classes": of["classes"].reshape(-1, CLASSES)} if "classes" in of else {})


def _asks_of(tokens: pa.Table, ranks: np.ndarray, n_words: int, shards: int) -> Asks:
    held = np.array(tokens.column("held")[0].as_py(), bool)
    return Asks(column_of(tokens, "a", np.uint32)[0].astype(np.int64), column_of(tokens, "b", np.int64)[0], held, ranks, n_words, shards)
