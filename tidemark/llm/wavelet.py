"""Token ids in wavelet-matrix files: one compressed, succinct file per shard.

A wavelet matrix keeps the bits of the ids plane by plane, highest bit first; after each plane the
ids are stably parted into those with a 0 and those with a 1 there.  Counts of ones before a place
(rank), kept per block of each plane, are all it takes to read a token, to count a token in a range
and to find its k-th occurrence; a lookup reads one block per plane.

File: magic, sections, JSON directory, its length (8 bytes), magic.  Sections are zstd blocks:
document ids, document starts, and per plane the ones before each block and the blocks of bits.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, byte_table, concat_ranges, file_system, kept, n_blocks, text_slices, word_bounds, word_hashes, write_file

MAGIC = b"WVMX0001"
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 4 << 20
CACHE_WORDS = 600_000
PART_BYTES = 1 << 19


# ---------------------------------------------------------------- the file


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file that holds these documents' ids, one after another."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts, at = [MAGIC], len(MAGIC)

    def put(data: bytes) -> list[int]:
        nonlocal at
        block = squeeze(data)
        parts.append(block)
        at += len(block)
        return [at - len(block), len(block)]

    bits = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    head = {"tokens": len(ids), "documents": len(doc_ids), "bits": bits, "planes": []}
    head["nulls"] = [k for k, d in enumerate(doc_ids) if d is None]
    head["doc_ids"] = put(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    head["starts"] = put(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes())
    for level in range(bits):
        bit = ((now >> now.dtype.type(bits - 1 - level)) & now.dtype.type(1)).astype(bool)
        raw = np.packbits(bit)
        step = BLOCK_BITS // 8
        blocks = [put(raw[k : k + step].tobytes()) for k in range(0, len(raw), step)]
        ones = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK_BITS), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
        zero = ~bit
        low = np.compress(zero, now)
        head["planes"].append({"zeros": len(low), "ones": put(np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes()), "blocks": blocks})
        now = np.concatenate([low, np.compress(bit, now)])
    directory = json.dumps(head, separators=(",", ":")).encode()
    return [*parts, directory, len(directory).to_bytes(8, "little"), MAGIC]


class WaveletFile:
    """Reads a file: whole by ``decode``, or by ``access``, ``rank``, ``count`` and ``select``."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a wavelet-matrix file")
        n = int.from_bytes(tail[:8], "little")
        self.head = json.loads(self.file.read_at(n, size - 16 - n))
        self.bits, self.tokens = self.head["bits"], self.head["tokens"]
        ids, nulls = np.frombuffer(self._get(self.head["doc_ids"]), "<i8"), set(self.head["nulls"])
        self.doc_ids = [None if k in nulls else int(d) for k, d in enumerate(ids)]
        self.starts = np.frombuffer(self._get(self.head["starts"]), "<i8")
        self._ones: dict[int, np.ndarray] = {}
        self._block: dict[tuple[int, int], np.ndarray] = {}

    def _get(self, where: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(where[1], where[0]))

    def close(self) -> None:
        self.file.close()

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values, get = np.zeros(self.tokens, kind), zstandard.ZstdDecompressor().decompress
        for level in range(self.bits - 1, -1, -1):
            plane, zeros = self.head["planes"][level], self.head["planes"][level]["zeros"]
            first, last = (plane["blocks"][0][0], sum(plane["blocks"][-1])) if plane["blocks"] else (0, 0)
            data = self.file.read_at(last - first, first)
            raw = b"".join(get(data[a - first : a - first + n]) for a, n in plane["blocks"])
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.tokens).view(bool)
            out = np.empty_like(values)
            out[np.flatnonzero(~bit)] = values[:zeros]
            out[np.flatnonzero(bit)] = values[zeros:] | kind(1 << (self.bits - 1 - level))
            values = out
        return values.astype(np.uint32)

    def _bits_of(self, level: int, block: int) -> np.ndarray:
        if (level, block) not in self._block:
            if len(self._block) > 4 * self.bits:
                self._block.clear()
            self._block[level, block] = np.unpackbits(np.frombuffer(self._get(self.head["planes"][level]["blocks"][block]), np.uint8))
        return self._block[level, block]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if level not in self._ones:
            self._ones[level] = np.frombuffer(self._get(self.head["planes"][level]["ones"]), "<i8")
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._ones[level][block]) + (int(self._bits_of(level, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.head["planes"]):
            bit = int(self._bits_of(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            value, ones = value << 1 | bit, self._rank1(level, i)
            i = plane["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level, plane in enumerate(self.head["planes"]):
            a, b = self._rank1(level, low), self._rank1(level, high)
            one = token >> (self.bits - 1 - level) & 1
            low, high = (plane["zeros"] + a, plane["zeros"] + b) if one else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often the token stands in [low, high)."""
        a, b = self._range(token, low, self.tokens if high is None else high)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0: back up through the planes."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            zeros, one = self.head["planes"][level]["zeros"], token >> (self.bits - 1 - level) & 1
            want = i - zeros if one else i
            self._rank1(level, 0)
            before = self._ones[level]
            if not one:
                before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.tokens) - before
            block = int(np.searchsorted(before, want, side="right")) - 1
            inside = self._bits_of(level, block)[: self.tokens - block * BLOCK_BITS] == one
            i = block * BLOCK_BITS + int(np.flatnonzero(inside)[want - int(before[block])])
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


# ---------------------------------------------------------------- encoding


#: ASCII bytes beside which a text is not cut: contractions and special tokens need them whole.
GLUE = b"'<|>"
_LETTER = byte_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_OTHER = byte_table(bytes(b for b in range(0x80) if not _LETTER[b] and b not in SPACES and b not in GLUE))
_NOT_SPACE = ~byte_table(SPACES)
MARK = "\x02"


class WordEncoder:
    """Encodes texts piece by piece with a tokenizer that drops white space and never joins a letter
    and another ASCII character in one word: pieces are cut at white space and between an ASCII
    letter and such a character, and each different piece is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.encoder.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        """Pieces known: sorted hashes, the slot of each, and per slot where its ids are."""
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.size, self.data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slot[at], -1)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found, sizes = [], []
        for i in range(0, len(pieces), 2000):
            words = pieces[i : i + 2000]
            joined = f" {MARK} ".join(words)
            ids = np.array(self._ids(joined), np.uint32) if self.mark is not None else None
            cuts = np.flatnonzero(ids == self.mark) if ids is not None else []
            if len(cuts) == len(words) - 1 == joined.count(MARK):
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                found.append(np.delete(ids, cuts))
            else:
                each = [np.array(self._ids(w), np.uint32) for w in words]
                sizes.append(np.array([len(x) for x in each]))
                found += each
        size = np.concatenate(sizes).astype(np.int64)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.slot = np.insert(self.slot, where, np.arange(len(self.at), len(self.at) + len(keys), dtype=np.int32))
        self.at = np.concatenate([self.at, len(self.data) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.data = np.concatenate([self.data, *found])

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids per row)."""
        low = LOWER[raw]
        isw = _NOT_SPACE[low]
        cut = np.zeros(len(low), bool)
        letter, other = _LETTER[low], _OTHER[low]
        cut[1:] = (letter[1:] & other[:-1]) | (other[1:] & letter[:-1])
        starts, ends, _ = word_bounds(low, offs, _NOT_SPACE)
        cuts = np.flatnonzero(cut & isw)
        inner = cuts[~np.isin(cuts, starts, assume_unique=True)] if len(cuts) else cuts
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        hashes = word_hashes(low, starts, ends)
        unique, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        slots = self._known(unique)
        new = np.flatnonzero(slots < 0)
        if len(new):
            data, a, b = low.tobytes(), starts[where[new]].tolist(), ends[where[new]].tolist()
            self._learn(unique[new], [data[x:y].decode() for x, y in zip(a, b, strict=True)])
            slots = self._known(unique)
        slot = slots[which]
        sizes = self.size[slot] if len(slot) else np.zeros(0, np.int64)
        ids = self.data[concat_ranges(self.at[slot], sizes)] if len(slot) else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(before[np.searchsorted(starts, offs)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process: its pieces serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


FILES = "path string, part int, number int, documents long, tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text (null: empty), append ``end_id`` and write files in ascending order of
    doc_id; nulls come first, and rows with one id follow the hash of their text.  The range
    partitions are cut by id and hash, so an id that holds many rows is split too.  Returns one row
    per file; an empty table writes none.  A repeated task writes the same names again."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(shards or n_blocks(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, code = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        ids, counts, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/shard-{part:06d}-{number:06d}.wvm"
            write_file(path, pack(names, np.concatenate(counts), np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64())], ["path", "part", "number", "documents", "tokens"])

        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "text", PART_BYTES):
                found, n = code.encode(raw, offs)
                out = np.full(len(found) + len(n), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(n + 1) - 1] = False
                out[keep] = found
                ids.append(out)
                counts.append(n + 1)
                names += batch.column(0)[i:j].to_pylist()
                held += len(out)
                if held >= shard_tokens:
                    yield flush()
                    ids, counts, names, held, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    return rows.mapInArrow(run, FILES)


def read_shards(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers).  The running sum goes over one
    row per file."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    at = files.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0))).select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = WaveletFile(path)
                ids, starts = f.decode().astype("<u4", copy=False), f.starts
                f.close()
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return at.repartition(tasks or n_blocks(files.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, **options) -> DataFrame:
    """Write the files below ``folder`` and read every document back from them."""
    return read_shards(kept(write_shards(docs, folder, tokenizer, end_id=end_id, **options), "token-files"))
