"""Helpers shared by the operators: scratch tables, batches as byte arrays, word hashes, block exchange.

Texts are handled as the UTF-8 bytes that Arrow hands to a task.  All separators used here are
ASCII, so cutting bytes never cuts a character.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``; where that is
    unset, a temporary one, which only a local session can use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark resolves it to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).makeQualified(at).toString()


def kept(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The table written to the shared folder and read back: computed once, lineage cut."""
    path = f"{shared_dir(df.sparkSession, name)}/table"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame | str) -> None:
    """Delete scratch tables (or a folder of ``shared_dir``) that no later step reads, and the shuffle files of steps that
    are done: those lie on disk until the driver collects the garbage that names them."""
    spark = SparkSession.active()
    for _ in range(2):  # the first lets go of what the second finds
        spark.sparkContext._jvm.System.gc()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        for path in {t} if isinstance(t, str) else {f.rpartition("/")[0] for f in t.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def n_blocks(spark: SparkSession) -> int:
    """Blocks that a block exchange deals to: grows with the session's shuffle partitions."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local_path(path: str) -> str | None:
    """The plain path of a ``file:`` URI, None for any other store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


# ---------------------------------------------------------------- batches as bytes


def text_slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` text bytes (one longer row stands alone): (first row,
    end row, bytes, offsets).  Nulls are empty; nothing is copied."""
    col = batch.column(batch.schema.get_field_index(text))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2] if n else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:  # a null may own bytes
        ok = np.asarray(col.is_valid())
        if np.any(np.diff(offs)[~ok]):
            col = pa.array([v.as_py() or "" for v in col], pa.large_string())
            offs, raw = np.frombuffer(col.buffers()[1], dtype=np.int64)[: n + 1], np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def byte_table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words by white space, and words of letters, digits and non-ASCII (read after lower-casing).
PLAIN_WORD = ~byte_table(SPACES)
LETTER_WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def word_bounds(low: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes, never across rows; and per row the index
    of its first word, with the number of words last."""
    isw = member[low]
    before = np.empty_like(isw)
    before[1:], before[:1] = isw[:-1], False
    after = np.empty_like(isw)
    after[:-1], after[-1:] = isw[1:], False
    cuts = offs[1:-1]
    before[cuts[cuts < len(low)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(isw & ~before), np.flatnonzero(isw & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2 ** 64."""
    have = _kept.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        have = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        if size <= 4 * CHUNK_BYTES:
            _kept[base] = have
    return have


def prefix_hash(low: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of byte x power: the hash of [a, b) is (p[b] - p[a]) * inverse power a."""
    out = np.zeros(len(low) + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * powers(len(low), base)[0][: len(low)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit content hash of each [start, end)."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), base)[1][starts] + (ends - starts).astype(U64) * U64(_STEP))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(low), starts, ends)


def string_hash(text: str | bytes) -> int:
    """The hash that ``word_hashes`` gives these bytes."""
    raw = np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def groups_of(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length last."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def block_slices(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by hash; bounds of each block in it (blocks are ranges of hash values)."""
    order = np.argsort(hashes, kind="stable")
    cuts = np.array([(k << 64) // blocks for k in range(1, blocks)], U64)
    ordered = hashes[order]
    return order, ordered, np.concatenate([[0], np.searchsorted(ordered, cuts), [len(hashes)]])


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


# ---------------------------------------------------------------- files that tasks open


def file_system(path: str):
    """(file system, path in it) for a URI, by Arrow's public file systems."""
    from pyarrow import fs

    here = local_path(path)
    return (fs.LocalFileSystem(), here) if here else fs.FileSystem.from_uri(path)


def list_files(path: str, suffix: tuple[str, ...]) -> list[tuple[str, int]]:
    """(URI, size) of the files below a folder, or of the file itself, in order of name."""
    from pyarrow import fs

    system, at = file_system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    names = [(head + x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and "/_" not in x.path[len(at) :]]
    return sorted(names)


def write_file(path: str, parts) -> None:
    """Write a whole file under a name of its own, then move it in place: a repeated task leaves one file."""
    system, at = file_system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    system.move(part, at)
