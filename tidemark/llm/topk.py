"""Exact top-k inner products by norm buckets.

Vectors are ordered by length and cut into buckets of similar length.  A query with k products so
far has a bar; over its own length and a bucket's largest it is the bucket's local cosine threshold.
Above 1 the bucket is skipped; where it is low, only vectors that are too short are left out; where
it is high, the query's largest coordinates leave an interval for the same coordinates of a unit
vector, and only vectors inside the intervals are multiplied.  Products are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, n_blocks

BUCKET_ROWS = 2048
BLOCK_QUERIES = 8192
#: From this local cosine threshold on, coordinates are looked at; so many of them.
COORDINATE_FROM = 0.5
FOCUS = 4
SAFE = 1e-9


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id, dim, norm and the vector of floor(scale * x) as bytes of doubles, for valid vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            lists = col.to_numpy(zero_copy_only=False)
            rows = []
            for k, x in enumerate(lists):
                x = None if x is None else np.asarray(x, np.float64)
                if x is not None and np.isfinite(x).all():
                    x = np.floor(scale * x)
                    rows.append((ids[k].as_py(), len(x), float(np.sqrt((x * x).sum())), x.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["vec_id", "dim", "norm", "vector"])

    valid = F.col(embedding).isNotNull() & ~F.exists(F.col(embedding), lambda x: x.isNull())
    return vectors.where(valid).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, dim int, norm double, vector binary")


def norm_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, parts: int | None = None) -> DataFrame:
    """One row per bucket: dim, longest, vec_ids, norms and the vectors, by falling norm.  The range
    partitions are cut by dimension, norm and id, so a vector that most rows hold is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, dims, norms, data = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([dims[0]], pa.int32()), pa.array([norms[0]]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([np.array(norms).tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())],
                ["dim", "longest", "vec_ids", "norms", "vectors"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= bucket_rows or held[0][1] != row[1]):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    order = [F.col("dim").asc(), F.col("norm").desc(), F.col("vec_id").asc()]
    cut = rows.repartitionByRange(parts or n_blocks(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut.mapInArrow(run, "dim int, longest double, vec_ids array<bigint>, norms binary, vectors binary")


def exact_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; beyond what doubles hold exactly, Python integers are used.
    Products outside 64 bits are set to the nearest 64-bit integer."""
    most = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ p.T).astype(np.int64)
    wide = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    out = wide(q) @ wide(p).T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


class QueryBlock:
    """A bounded set of queries of one dimension, with the bar of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.bars = np.full(len(ids), -np.inf)
        unit = vectors / np.where(self.norms > 0, self.norms, 1)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.focus_values = np.take_along_axis(unit, self.focus, axis=1)


def search(block: QueryBlock, buckets: Iterator[tuple[list, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of at most k vectors per query that no better ones here displace; buckets
    are (vec_ids, norms, vectors).  A null id sorts last among equal scores."""
    bars, none = block.bars.copy(), np.iinfo(np.int64).max
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for vec_ids, norms, p in buckets:
        ids = np.array([none if v is None else v for v in vec_ids], np.int64)
        reach = block.norms * norms[0]
        local = np.where((bars > 0) & (reach > 0), bars / np.where(reach > 0, reach, 1), np.where(bars > 0, np.inf, -1.0))
        live = local <= 1 + SAFE
        need = np.where(bars > 0, bars / np.where(block.norms > 0, block.norms, 1), 0) * (1 - SAFE)
        prefix = np.where(bars > 0, np.searchsorted(-norms, -need, side="right"), len(norms))
        found = []
        by_length = np.flatnonzero(live & ((local < COORDINATE_FROM) | (prefix <= 64)))
        if len(by_length):
            n = int(prefix[by_length].max())
            scores = exact_products(block.q[by_length], p[:n])
            row, col = np.nonzero(scores >= bars[by_length][:, None])
            found.append((by_length[row], ids[col], scores[row, col]))
        by_coordinate = np.flatnonzero(live & (local >= COORDINATE_FROM) & (prefix > 64))
        if len(by_coordinate):
            unit = p / np.where(norms > 0, norms, 1)[:, None]
            for i in by_coordinate:
                n, x, t = prefix[i], block.focus_values[i], min(1.0, local[i])
                half = np.sqrt(np.maximum(0, (1 - t * t) * (1 - x * x))) + SAFE
                part = unit[:n, block.focus[i]]
                # a unit vector with cosine of at least t lies within the angle arccos(t) of the query
                low = np.where(x < -t, -1.0 - SAFE, t * x - half)
                high = np.where(x > t, 1.0 + SAFE, t * x + half)
                col = np.flatnonzero(((part >= low) & (part <= high)).all(axis=1))
                if len(col):
                    scores = exact_products(block.q[i : i + 1], p[col])[0]
                    ok = scores >= bars[i]
                    found.append((np.full(int(ok.sum()), i), ids[col[ok]], scores[ok]))
        if not found:
            continue
        q, v, s = (np.concatenate([b, *x]) for b, x in zip(best, zip(*found, strict=True), strict=True))
        other = v != block.ids[q]
        q, v, s = q[other], v[other], s[other]
        order = np.lexsort((v, -s.astype(object) if s.min(initial=0) == -(2**63) else -s, q))
        q, v, s = q[order], v[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == block.k - 1
        bars[q[last]] = np.maximum(bars[q[last]], s[last])
        best = tuple(x[place < block.k] for x in (q, v, s))
    return best


def _open(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            if batch.column(0)[r].as_py() == dim:
                norms = np.frombuffer(batch.column(3)[r].as_py(), np.float64)
                yield batch.column(2)[r].as_py(), norms, np.frombuffer(batch.column(4)[r].as_py(), np.float64).reshape(len(norms), dim)


def _searcher(block: QueryBlock, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).max
        q, v, s = search(block, _open(batches, dim))
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(q, pa.int64()), pa.array(v, mask=v == none), pa.array(s)], ["query_id", "query", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, *, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 1024.0, bucket_rows: int = BUCKET_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with every
    row whose vec_id is not the query's; ties go to the smaller vec_id, null ids last.

    ``is_query`` is a condition on ``vec_id``.  Null vectors and those with null or non-finite
    components take no part; vectors meet only those of their dimension.  Equal rows of one query are
    one query.  Queries go to the buckets in blocks of bounded size; each block's bars start from the
    bucket of the longest vectors.
    """
    rows = kept(scaled(vectors, vec_id, embedding, scale), "vectors")
    buckets = kept(norm_buckets(rows, bucket_rows), "buckets")
    queries = rows.where(is_query & F.col("vec_id").isNotNull()).select("vec_id", "dim", "vector").distinct()
    out = None
    for dim, n in [(r.dim, r.n) for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]:
        own, blocks = buckets.where(F.col("dim") == dim), -(-n // block_queries)
        longest = own.agg(F.max("longest")).first()[0]
        for b in range(blocks):
            block_rows = queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == b)).orderBy("vec_id", "vector").collect()
            block = QueryBlock(np.array([r.vec_id for r in block_rows], np.int64), np.frombuffer(b"".join(bytes(r.vector) for r in block_rows), np.float64).reshape(len(block_rows), dim), k)
            first = own.where(F.col("longest") == longest).limit(1).mapInArrow(_searcher(block, dim), "query_id long, query long, vec_id long, score long")
            for r in first.groupBy("query").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect():
                block.bars[r["query"]] = r.bar
            found = own.mapInArrow(_searcher(block, dim), "query_id long, query long, vec_id long, score long").withColumn("block", F.lit(f"{dim}/{b}"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
