"""N-gram Jaccard join by PartEnum signatures.

The features of a document are the 64-bit hashes of its word shingles.  Sets of one size band that
are similar enough differ in at most k features.  The hash space is cut into n1 ranges: with
n1 = k // 2 + 1, some range holds at most one difference.  Each range is cut in three, and each two
of the three make one signature, so that similar sets share a signature.  A set emits signatures
for its own band and the next, which covers pairs across the border.

Ranges without features would give signatures that all sets share.  One range more than needed is
cut, so two ranges qualify for every similar pair, and empty signatures are only written by sets that
have them in two ranges or more.

Signatures of little more than a common line are shared by many unlike sets.  With further ranges to
spare, each set leaves out its most common ones exactly: a similar pair meets in more ranges than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, PLAIN_WORD, block_slices, concat_ranges, drop, groups_of, kept, mix, n_blocks, shared_dir, text_slices, word_bounds, word_hashes

SHINGLE = 3
PERCENT = 90
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BLOOM_BITS = 1 << 24
#: Longs of a document's parity sketch: 64 buckets each, a bit says whether a bucket holds an odd number of features.
SKETCH = 8
SKETCHES = [f"s{k}" for k in range(SKETCH)]
VERIFY_BYTES = 1 << 19
#: One more range is cut for so many differences, so that sets can leave out common signatures.
SPARE_PART = 16


def shingle_sets(raw: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, bounds per row).  A row of fewer words, but not
    none, has its whole sequence as one shingle."""
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, offs, PLAIN_WORD)
    words = word_hashes(low, starts, ends)
    parts, sizes = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = min(shingle, b - a)
        if not n:
            sizes.append(0)
            continue
        h = np.full(b - a - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + words[a + k : b - n + 1 + k]) * _A
            h ^= h >> np.uint64(32)
        h = np.sort(mix(h))
        h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        parts.append(h)
        sizes.append(len(h))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


class Bands:
    """Size bands and, per band, the number of differences that similar sets may have."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high = percent, [1], [100 // percent]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * 100 // self.percent)
        return int(np.searchsorted(self.high, size))

    def differences(self, band: int) -> int:
        """100 I >= p U with I + U = a + b and U - I = differences."""
        while len(self.high) <= band:
            self.of(self.high[-1] + 1)
        return (100 - self.percent) * 2 * self.high[band] // (100 + self.percent)

    def ranges(self, band: int) -> int:
        k = self.differences(band)
        return k // 2 + 2 + k // SPARE_PART

    def spare(self, size: int) -> int:
        """How many written signatures a set of this size can leave out and still meet every similar one: of
        the ranges with at most one difference one may have empty signatures, and one has to be left."""
        most, own, found = (100 - self.percent) * (size + size * 100 // self.percent) // (100 + self.percent), self.of(size), []
        for band in (own, own + 1):
            k = self.differences(band)
            found.append(self.ranges(band) - min(most, k) // 2 - 2 if k else 0)
        return min(found)


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of one set."""
    n = len(features)
    if not n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(features * _B))])
    out, own = [], bands.of(n)
    for band in (own, own + 1):
        k = bands.differences(band)
        if k == 0:
            out.append(mix(sums[-1:] + np.array([band], np.uint64) * _A))
            continue
        ranges = bands.ranges(band)
        m = 3 * ranges
        at = np.searchsorted(features, (np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)))
        at = np.concatenate([[0], at, [n]])
        part = (sums[at[1:]] - sums[at[:-1]]).reshape(ranges, 3)
        count = np.diff(at).reshape(ranges, 3)
        pair = np.stack([part[:, 0] + part[:, 1] * _A, part[:, 0] + part[:, 2] * _B, part[:, 1] * _A + part[:, 2] * _B], axis=1)
        empty = np.stack([count[:, 0] + count[:, 1], count[:, 0] + count[:, 2], count[:, 1] + count[:, 2]], axis=1) == 0
        where = np.arange(m, dtype=np.uint64).reshape(ranges, 3) + np.uint64((band << 32) + 1)
        sig = mix(mix(pair) + where * _A)
        out.append(sig.ravel() if empty.any(axis=1).sum() > 1 else sig[~empty])
    return np.concatenate(out)


PACKED = "kind string, block int, a binary, b binary, c binary, ids array<bigint>, marks array<bigint>"


def parities(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(row, long): sketches differ in at most as many bits as the sets differ in features."""
    bits = 64 * SKETCH
    spot = np.repeat(np.arange(len(sizes)), sizes) * bits + (mix(features) >> np.uint64(32)).astype(np.int64) % bits
    return np.packbits((np.bincount(spot, minlength=len(sizes) * bits) & 1).astype(bool)).view(np.int64).reshape(len(sizes), SKETCH)


def wide_longs(sizes: np.ndarray) -> np.ndarray:
    """Longs of the wide sketch of sets of more features than the plain one has bits, as many bits as features or up to twice; else 0."""
    bits = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    return np.where(sizes > 64 * SKETCH, bits // 64, 0)


def wide_parities(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Wide sketches one after another.  The halves of one, combined, are the sketch of half its bits."""
    at, out = np.concatenate([[0], np.cumsum(sizes)]), [np.zeros(0, np.int64)]
    for r in np.flatnonzero(wide_longs(sizes)):
        bits = int(wide_longs(sizes[r : r + 1])[0]) * 64
        spot = (mix(features[at[r] : at[r + 1]]) >> np.uint64(32)).astype(np.int64) % bits
        out.append(np.packbits((np.bincount(spot, minlength=bits) & 1).astype(bool)).view(np.int64))
    return np.concatenate(out)


def wide_may_link(a: str, b: str, percent: int) -> Column:
    """``may_link`` by wide sketches; a shorter one is met by the longer one folded to its length."""
    x, y = F.col(f"{a}_wide"), F.col(f"{b}_wide")
    long, short = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    n = F.size(short)
    xor = lambda p, q: p.bitwiseXOR(q)
    folded = F.when(F.size(long) == n, long).when(F.size(long) == 2 * n, F.zip_with(F.slice(long, F.lit(1), n), F.slice(long, n + 1, n), xor))
    odd = F.aggregate(F.zip_with(short, folded, lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda s, v: s + v)
    return F.coalesce((100 + percent) * odd <= (100 - percent) * (F.col(f"{a}_size") + F.col(f"{b}_size")), F.lit(True))


def odd_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in SKETCHES), F.lit(0))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sides (columns ``<side>_size``, ``<side>_s0`` ...) leave a link possible; never false for a link."""
    odd = odd_bits(a, b)
    return (100 * F.least(f"{a}_size", f"{b}_size") >= percent * F.greatest(f"{a}_size", f"{b}_size")) & ((100 + percent) * odd <= (100 - percent) * (F.col(f"{a}_size") + F.col(f"{b}_size")))


def _scan(docs: DataFrame, shingle: int, percent: int, blocks: int) -> DataFrame:
    """Per run of rows: ``docs`` (node, size, two set hashes, first node with the same set) and ``sigs`` (the
    signatures of its different sets, by block).  A set whose signature another one of the run has is sent
    too: the first need not be similar to it, and a set of another run may meet it only there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, base = Bands(percent), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "text"):
                sets, at = shingle_sets(raw, offs, shingle)
                ids, marks = batch.column(0)[i:j].to_pylist(), batch.column(1)[i:j].to_pylist()
                node, seen = base + np.arange(j - i), {}
                base += j - i
                lanes = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ s))]) for s in (_A, _B)]
                h1, h2 = (x[at[1:]] - x[at[:-1]] for x in lanes)
                sizes = np.diff(at)
                rep = node.copy()
                found, owner = [], []
                for r in range(j - i):
                    if sizes[r]:
                        key = (int(h1[r]), int(h2[r]))
                        if key in seen:
                            rep[r] = seen[key]
                            continue
                        seen[key] = node[r]
                        s = signatures(sets[at[r] : at[r + 1]], bands)
                        found.append(s)
                        owner.append(np.full(len(s), node[r], np.int64))
                yield _packed("docs", -1, np.stack([node, sizes, rep]).astype(np.int64), np.stack([h1, h2]), np.concatenate([parities(sets, sizes).ravel(), wide_parities(sets, sizes)]), ids, marks)
                if not found:
                    continue
                sig, owner = np.concatenate(found), np.concatenate(owner)
                order, ordered, cuts = block_slices(sig, blocks)
                owner = owner[order]
                for b in range(blocks):
                    if cuts[b] < cuts[b + 1]:
                        part = slice(cuts[b], cuts[b + 1])
                        yield _packed("sigs", b, *_squeezed(ordered[part], owner[part]))

    return docs.mapInArrow(run, PACKED)


def _packed(kind: str, block: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, ids: list | None = None, marks: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (a, b, c)), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int64()))],
        ["kind", "block", "a", "b", "c", "ids", "marks"])


def _squeezed(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising signatures as steps of their upper 48 bits, low bytes and high ones apart, and nodes from the
    smallest on; compressed.  Signatures that agree only in these bits make a pair more to verify, no link."""
    step = np.diff(sig >> np.uint64(16), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    near = (node - node.min()).astype("<u4").view(np.uint8).reshape(-1, 4)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return *(np.frombuffer(squeeze(x.T.tobytes()), np.uint8) for x in (step, near)), np.array([node.min()], np.int64)


def _opened(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    get = zstandard.ZstdDecompressor().decompress
    step, near = np.frombuffer(get(a), np.uint8).reshape(6, -1), np.frombuffer(get(b), np.uint8).reshape(4, -1)
    wide = np.zeros((step.shape[1], 8), np.uint8)
    wide[:, :6] = step.T
    return np.cumsum(wide.view("<u8").ravel()) << np.uint64(16), np.ascontiguousarray(near.T).view("<u4").ravel().astype(np.int64) + np.frombuffer(c, np.int64)[0]


def _collapsed(sig: np.ndarray, node: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the signatures (in order) with the same nodes one each, with their number as weight of its rows."""
    starts = groups_of(sig)
    n = np.diff(starts)
    if not len(n):
        return sig, node, first, np.zeros(0, np.int64)
    key = mix(np.add.reduceat(mix(node.astype(np.uint64) * _A), starts[:-1]) + n.astype(np.uint64) * _B)
    _, one, often = np.unique(key, return_index=True, return_counts=True)
    rows = concat_ranges(starts[one], n[one])
    return sig[rows], node[rows], first[rows], np.repeat(often, n[one]).astype(np.int64)


GROUPS = "sig long, node long, first long, weight long"


def _as_groups(sig: np.ndarray, node: np.ndarray, first: np.ndarray, weight: np.ndarray) -> dict[str, pa.Array]:
    return {"sig": pa.array(sig.view(np.int64)), "node": pa.array(node), "first": pa.array(first), "weight": pa.array(weight)}


def _groups_of_block(table: pa.Table) -> pa.Table:
    """Signatures of a block that several sets have, with all their nodes and the smallest."""
    parts = [_opened(*(x.as_py() for x in row)) for row in zip(*(table.column(c) for c in "abc"), strict=True)]
    sig, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    starts = groups_of(sig)
    n = np.diff(starts)
    many = np.repeat(n > 1, n)
    return pa.table(_as_groups(*_collapsed(sig[many], node[many], np.repeat(node[starts[:-1]], n)[many])))


def _unpack(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    bands = Bands(percent)
    for batch in batches:
        for r in range(batch.num_rows):
            a, b = np.frombuffer(batch.column(2)[r].as_py(), np.int64).reshape(3, -1), np.frombuffer(batch.column(3)[r].as_py(), np.int64).reshape(2, -1)
            c = np.frombuffer(batch.column(4)[r].as_py(), np.int64)
            sketch, longs = c[: a.shape[1] * SKETCH].reshape(-1, SKETCH), wide_longs(a[1])
            ends = np.concatenate([[0], np.cumsum(longs)]).astype(np.int32)
            wide = pa.ListArray.from_arrays(pa.array(ends), pa.array(c[a.shape[1] * SKETCH :])) if len(longs) else pa.array([], pa.list_(pa.int64()))
            spare = pa.array([bands.spare(n) if n else 0 for n in a[1].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (*a, *b, *sketch.T)), wide, spare, pa.array(batch.column(5)[r].as_py(), pa.int64()), pa.array(batch.column(6)[r].as_py(), pa.int64())],
                ["node", "size", "rep", "h1", "h2", *SKETCHES, "wide", "spare", "doc_id", "mark"])


NODES = "node long, size long, rep long, h1 long, h2 long, " + ", ".join(f"{s} long" for s in SKETCHES) + ", wide array<bigint>, spare long, doc_id long, mark long"


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) lead to.  Alternates two steps that hang every
    node's neighbours on its smallest one, until only stars are left; hubs are combined before shuffles."""
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = kept(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest where each node has one smaller parent: every step doubles how far a pointer reaches."""
    at = kept(parents.withColumn("moved", F.lit(True)), "parents")
    while not at.where("moved").isEmpty():
        above = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        at = kept(at.select("node", "root").join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parents")
    return at.select("node", "root")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int, *, sifted: bool = False) -> DataFrame:
    """The pairs (a, b) that are similar.  Equal sets need no text, and sizes and sketches rule out others
    (both unless ``sifted``); the texts of the rest are read again, first reduced by a bit map of bounded
    size to those that can be asked for."""
    if sifted:
        rows = pairs.select("a", "b").withColumn("same", F.lit(False))
    else:
        info = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("size", "h1", "h2", *SKETCHES)])
        rows = pairs.join(info("a"), "a").join(info("b"), "b")
        same = (F.col("a_h1") == F.col("b_h1")) & (F.col("a_h2") == F.col("b_h2")) & (F.col("a_size") == F.col("b_size"))
        rows = kept(rows.withColumn("same", same).where(F.col("same") | may_link("a", "b", percent)).select("a", "b", "same"), "pairs")
    ask = rows.where("NOT same")
    spot = lambda i, m: F.pmod(F.xxhash64(i, m), F.lit(BLOOM_BITS))
    wanted = kept(ask.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "mark"), "node"), "wanted")
    bits = wanted.select(spot("doc_id", "mark").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    maybe = docs.withColumn("_s", spot("doc_id", "mark")).join(F.broadcast(bits), F.shiftright("_s", 6) == F.col("w")).where(F.expr("shiftright(bits, cast(_s & 63 as int)) & 1 = 1")).select("doc_id", "mark", "text")
    want = wanted.select("node", F.col("doc_id").alias("_i"), F.col("mark").alias("_m"))
    texts = kept(maybe.join(want, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("mark") == F.col("_m"))).select("node", "text").dropDuplicates(["node"]), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.asarray(pc.add(pc.binary_length(whole.column(2)), pc.binary_length(whole.column(3)))).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // VERIFY_BYTES)) + 1).tolist(), whole.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(i, j - i)
                (left, lat), (right, rat) = ([np.concatenate(x) for x in zip(*_sets(batch, c, shingle), strict=True)] for c in ("ta", "tb"))
                lb, rb = np.concatenate([[0], np.cumsum(lat)]), np.concatenate([[0], np.cumsum(rat)])
                ok = []
                for k in range(batch.num_rows):
                    x, y = left[lb[k] : lb[k + 1]], right[rb[k] : rb[k + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    shown = ask.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return rows.where("same").select("a", "b").unionByName(shown.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _sets(batch: pa.RecordBatch, column: str, shingle: int):
    for _, _, raw, offs in text_slices(batch, column):
        sets, at = shingle_sets(raw, offs, shingle)
        yield sets, np.diff(at)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, mark (hash of the text), group (a number for the component), n_shingles and component_id, the smallest doc_id that
    links lead to.  Two sets link when 100 x intersection >= percent x union.

    Texts that are null or have no words have no shingles, no links and their own doc_id as component.
    Rows are told apart by place, so repeated doc_ids keep their own sets; null ids are never smallest,
    and a component of null ids only has a null component_id.  An empty table gives no rows.

    No pair is dropped: signatures lead from each row to the first row of the groups it is in, and the
    one it shares most with is verified; the links make a forest.  Then each row is paired with a row of
    its signatures' smallest trees, and trees that link are joined.  At last every pair that shares a
    signature across two trees, and that sizes and sketches leave possible, is verified: the nearest of
    each two trees first, the others where the trees are still apart.  Pairs inside a tree can't change
    the result and are not formed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    path = f"{shared_dir(spark, 'jaccard')}/scan"
    _scan(rows, shingle, percent, n_blocks(spark)).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    kinds = spark.read.schema(PACKED).parquet(path)
    scan = lambda kind: kinds.where(F.col("kind") == kind).select("kind", "block", "a", "b", "c", "ids", "marks")
    every = kept(scan("docs").mapInArrow(lambda batches: _unpack(batches, percent), NODES), "nodes")
    nodes = every.where("node = rep")
    groups = kept(scan("sigs").select("block", "a", "b", "c").groupBy("block").applyInArrow(_groups_of_block, GROUPS), "groups")
    drop(path)
    star = kept(groups.where("node != first").groupBy("first", "node").agg(F.sum("weight").alias("shared")), "star")
    best = kept(star.groupBy("node").agg(F.max_by("first", F.struct("shared", -F.col("first"))).alias("first")), "best").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots = forest_roots(_verified(best, nodes, rows, shingle, percent).select(F.col("b").alias("node"), F.col("a").alias("root")))
    members = groups.groupBy("sig", "node").agg(F.sum("weight").alias("weight"))
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def apart(of: DataFrame) -> DataFrame:
        """Members of signatures that lie in several trees, with the number n of members; of the signatures with the
        same members one is kept, with their number as weight: two near copies meet once, not once for each signature."""
        listed = of.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), *[F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (0, 1)], F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
        one = listed.where("low != high").groupBy("x0", "x1", "n").agg(F.min("sig").alias("sig"), F.sum("weight").alias("weight")).select("sig", "n", "weight")
        return of.drop("n", "weight").join(one, "sig")

    def telling(of: DataFrame) -> DataFrame:
        """Members without the most common signatures of each set, as many as it has to spare.  One order holds for all
        sets, so what either of two similar sets leaves out of those they share is no more than one of them can spare."""
        most = Window.partitionBy("node").orderBy(F.col("n").desc(), "sig").rowsBetween(Window.unboundedPreceding, 0)
        facts = nodes.select("node", "size", "spare", *SKETCHES)
        ordered = of.withColumn("left_out", F.sum("weight").over(most))
        return ordered.join(facts, "node").where("left_out > spare").drop("left_out", "spare")

    def side(of: DataFrame, x: str) -> DataFrame:
        return of.select("sig", F.col("node").alias(x), F.col("root").alias(f"{x}_r"), *[F.col(c).alias(f"{x}_{c}") for c in ("size", *SKETCHES)])

    def as_pairs(met: DataFrame, done: list[DataFrame], name: str) -> DataFrame:
        """Different pairs (a, b) of rows x, y that meet and may link, without those already verified."""
        smaller = F.col("x") < F.col("y")
        pairs = met.select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(smaller, F.col("x_r")).otherwise(F.col("y_r")).alias("a_root"), F.when(smaller, F.col("y_r")).otherwise(F.col("x_r")).alias("b_root"),
            odd_bits("x", "y").alias("odd"), F.least("x_size", "y_size").alias("least")).distinct()
        for verified in done:
            pairs = pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti")
        pairs = kept(pairs, name)
        large = F.col("least") > 64 * SKETCH  # the plain sketch of larger sets is too full to tell much
        sides = [nodes.where(F.size("wide") > 0).select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("wide").alias(f"{x}_wide")) for x in "ab"]
        wide = pairs.where(large).join(sides[0], "a").join(sides[1], "b").where(wide_may_link("a", "b", percent))
        return kept(pairs.where(~large).unionByName(wide.select(*pairs.columns)).drop("least"), f"{name}-sifted")

    def linked(some: DataFrame) -> DataFrame:
        found = _verified(some, nodes, rows, shingle, percent, sifted=True)
        return kept(found.join(some, ["a", "b"]).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")

    def nearest_of(pairs: DataFrame) -> DataFrame:
        """Of the pairs between two trees the one with the fewest different sketch bits."""
        two = [F.least("a_root", "b_root").alias("_t"), F.greatest("a_root", "b_root").alias("_u")]
        return kept(pairs.groupBy(*two).agg(F.min(F.struct("odd", "a", "b", "a_root", "b_root")).alias("p")).select("p.*"), "nearest")

    def moved(of: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
        """Roots replaced by the smallest that the links lead to."""
        if links.isEmpty():
            return of
        to = components(links).select(F.col("node").alias("_from"), F.col("root").alias("_to"))
        for c in names:
            of = of.join(to.withColumnRenamed("_from", c), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        return of

    # every member with one of its signature's smallest tree: a row per member, and most trees that belong together meet
    members = kept(telling(apart(members)), "members")
    centre = side(members, "x").groupBy("sig").agg(F.min(F.struct("x_r", "x", "x_size", *[f"x_{c}" for c in SKETCHES])).alias("c")).select("sig", "c.*")
    met = side(members, "y").join(centre, "sig").where((F.col("x_r") != F.col("y_r")) & may_link("x", "y", percent))
    first = nearest_of(as_pairs(met, [best], "star-pairs"))
    more = linked(first)
    # then all pairs across the trees that are left: the nearest of each two trees first, others where they are still apart
    left = kept(apart(moved(members, more, ["root"]).select(*members.columns)), "left")
    x, y = side(left, "x"), side(left, "y")
    pairs = as_pairs(x.join(y, (x.sig == y.sig) & (F.col("x_r") < F.col("y_r")) & may_link("x", "y", percent)), [best, first], "pairs")
    nearest = nearest_of(pairs)
    second = linked(nearest)
    rest = pairs.join(nearest.select("a", "b"), ["a", "b"], "left_anti")
    rest = kept(moved(rest, second, ["a_root", "b_root"]).where("a_root != b_root").select(*pairs.columns), "rest")
    more = more.unionByName(second)
    if not rest.isEmpty():
        more = more.unionByName(linked(rest))
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = roots.unionByName(roots.select("root", F.col("root").alias("node")).distinct()).unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).withColumn("root", F.col("node"))).distinct()
        roots = kept(roots.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    drop(groups, members, left)
    named = every.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("doc_id", "mark", F.col("root").alias("group"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
