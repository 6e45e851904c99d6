"""Cross-tokenizer alignment: which tokens of A and of B cover the same bytes of a text.

The ends of A's and of B's tokens are two rising sequences.  Their merge is divided by diagonals: piece
k starts where k x ``piece`` ends are merged, and a binary search along that diagonal finds how many of
them are A's.  Pieces have equal work whatever lies in them and advance side by side; each emits the
overlaps of its own steps.  Places where both end close a group; a group that a piece leaves open is
stitched to what the next pieces hold of it.

Texts are cut into units at blanks that both tokenizers always cut at (checked when they are loaded;
otherwise a text is one unit), and a chunk of texts is aligned by its different units.  Pairs of ids are
counted corpus-wide by an exchange of the chunks' different pairs; the counts go back to the chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, concat_ranges, groups_of, kept, mix, text_slices, word_hashes

PIECE, CHUNK_BYTES, HASH_BYTES, ENCODE_BYTES, BLOCK_BYTES = 256, 8 << 20, 1 << 20, 1 << 19, 32 << 20


# ---------------------------------------------------------------- the merge


def diagonals(ends_a: np.ndarray, ends_b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A (and of B) are merged before each piece; equal ends: A's first."""
    d = np.arange(0, len(ends_a) + len(ends_b), piece)
    low, high = np.maximum(0, d - len(ends_b)), np.minimum(d, len(ends_a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, d - low
        mid = (low[open_] + high[open_]) >> 1
        before = ends_a[mid] <= ends_b[d[open_] - 1 - mid]
        low[open_[before]] = mid[before] + 1
        high[open_[~before]] = mid[~before]


def merge_path(ends_a: np.ndarray, ends_b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens (index in A, index in B), in order, and the groups' ends in A and in B.

    Both sequences rise and have the same last end, or both are empty.
    """
    n, m = len(ends_a), len(ends_b)
    i, j = diagonals(ends_a, ends_b, piece)
    far = np.iinfo(np.int64).max
    a, b = np.append(ends_a, far), np.append(ends_b, far)
    before = np.concatenate([[-1], ends_a])
    left, right = np.zeros((len(i), piece), np.int64), np.zeros((len(i), piece), np.int64)
    kind = np.zeros((len(i), piece), np.uint8)  # 0 past the end, 1 overlap, 2 both end here
    for step in range(piece):
        now_a, now_b = a[i], b[j]
        from_a = now_a <= now_b
        closes = ~from_a & (before[i] == now_b)
        left[:, step], right[:, step] = i, j
        kind[:, step] = np.where(closes, 2, 1)
        from_a &= i < n
        i = i + from_a
        j = j + (~from_a & (j < m))
    flat = kind.ravel()
    flat[n + m :] = 0
    links, ends = np.flatnonzero(flat == 1), np.flatnonzero(flat == 2)
    left, right = left.ravel(), right.ravel()
    return left[links], right[links], left[ends], right[ends] + 1


# ---------------------------------------------------------------- tokenizers


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class _Vocabulary:
    """Bytes of each id, as one array with offsets."""

    def __init__(self, entries: list[bytes]):
        self.raw = np.frombuffer(b"".join(entries), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(e) for e in entries])])
        self.sizes = np.diff(self.starts)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[concat_ranges(self.starts[ids], self.sizes[ids])]


class Tokenizers:
    """A byte-level vocabulary of the tokenizers library (A) and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entry = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            entry[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_a = _Vocabulary(entry)
        self.bytes_b = _Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        with open(path_a, encoding="utf-8") as f:
            plan = json.load(f)
        pre = plan.get("pre_tokenizer") or {}
        probe = "a  b   <s> c\n d\t e  "
        same = self.bytes_b.bytes_of(np.array(self.b.encode(probe))).tobytes() == b" " + probe.encode()
        self.by_units = same and not plan.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)

    def cuts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of units: texts, and blanks after a character that is no white space (told by ASCII and by
        the first bytes of other white space)."""
        heads = offs[:-1][np.diff(offs) > 0]
        if not self.by_units:
            return heads
        p = np.flatnonzero(raw == 0x20)
        p = p[(p > 0) & ~np.isin(p + 1, offs)]  # a blank that ends a text stays with its unit
        back = lambda k: raw[np.maximum(p - k, 0)]
        other = (back(1) >= 0x80) & ((back(2) == 0xC2) | np.isin(back(3), (0xE1, 0xE2, 0xE3)))
        return np.union1d(heads, p[(back(1) > 0x20) & (back(1) != 0x7F) & ~other])

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens of A per unit, ids of B, tokens of B per unit, whether both give back the unit's bytes)."""
        a, b, n_a, n_b, at = [], [], [], [], 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and (end == at or size + len(units[end]) <= ENCODE_BYTES):
                size += len(units[end])
                end += 1
            some = units[at:end]
            said = [u.decode("utf-8", "replace") for u in some]
            ids, n = self._joined(some, said)
            a.append(ids)
            n_a.append(n)
            found = self.b.encode([s[1:] for s in said], num_threads=1)
            n_b.append(np.fromiter(map(len, found), np.int64, len(found)))
            b.append(np.fromiter(chain.from_iterable(found), np.int64, int(n_b[-1].sum())))
            at = end
        a, b, n_a, n_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, n_a, n_b))
        raw, size = np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units], np.int64)
        return a, n_a, b, n_b, _same(self.bytes_a, a, n_a, raw, size) & _same(self.bytes_b, b, n_b, raw, size)


    def _joined(self, units: list[bytes], said: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of the units and their numbers.  Units after which a cut is sure are read as one text."""
        solid = [self.by_units and 0x20 < u[-1] < 0x7F and "\ufffd" not in s for u, s in zip(units, said, strict=True)]
        sure = np.array(solid, bool)
        ids = np.array(self.a.encode("".join([s for s, ok in zip(said, solid, strict=True) if ok]), add_special_tokens=False).ids, np.int64)
        ends = np.cumsum([len(u) for u, ok in zip(units, solid, strict=True) if ok], dtype=np.int64)
        last = np.searchsorted(np.cumsum(self.bytes_a.sizes[ids]), ends) + 1 if len(ends) else ends
        rest = [e.ids for e in self.a.encode_batch_fast([s for s, ok in zip(said, solid, strict=True) if not ok], add_special_tokens=False)]
        n = np.zeros(len(units), np.int64)
        n[sure], n[~sure] = np.diff(last, prepend=0), [len(x) for x in rest]
        out, owner = np.zeros(int(n.sum()), np.int64), np.repeat(sure, n)
        out[owner], out[~owner] = ids, np.fromiter(chain.from_iterable(rest), np.int64, int(n[~sure].sum()))
        return out, n


def _same(vocabulary: _Vocabulary, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])
    last = np.cumsum(n)
    first, got = ends[last - n], ends[last] - ends[last - n]
    same = got == size
    starts = np.cumsum(size) - size
    differs = vocabulary.bytes_of(ids)[concat_ranges(first[same], size[same])] != raw[concat_ranges(starts[same], size[same])]
    same[np.repeat(np.flatnonzero(same), size[same])[differs]] = False
    return same


@lru_cache(maxsize=4)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


# ---------------------------------------------------------------- chunks


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the units, some bytes at a time."""
    out, cuts = [np.zeros(0, U64)], groups_of(starts // HASH_BYTES)
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = starts[x], ends[y - 1]
        out.append(word_hashes(raw[a:b], starts[x:y] - a, ends[x:y] - a))
    return np.concatenate(out)


class _Chunk:
    """Texts aligned by their different units: ids, links and groups per unit; units per text."""

    def __init__(self, t: Tokenizers, raw: np.ndarray, offs: np.ndarray, piece: int):
        starts = t.cuts(raw, offs)
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        key = _hashes(raw, starts, ends)
        _, first, which, often = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        rank = np.argsort(-often, kind="stable")  # frequent units get small numbers
        first = first[rank]
        self.units = np.argsort(rank)[which]
        self.row = np.searchsorted(starts, offs)  # first unit of each text
        whole = raw.tobytes()
        self.a, self.n_a, self.b, self.n_b, fits = t.encode([whole[x:y] for x, y in zip(starts[first], ends[first], strict=True)])
        per_text = np.diff(self.row)
        self.fits = per_text > 0
        self.fits[np.repeat(np.arange(len(per_text)), per_text)[~fits[self.units]]] = False
        keep_a, keep_b = np.repeat(fits, self.n_a), np.repeat(fits, self.n_b)
        self.a, self.b, self.n_a, self.n_b = self.a[keep_a], self.b[keep_b], np.where(fits, self.n_a, 0), np.where(fits, self.n_b, 0)
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        i, j, self.end_a, self.end_b = merge_path(np.cumsum(t.bytes_a.sizes[self.a]), np.cumsum(t.bytes_b.sizes[self.b]), piece)
        of_token = np.repeat(np.arange(len(first)), self.n_a)
        self.link_unit, self.link_a, self.link_b = of_token[i], self.a[i], self.b[j]
        self.n_links = np.bincount(self.link_unit, minlength=len(first))
        self.n_groups = np.bincount(of_token[self.end_a - 1], minlength=len(first))
        self.often = np.bincount(self.units[np.repeat(self.fits, per_text)], minlength=len(first))

    def per_text(self, of_unit: np.ndarray) -> np.ndarray:
        """Sum of a unit's number over each text that has tokens."""
        total = np.concatenate([[0], np.cumsum(of_unit[self.units])])
        return np.where(self.fits, np.diff(total[self.row]), 0)

    def written(self) -> list[bytes]:
        """Groups of each unit as ``a,a|b,b;a|b``."""
        out_a, out_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        out_a[self.end_a - 1] = out_b[self.end_b - 1] = True
        group_a, group_b = np.cumsum(out_a) - out_a, np.cumsum(out_b) - out_b  # group of each token
        b_before, a_before = np.concatenate([[0], self.end_b]), self.end_a
        seq = np.empty(len(self.a) + len(self.b), object)
        for ids, at, last, close in ((self.a, np.arange(len(self.a)) + b_before[group_a], out_a, b"|"), (self.b, np.arange(len(self.b)) + a_before[group_b], out_b, b";")):
            values, place = np.unique(ids, return_inverse=True)
            for mark, some in ((b",", ~last), (close, last)):
                seq[at[some]] = np.array([b"%d%s" % (v, mark) for v in values.tolist()] + [None], object)[:-1][place[some]]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        listed = seq.tolist()
        return [b"".join(listed[x:y])[:-1] for x, y in zip([0, *ends][:-1], ends, strict=True)]

    def of_text(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, group ends in A, group ends in B) of text k."""
        if not self.fits[k]:
            return (np.zeros(0, np.int64),) * 4
        u = self.units[self.row[k] : self.row[k + 1]]
        groups = np.cumsum(self.n_groups)
        picks = concat_ranges(groups[u] - self.n_groups[u], self.n_groups[u])
        shift = lambda first, n: np.repeat(np.cumsum(n[u]) - n[u] - first[u], self.n_groups[u])
        return (self.a[concat_ranges(self.first_a[u], self.n_a[u])], self.b[concat_ranges(self.first_b[u], self.n_b[u])],
                self.end_a[picks] + shift(self.first_a, self.n_a), self.end_b[picks] + shift(self.first_b, self.n_b))


def _spaced(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    said = F.col(f"`{text}`").cast("string")
    return docs.select(F.when(said != "", F.concat(F.lit(" "), said)).alias("_text"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)])


def align(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", keep: list[str], piece: int = PIECE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``keep`` columns with a_ids, b_ids, a_ends and b_ends: tokens of blank + text, and per group the
    number of tokens of A and of B up to its end.

    Null and empty texts, and texts that the tokens don't give back byte by byte, have empty lists.
    Repeated rows are aligned alike; columns not named are not read; an empty table gives none.
    """
    frame = _spaced(docs, text, keep)
    schema = ", ".join(f"{c} {t}" for c, t in frame.dtypes[1:]) + ", a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "_text", chunk_bytes):
                chunk = _Chunk(t, raw, offs, piece)
                lists = list(zip(*[chunk.of_text(k) for k in range(j - i)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in batch.columns[1:]], *[pa.array(x, pa.list_(pa.int32())) for x in lists]], [*batch.schema.names[1:], "a_ids", "b_ids", "a_ends", "b_ends"])

    out = frame.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "a_ids", "b_ids", "a_ends", "b_ends")


# ---------------------------------------------------------------- corpus-wide counts


def _exchanged(chunks: DataFrame, blocks: int, n_b: int) -> DataFrame:
    """Per chunk and block its pairs with their counts corpus-wide, and per block the highest count of each id of B."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = np.frombuffer(pairs, "<u8"), np.frombuffer(counts, "<u8")
                block = (mix(keys) % U64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cuts = groups_of(block[order])
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    part = order[x:y]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([int(block[part[0]])], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "pairs": [keys[part].tobytes()], "counts": [n[part].tobytes()]})

    def total(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(v.as_buffer(), "<u8") for v in rows.column("pairs")]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros(len(every), np.uint64)
        np.add.at(counts, at, np.concatenate([np.frombuffer(v.as_buffer(), "<u8") for v in rows.column("counts")]))
        sums = np.split(counts[at], np.cumsum([len(k) for k in keys])[:-1])
        b = (every % U64(n_b)).astype(np.int64)
        order = np.lexsort((counts, b))
        last = order[groups_of(b[order])[1:] - 1]
        return pa.table({"chunk": pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()), "pairs": pa.array([*[k.tobytes() for k in keys], None], pa.binary()), "totals": pa.array([*[s.tobytes() for s in sums], None], pa.binary()),
                         "ids": pa.array([*[None] * len(keys), b[last].tolist()], pa.list_(pa.int64())), "most": pa.array([*[None] * len(keys), counts[last].astype(np.int64).tolist()], pa.list_(pa.int64()))})

    dealt = chunks.select("chunk", "pairs", "counts").mapInArrow(deal, "block int, chunk long, pairs binary, counts binary")
    return dealt.groupBy("block").applyInArrow(total, "chunk long, pairs binary, totals binary, ids array<long>, most array<long>")


def alignment_digest(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    A link is an overlapping pair of tokens; its count is the number of links of all rows with its two
    ids; best are links whose count is the highest of their id of B.  Rows without tokens (null, empty, or
    not given back byte by byte) have zeros and an empty digest; repeated rows count each; an empty
    table gives none.
    """
    frame = _spaced(docs, text, [doc_id])
    key = frame.dtypes[1][1]
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"chunk long, _0 {key}, " + ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string, units binary, pairs binary, counts binary, links binary, sizes binary"
    n_b = tokenizers(path_a, path_b).b.get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, raw, offs in text_slices(batch, "_text", chunk_bytes):
                c, number = _Chunk(t, raw, offs, piece), number + 1
                pairs, link = np.unique(c.link_a.astype(U64) * U64(n_b) + c.link_b.astype(U64), return_inverse=True)
                counts = np.bincount(link, weights=c.often[c.link_unit], minlength=len(pairs)).astype("<u8")
                said, units = np.array([*c.written(), b""], object), c.units.astype("<u4")
                digests = [hashlib.sha256(b";".join(said[c.units[x:y]].tolist())).hexdigest() if ok else "" for ok, x, y in zip(c.fits.tolist(), c.row[:-1].tolist(), c.row[1:].tolist(), strict=True)]
                n = j - i
                nothing = {k: pa.nulls(n, pa.binary()) for k in ("pairs", "counts", "links", "sizes")}
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([number] * n, pa.int64()), "_0": batch.column(1).slice(i, n), **{k: pa.array(c.per_text(v), pa.int64()) for k, v in zip(numbers, (c.n_a, c.n_b, c.n_groups, c.n_links), strict=True)},
                    "groups_sha256": pa.array(digests, pa.string()), "units": pa.array([units[x:y].tobytes() if ok else b"" for ok, x, y in zip(c.fits.tolist(), c.row[:-1].tolist(), c.row[1:].tolist(), strict=True)], pa.binary()), **nothing})
                if len(pairs):
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([number], pa.int64()), "_0": pa.nulls(1, batch.column(1).type), **{k: pa.nulls(1, pa.int64()) for k in numbers}, "groups_sha256": pa.nulls(1, pa.string()), "units": pa.nulls(1, pa.binary()),
                        "pairs": [pairs.astype("<u8").tobytes()], "counts": [counts.tobytes()], "links": [link.astype("<u4").tobytes()], "sizes": [c.n_links.astype("<u4").tobytes()]})

    made = kept(frame.mapInArrow(run, schema), "aligned", codec="zstd")
    chunks = made.where("pairs IS NOT NULL")
    size = chunks.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0
    counted = kept(_exchanged(chunks, max(1, -(-2 * size // block_bytes)), n_b), "counted", codec="zstd")
    most = np.zeros(n_b, np.uint64)  # one number per id of B: bounded by the vocabulary
    for r in counted.where("ids IS NOT NULL").select(F.explode(F.arrays_zip("ids", "most")).alias("x")).groupBy("x.ids").agg(F.max("x.most").alias("most")).collect():
        most[r.ids] = r.most

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        whole = rows.filter(pc.is_valid(rows.column("pairs")))
        rows = rows.filter(pc.is_null(rows.column("pairs")))
        per_unit = np.zeros((2, 1), np.int64)
        if len(whole):
            pairs = np.frombuffer(whole.column("pairs")[0].as_buffer(), "<u8")
            totals = np.zeros(len(pairs), np.uint64)
            for p, v in zip(answers.column("pairs"), answers.column("totals"), strict=True):
                totals[np.searchsorted(pairs, np.frombuffer(p.as_buffer(), "<u8"))] = np.frombuffer(v.as_buffer(), "<u8")
            best = totals == most[(pairs % U64(n_b)).astype(np.int64)]
            link, sizes = np.frombuffer(whole.column("links")[0].as_buffer(), "<u4"), np.frombuffer(whole.column("sizes")[0].as_buffer(), "<u4").astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            per_unit = np.stack([np.diff(np.concatenate([[0], np.cumsum(x[link].astype(np.int64))])[cuts]) for x in (best, totals)])
        found = [per_unit[:, np.frombuffer(u.as_buffer(), "<u4")].sum(axis=1) for u in rows.column("units")]
        out = {"_0": rows.column("_0"), **{k: rows.column(k) for k in numbers}, "n_best": pa.array([int(x[0]) for x in found], pa.int64()), "count_sum": pa.array([int(x[1]) for x in found], pa.int64()), "groups_sha256": rows.column("groups_sha256")}
        return pa.table(out)

    answers = counted.where("pairs IS NOT NULL").select("chunk", "pairs", "totals")
    result = made.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"_0 {key}, " + ", ".join(f"{c} long" for c in (*numbers, "n_best", "count_sum")) + ", groups_sha256 string")
    return result.select(F.col("_0").alias(doc_id), *numbers, "n_best", "count_sum", "groups_sha256")
