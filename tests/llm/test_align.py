import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import DOCS, documents, edge_documents

from tidemark.llm.align import align, alignment_digest, byte_letters, diagonals, merge_path, tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" lead", "trail ", "a  b", "a\n  b", "x  y", "x　 y  z", "▁ a", "<|endoftext|> <s> </s> <0x41>", "tab\t\t x", "中文 没有 空格", "emoji 😀 😀😀", "é é", "it's we'll", "\x00 a", "\r\n \r\n",
       " ", "   ", "a​ b", "ﬁ ½ Å", "1 23 456 7890", "  x \u0085 y", "x" * 40_000, "word " * 9_000]


def plain_links(ends_a, ends_b):
    starts = lambda e: [0, *e[:-1]]
    return [(i, j) for i, (s, e) in enumerate(zip(starts(ends_a), ends_a, strict=True)) for j, (x, y) in enumerate(zip(starts(ends_b), ends_b, strict=True)) if max(s, x) < min(e, y)]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 256])
def test_merge_path(piece):
    r = random.Random(piece)
    for _ in range(60):
        total = r.randrange(1, 40)
        a, b = (sorted({total, *(r.randrange(1, total + 1) for _ in range(r.randrange(0, 30)))}) for _ in range(2))
        i, j, x, y = merge_path(np.array(a), np.array(b), piece)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == plain_links(a, b)
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(a.index(e) + 1, b.index(e) + 1) for e in a if e in b]
        merged = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
        d, e = diagonals(np.array(a), np.array(b), piece)
        assert d.tolist() == [sum(k == 0 for _, k in merged[: n * piece]) for n in range(len(d))] and (d + e).tolist() == [n * piece for n in range(len(d))]
    assert [len(v) for v in merge_path(np.zeros(0, np.int64), np.zeros(0, np.int64), piece)] == [0, 0, 0, 0]


def brute(rows):
    """doc_id and the contract's columns, from whole texts and plain loops."""
    t, counts, made = tokenizers(A, B), collections.Counter(), []
    letters = byte_letters()
    vocab = {k: bytes(letters[c] for c in s) for s, k in t.a.get_vocab().items() if all(c in letters for c in s)}
    for doc_id, text, *_ in rows:
        a = t.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        said_a = [vocab[k] for k in a]
        said_b = [bytes([int(t.b.id_to_piece(k)[3:5], 16)]) if t.b.is_byte(k) else t.b.id_to_piece(k).replace("▁", " ").encode() for k in b]
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(said_a) != whole or b"".join(said_b) != whole:
            made.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
        links, j = [], 0
        for i, end in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        both = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = {e: i + 1 for i, e in enumerate(ends_a)}, {e: i + 1 for i, e in enumerate(ends_b)}
        counts.update(links)
        made.append((doc_id, a, b, [(at_a[e], at_b[e]) for e in both], links))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, groups, links in made:
        said = ";".join(",".join(map(str, a[x:z])) + "|" + ",".join(map(str, b[y:w])) for (x, y), (z, w) in zip([(0, 0), *groups][:-1], groups, strict=True))
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out, made


def rows_of():
    return edge_documents() + [(500 + k, x, "en", "a", 1) for k, x in enumerate(ODD)]


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_digest_equals_brute_force(spark, chunk_bytes):
    rows = rows_of()
    got = alignment_digest(documents(spark, rows, extra=True), A, B, chunk_bytes=chunk_bytes, block_bytes=1 << 12, piece=50)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)[0]))


def test_lists_of_a_text(spark):
    rows = rows_of()
    got = align(documents(spark, rows), A, B, keep=["doc_id", "text"], chunk_bytes=5000).collect()
    assert sorted(str((r.doc_id, r.a_ids, r.b_ids, list(zip(r.a_ends, r.b_ends, strict=True)))) for r in got) == sorted(str(m[:4]) for m in brute(rows)[1])


def test_whole_texts_where_units_are_not_sure(spark, monkeypatch):
    t = tokenizers(A, B)
    assert t.by_units
    raw = np.frombuffer(b" one two three", np.uint8)
    offs = np.array([0, 8, 14])
    assert t.cuts(raw, offs).tolist() == [0, 4, 8]
    monkeypatch.setattr(t, "by_units", False)
    assert t.cuts(raw, offs).tolist() == [0, 8]
    ids, n = t._joined([b" one two", b" three"], [" one two", " three"])
    assert n.tolist() == [2, 1] and ids.tolist() == t.a.encode(" one two three", add_special_tokens=False).ids


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert alignment_digest(empty, A, B).collect() == [] and align(empty, A, B, keep=["doc_id"]).collect() == []
