import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import documents, edge_documents
from tokenizers import Tokenizer

from tidemark.llm import wavelet
from tidemark.llm.common import text_slices, write_file
from tidemark.llm.wavelet import WaveletFile, WordEncoder, pack, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 2), (70_000, 49_408), (300, 2**20)])
def test_file_equals_the_ids(tmp_path, n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    if n > 10:
        ids[::3] = 1
    path = str(tmp_path / "x.wvm")
    write_file(path, pack([5, None, 7], np.array([n // 2, 0, n - n // 2]), ids))
    f = WaveletFile(path)
    assert (f.decode() == ids).all() and f.doc_ids == [5, None, 7] and f.starts.tolist() == [0, n // 2, n // 2, n]
    for i in range(0, n, max(1, n // 50)):
        assert f.access(i) == ids[i] and f.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    for t in set(ids[:5].tolist()):
        where = np.flatnonzero(ids == t)
        assert f.count(t) == len(where) and f.count(t, n // 4, n // 2) == (ids[n // 4 : n // 2] == t).sum()
        assert f.select(t, 0) == where[0] and f.select(t, len(where) - 1) == where[-1]
    assert f.count(2**25) == 0
    with pytest.raises(IndexError):
        f.access(n)
    f.close()


HARD = ["don't say 'tis (well's) ('s it's,' I'M we'LL", "a—,b café, naïve! e\u0301x \u00a0y\u2028z", "<|endoftext|> x<|startoftext|>,y <|", "1st 22nd a1b2 x_y http://a.b/c?d=e", "\x02 a\x02b \x00\x1f", "𝒜𝒷 漢字,かな ИЖ;ж ΑΣ Σ.", "", "  \n\t", "can''t ''' 's's 'st", "A"*3000, "straße İstanbul ǅ ﬁ"]


def test_pieces_equal_whole_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(wavelet, "CACHE_WORDS", 5)
    code, whole = WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = HARD + [r[1] or "" for r in edge_documents()]
    for limit in (1, 1 << 20):
        got = []
        for _, _, raw, offs in text_slices(pa.record_batch({"t": pa.array(texts)}), "t", limit):
            ids, n = code.encode(raw, offs)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_read_back_from_their_files(spark, tmp_path):
    rows = [(k, t, None, None, 1) for k, t in enumerate(HARD)] + edge_documents()
    got = token_ids(documents(spark, rows, extra=True), str(tmp_path / "shards"), PATH, shards=5, shard_tokens=500).collect()
    whole = Tokenizer.from_file(PATH)
    ids = {(r[0], zlib.crc32(np.array(e := [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()), len(e)) for r in rows}
    assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == ids and len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_empty_table(spark, tmp_path):
    assert token_ids(documents(spark, []), str(tmp_path / "shards"), PATH).collect() == []
