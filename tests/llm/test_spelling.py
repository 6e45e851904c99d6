import collections
import random
import re
import zlib

import pytest
from llm_fixtures import DOCS, documents, edge_documents

from tidemark.llm.spelling import document_words, spelling_variants

LETTERS = "abé"


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(x) + 1 == len(y) and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(counts, ratio=10):
    near = {x: [y for y in counts if one_edit(x, y)] for x in counts}
    form = {}
    for x in counts:
        best = min(near[x], key=lambda y: (-counts[y], y), default=None)
        form[x] = best if best is not None and counts[best] >= ratio * counts[x] else None
    out = {}
    for x in counts:
        root = x
        while form[root]:
            root = form[root]
        out[x] = (counts[x], len(near[x]), form[x], counts[form[x]] if form[x] else None, root)
    return out


def run(spark, counts, **options):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(frame, **options).collect()}


@pytest.mark.parametrize("tile", [4, 256])
def test_equals_brute_force(spark, tile):
    r = random.Random(3)
    counts = {}
    for k in range(700):
        counts["".join(r.choice(LETTERS) for _ in range(r.choice([2, 3, 6, 7, 7, 8, 8, 9])))] = r.choice([1, 2, 5, 30, 400, 5000])
    counts |= {"x" * 300: 9, "x" * 301: 900, "x" * 302: 90000, "x" * 150 + "y" + "x" * 149: 9, "😀smile": 3, "smile": 50, "𝕏𝕏𝕏": 4, "𝕏𝕏": 44}
    assert run(spark, counts, tile=tile) == brute(counts)


def test_large_groups_are_cut_not_left_out(spark):
    r = random.Random(4)
    counts = {"shared" + "".join(r.choice("abcd") for _ in range(6)) + "ending": r.choice([1, 20, 300]) for _ in range(900)}
    assert run(spark, counts, tile=8) == brute(counts)


def test_hot_keys_go_on_at_once(spark, monkeypatch):
    from tidemark.llm import spelling

    monkeypatch.setattr(spelling, "HOT_ROWS", 20)
    r = random.Random(5)
    counts = {"".join(r.choice("ab") for _ in range(r.choice([7, 8, 9]))): r.choice([1, 20, 300]) for _ in range(400)}
    assert run(spark, counts) == brute(counts)


def test_ties_go_to_the_smallest_word(spark):
    assert run(spark, {"abcdefg": 1, "abcdefz": 10, "abcdefé": 10, "abcdef": 10})["abcdefg"] == (1, 3, "abcdef", 10, "abcdef")


def test_words_of_documents(spark):
    rows = edge_documents() + [(20, "Lighting lighting LIGHTING Ünlighting É×÷ééééé " * 40, "en", "a", 1), (31, "lightning" * 3000 + " lightnin " * 5, None, None, None)]
    want = collections.Counter()
    for i, text, *_ in rows:
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run_ = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run_)
            h = zlib.crc32(f"{'' if i is None else i}:{run_}".encode())
            want[run_[: h % len(run_)] + run_[h % len(run_) + 1 :] if h % 31 == 0 else run_] += 1
    got = {r.word: r.n for r in document_words(documents(spark, rows, extra=True)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_empty_table(spark):
    assert run(spark, {}) == {} and document_words(spark.createDataFrame([], DOCS)).collect() == []
