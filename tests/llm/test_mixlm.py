import math
import re
from collections import Counter

import numpy as np
from llm_fixtures import documents, edge_documents, words
from pyspark.sql import functions as F

from tidemark.llm import mixlm
from tidemark.llm.mixlm import Speller, count_bits, lm_scores


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def base(rows, held):
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update([*split(r[1]), None])
    n, v = sum(count.values()), len(count)
    out = []
    for r in rows:
        w = [*split(r[1]), None]
        out.append((r[0], held(r[0]), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    return sorted(out, key=str)


def test_counts_and_base_equal_brute_force(spark):
    rows = edge_documents()
    held = lambda i: i is not None and i % 3 == 0
    got = lm_scores(documents(spark, rows, extra=True), F.col("doc_id") % 3 == 0).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows, held)
    assert all(math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_beats_the_base_on_held_out_texts(spark):
    other = str.maketrans("aeiou", "uoaei")
    rows = [(k, words(150, k).translate(other if k % 3 else {}), None, None, 1) for k in range(120)]
    got = [r for r in lm_scores(documents(spark, rows), F.col("doc_id") % 10 == 0).collect() if r.held_out]
    assert len(got) == 12 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_spellings_are_a_distribution():
    """Over all strings of up to two letters and longer ones' beginnings, probabilities add up to one."""
    tables = np.zeros((mixlm.CONTEXTS, mixlm.SLOTS, 2), np.float32)
    said = [b"ab", b"a", b"ba", b"abba"]
    count_bits(np.array([len(w) for w in said]), np.frombuffer(b"".join(said), np.uint8), np.ones(4, bool), tables)
    speller = Speller(tables, np.full((mixlm.GATES, mixlm.CONTEXTS), 0.3), np.zeros((mixlm.GATES, mixlm.BUCKETS, 2)))
    one = speller.log10(np.ones(256, np.int64), np.arange(256, dtype=np.uint8))
    assert 0 < (10**one).sum() < 1
    known, other = speller.log10(np.array([2, 2]), np.frombuffer(b"abzq", np.uint8))
    assert known > other


def test_no_training_texts_and_empty_table(spark):
    got = lm_scores(documents(spark, [(1, "a b a", None, None, 1), (2, None, None, None, 1)]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got)] == [(4, 0, 0), (1, 0, 0)] and all(math.isfinite(r.score) for r in got)
    assert lm_scores(documents(spark, []), F.lit(False)).collect() == []
