"""The running text goes through the context predictors, frequencies counted."""

import math

import numpy as np
from llm_fixtures import documents, words
from pyspark.sql import functions as F

from tidemark.llm import contexts
from tidemark.llm.contexts import DEPTH, SIZES, Asks, Coder, context_logs, packed, sizes_of, unpacked
from tidemark.llm.mixlm import lm_scores


def coder(counts):
    said = np.array(counts)
    return Coder(np.bincount(sizes_of(said), minlength=SIZES), np.bincount(sizes_of(said), said, SIZES))


def ranked(counts):
    """Ranks of words with these counts: larger classes of counts first."""
    order = np.argsort(-sizes_of(np.array(counts)), kind="stable")
    ranks = np.empty(len(counts), np.int64)
    ranks[order] = np.arange(len(counts))
    return ranks


def test_a_sentence_that_training_repeats_is_far_below_its_unigram_bits(spark):
    """Words of the sentence are as common elsewhere; only what stands before them tells."""
    noise = [words(200, k) for k in range(40)]
    sentence = " ".join(words(400, 99).split()[:60])
    rows = [(k, t, None, None, 1) for k, t in enumerate(noise)] + [(k, sentence, None, None, 1) for k in range(100, 104)]
    shuffled = " ".join(sorted(sentence.split(), key=lambda w: (w[::-1], len(w))))
    rows += [(1000, sentence, None, None, 1), (1001, shuffled, None, None, 1)]
    got = {r.doc_id: r for r in lm_scores(documents(spark, rows), F.col("doc_id") >= 1000).collect()}
    assert got[1000].held_out and math.isclose(got[1000].base_score, got[1001].base_score, abs_tol=1e-9)
    assert got[1000].score > got[1000].base_score / 2
    assert got[1000].score > got[1001].score / 2
    # a training text is predicted without itself: one that stands once is not taken for a copy
    assert got[100].bits_per_byte < 0.5 * min(got[k].bits_per_byte for k in range(40))


def test_frequencies_count():
    """The word that follows a pair nine times of ten is likelier than the one that follows it once."""
    counts = [9, 9, 9, 9]
    c, ranks = coder(counts), ranked(counts)
    logs = context_logs(np.ones(4, np.uint64), np.zeros(4, np.uint8), np.array([9, 1, 0, 0]), ranks[[0, 1, 0, 1]], c)
    assert logs[2] > math.log(0.6) and logs[3] < math.log(0.25)


def test_each_context_gives_a_distribution():
    counts = [1, 1, 1, 2, 3, 5, 6, 40, 41, 300, 1, 2]
    c, ranks = coder(counts), ranked(counts)
    seen = [(1, 0, 3, 7), (1, 0, 2, 4), (1, 7, 1, 0), (1, 7, 9, 9), (2, 0, 1, 5)]  # pair, byte, times, word
    for pair, near in ((1, 0), (1, 7), (1, 9), (2, 0), (3, 0)):
        rows = [(*x[:3], ranks[x[3]]) for x in seen] + [(pair, near, 0, r) for r in ranks]
        p, n, t, r = (np.array(x) for x in zip(*rows, strict=True))
        logs = context_logs(p.astype(np.uint64), n.astype(np.uint8), t, r, c)
        assert math.isclose(np.exp(logs[len(seen):]).sum(), 1.0, rel_tol=1e-5)


def test_seen_counts_equal_a_plain_loop(monkeypatch):
    """What the mixer is given, row by row and bit by bit, against counting all training words anew."""
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 60, 25).tolist()
    c, ranks = coder(counts), np.arange(25)
    rows = {(int(rng.integers(3)), int(rng.integers(2)), int(rng.choice(ranks)), bool(rng.integers(2))) for _ in range(90)}
    rows = [(p, n, 0 if held else int(rng.integers(1, 5)), r) for p, n, r, held in sorted(rows)]
    given = []
    plain = contexts.Mixer.log_p
    monkeypatch.setattr(contexts.Mixer, "log_p", lambda self, gate, x, times: given.append(x) or plain(self, gate, x, times))
    p, n, t, r = (np.array(x) for x in zip(*rows, strict=True))
    context_logs(p.astype(np.uint64), n.astype(np.uint8), t, r, c)
    code = dict(zip(ranks.tolist(), c.codes(ranks).tolist(), strict=True))
    want = []
    for pair, near, times, rank in rows:
        for d in range(DEPTH):
            with_ = lambda bits, same: sum(y[2] for y in rows if same(y) and code[y[3]] >> (DEPTH - bits) == code[rank] >> (DEPTH - bits)) - (times > 0)
            two, three = (lambda y: y[0] == pair), (lambda y: y[:2] == (pair, near))
            mine, rest = (float(x[0]) for x in c.ways(np.array([code[rank]]), d))
            if rest > 0 and with_(d, two) > 0:
                took, took3 = with_(d + 1, two), with_(d + 1, three)
                want.append((math.log(mine / rest), math.log((took + 0.4) / (with_(d, two) - took + 0.4)), math.log((took3 + 0.4) / (with_(d, three) - took3 + 0.4))))
    same = lambda rows: sorted(tuple(round(v, 4) + 0.0 for v in row) for row in rows)
    got = same(x for g in given for x in g.T.tolist())
    assert len(got) > 100 and got == same(want)


def test_codes_are_a_prefix_code_and_keep_every_word():
    counts = [1] * 5 + [2, 3, 2] + [1000] * 9
    c, ranks = coder(counts), np.arange(17)
    assert len(set(c.codes(ranks).tolist())) == 17 and c.n_words == 17
    assert np.all(sizes_of(np.array(counts))[np.argsort(ranked(counts))] == c.classes(ranks))
    assert math.isclose(np.exp(c.alone(ranks)).sum(), 1.0)
    for a in (np.arange(7, dtype=np.int64), np.zeros(0, np.uint32), np.array([3], np.uint8)):
        assert np.array_equal(unpacked(packed(a), a.dtype), a)


def test_every_token_is_asked_for_once():
    """Repeats in a run are one ask that counts them; texts don't see each other; unknown words ask nothing."""
    ranks = np.array([0, 1, 2, -1])
    which, per = np.array([0, 1, 2, 0, 1, 2, 3, 1, 0]), np.array([3, 3, 3])
    a = Asks(which, per, np.array([False, False, True]), ranks, 3, 4)
    assert a.asked.tolist() == [0, 1, 2, 3, 4, 5] and a.times.sum() == 6 and len(a.times) == 3
    got = [np.repeat(unpacked(x[0], np.uint64), unpacked(x[1], np.uint32)) for _, x in a.rows()]
    assert sum(map(len, got)) == 3 and len({s for s, _ in a.rows()}) == len(got)
    assert {(int(p) >> 32, int(p) & 3) for p in np.concatenate(got)} == {(3, 3), (0, 3), (1, 0)}
    out = a.answered(np.array([-1.0, -2.0, -3.0, -np.inf]), which, np.array([1024, 2048, 512], np.uint16))
    assert np.all(out[6:] == [-np.inf, -2.0, -1.0]) and set(out[:6].tolist()) == {-1.0, -2.0, -0.5}
