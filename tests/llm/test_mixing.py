from collections import Counter

import numpy as np
from llm_fixtures import documents, words

from tidemark.llm import mixing
from tidemark.llm.mixing import mix, mixed_sizes, source_targets


def fill(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, done, out = sum(sizes.values()), {}, {}
    while len(done) < len(names):
        rest = [s for s in names if s not in done]
        level = (total - sum(done.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > most * sizes[s]]
        if not over:
            return out | done | {s: level * w[s] for s in rest}
        done |= {s: most * sizes[s] for s in over}
    return done


def test_targets_equal_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "Z": 70, "é": 1, None: 40, "empty": 0}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_edge_rows_and_reruns(spark):
    docs = documents(spark, extra=True)
    got = sorted(map(tuple, mixed_sizes(docs).collect()), key=str)
    assert len(got) == docs.count() and got == sorted(map(tuple, mixed_sizes(docs.repartition(5)).collect()), key=str)
    assert all(0 <= r[6] <= 3 for r in got) and all(r[6] == 0 for r in got if r[3] == 0)
    mixed = mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[6] for r in got)


def test_sources_come_near_their_targets_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    monkeypatch.setattr(mixing, "RESERVE_ROWS", 20)
    rows = [(k, words(5 + k % 40, k), "en", "big" if k % 3 else f"s{k % 5}", 1) for k in range(900)]
    got = mixed_sizes(documents(spark, rows)).collect()
    assert len(got) == 900
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(45, 0.02 * t) for s, t in target.items())


def test_duels_keep_expectations():
    rng, total = np.random.default_rng(1), np.zeros(40)
    sizes, p = np.sort(rng.integers(1, 50, 40))[::-1].astype(float), np.full(40, 0.3)
    for k in range(3000):
        q = p.copy()
        mixing.spread(sizes, q, -1, np.random.default_rng(k))
        assert set(q) <= {0.0, 1.0} and abs((sizes * q).sum() - 0.3 * sizes.sum()) <= 50
        total += q
    assert np.abs(total / 3000 - 0.3).max() < 0.06


def test_empty_table(spark):
    assert mixed_sizes(documents(spark, [])).collect() == [] and mix(documents(spark, [])).collect() == []
