import random
import re

from llm_fixtures import DOCS, documents, edge_documents, words

from tidemark.llm import jaccard
from tidemark.llm.jaccard import Bands, components, jaccard_components, parities, signatures

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        out.append((r[0], len(sets[k]), min(ids) if ids and sets[k] else r[0] if not sets[k] else None))
    return sorted(out, key=str)


def changed(text, spots):
    w = text.split()
    for s in spots:
        w[s] = f"new{s}"
    return " ".join(w)


def family():
    base = words(300, 9)
    rows = [(1000 + k, changed(base, [7 * k % 290, (13 * k + 90) % 290][: 1 + k % 2]), None, None, 1) for k in range(40)]
    rows += [(1100 + k, changed(base, range(k, 290, 25 - k)), None, None, 1) for k in range(12)]
    short = words(14, 10)
    return rows + [(1200 + k, changed(short, [k]), None, None, 1) for k in range(14)] + [(1300, short, None, None, 1), (1301, short + " more", None, None, 1)]


def test_sets_that_meet_only_behind_another_of_their_run(spark):
    """All signatures that x and y share are also a's, which is like neither and stands before x in the same run."""
    rows = []
    for k, (n, seed) in enumerate([(22, 80), (24, 16), (24, 84), (26, 46), (30, 4), (30, 30), (34, 392), (22, 119)]):
        w = words(n, seed).split()
        a = ["odd", *w[1:-1], "last"] if seed % 2 else [*w[:-2], "odd", "last"]
        rows += [(10 * k + j, " ".join(t), "en", "a", 1) for j, t in enumerate((a, w, [*w[:-1], "other"]))]
    rows.sort(key=lambda r: (r[0] % 10 == 2, r[0]))  # eight rows a run: each x behind its a, every y in the last
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), DOCS)
    got = jaccard_components(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_equals_brute_force(spark):
    rows = edge_documents() + family()
    got = jaccard_components(documents(spark, rows, extra=True))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_other_thresholds(spark):
    rows = family()
    for percent in (80, 95, 100):
        got = jaccard_components(documents(spark, rows), percent=percent)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, percent), percent


def test_linked_sets_share_a_signature_and_pass_the_sketch():
    import numpy as np

    rng, bands = np.random.default_rng(3), Bands(90)
    for n in [1, 2, 5, 9, 10, 11, 19, 20, 40, 57, 58, 100, 333, 2000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            out = int(rng.integers(0, n // 10 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[out:]], rng.integers(0, 2**63, int(rng.integers(0, 2 + n // 20))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert np.intersect1d(signatures(a, bands), signatures(b, bands)).size, n
                x, y = parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64).tolist()) <= len(a) + len(b) - 2 * both


def test_linked_sets_share_more_signatures_than_they_can_spare():
    import numpy as np

    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = Bands(percent)
        for n in [5, 12, 19, 40, 58, 100, 333, 1000, 2500]:
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                most = 100 * n // percent - n
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[: n - int(rng.integers(0, n - n * percent // 100 + 1))]], rng.integers(0, 2**63, int(rng.integers(0, most + 1))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    shared = np.intersect1d(signatures(a, bands), signatures(b, bands)).size
                    assert shared > min(bands.spare(len(a)), bands.spare(len(b))), (percent, n)


def test_texts_with_a_common_passage_make_few_pairs(spark, monkeypatch):
    """Signatures of the passage alone are left out: 80 unlike texts that hold it hardly form a pair."""
    made, plain = {}, jaccard.kept

    def counted(df, name, *args):
        out = plain(df, name, *args)
        made[name] = made.get(name, 0) + (out.count() if name in ("star-pairs", "pairs") and "least" in out.columns else 0)
        return out

    monkeypatch.setattr(jaccard, "kept", counted)
    rng, common = random.Random(1), [f"c{k}" for k in range(40)]
    rows = [(k, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(1000)]), "en", "a", 1) for k in range(80)]
    got = jaccard_components(documents(spark, rows), shingle=5, percent=80).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 80
    assert made["star-pairs"] + made["pairs"] <= 8


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 90), (91, 90), (91, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {90: 90, 91: 90, 100: 90}


def test_empty_table(spark):
    assert jaccard_components(documents(spark, [])).collect() == []
