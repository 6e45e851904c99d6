import hashlib
import re

from llm_fixtures import documents, edge_documents, words

from tidemark.llm import decontam
from tidemark.llm.decontam import build_index, contamination, decontaminated, matches

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, window=13):
    out = []
    for i, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for item, said in items:
            t = split(said)
            n = min(window, len(t))
            for k in range(len(t) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item) if item is not None else "")
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, words(40, 3)), (2, "one two"), (3, None), (4, ""), (5, words(120, 1)), (10, "ÉTÉ, où! ça"), (None, "x" * 5000), (7, words(120, 3)), (7, "ONE")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark):
    docs = edge_documents() + [(900, "before " + words(40, 3) + " after", "en", "a", 1), (901, words(6, 8) + "-" + words(40, 3).upper(), "en", "a", 1)]
    got = [tuple(r) for r in contamination(build_index(documents(spark, docs, extra=True)), items(spark)).drop("mark").collect()]
    assert sorted(got, key=str) == brute(docs, ITEMS)


def test_blocks_of_the_benchmark_give_the_same(spark):
    index = build_index(documents(spark))
    one = sorted(map(str, contamination(index, items(spark)).collect()))
    assert one == sorted(map(str, contamination(index, items(spark), block_words=20).collect()))


def test_proximity(spark):
    docs = [(1, "a b c d", None, None, 1), (2, "a b x c d", None, None, 1), (3, "a x y z b c d", None, None, 1), (4, "a b", None, None, 1), (5, "c d", None, None, 1)]
    phrase = items(spark, [(1, "a b c d")])
    near = lambda s: sorted((r.doc_id, r.first_word, r.last_word) for r in matches(build_index(documents(spark, docs).coalesce(1)), phrase, slack=s).collect())
    assert near(0) == [(1, 0, 3)] and near(1) == [(1, 0, 3), (2, 0, 4)] and near(3) == [(1, 0, 3), (2, 0, 4), (3, 0, 6)]


def test_rows_of_one_id_have_their_own_verdict(spark):
    docs = documents(spark, [(1, words(40, 3), "en", "a", 1), (1, words(50, 77), "en", "a", 1), (None, words(40, 3), "en", "a", 1), (None, words(50, 78), "en", "a", 1)])
    assert sorted(r.text for r in decontaminated(docs, items(spark)).collect()) == sorted([words(50, 77), words(50, 78)])


def test_candidate_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CANDIDATES", 3)
    assert contamination(build_index(documents(spark, [])), items(spark)).collect() == []
    assert not any(r.contaminated for r in contamination(build_index(documents(spark)), items(spark, [])).collect())
    got = [tuple(r) for r in contamination(build_index(documents(spark)), items(spark)).drop("mark").collect()]
    assert sorted(got, key=str) == brute(edge_documents(), ITEMS)
