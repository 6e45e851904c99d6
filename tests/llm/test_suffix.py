import random
from collections import Counter

from llm_fixtures import documents, edge_documents, words

from tidemark.llm.suffix import repeated_spans, span_digest


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        starts = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(t), sum(gone), starts, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run(spark, rows, length):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeated_spans(documents(spark, rows, extra=True), length=length).collect()), key=str)


def passages(length):
    r = random.Random(4)
    shared = [words(n, 300 + n) for n in (30, 60, 100)]
    rows = []
    for k in range(60):
        parts = [words(r.randrange(5, 60), 500 + k)] + [x for s in r.sample(shared, r.randrange(0, 3)) for x in (s[r.randrange(0, 20) :], words(r.randrange(3, 30), 700 + k))]
        rows.append((2000 + k, r.choice(["", " "]).join(parts), None, None, 1))
    return rows + [(3000, "a" * (length + 3), None, None, 1), (3001, "a" * (length - 1), None, None, 1), (3002, "ab" * length, None, None, 1), (3003, "é" * length, None, None, 1), (3004, words(80, 1) + words(80, 1), None, None, 1)]


def test_equals_brute_force(spark):
    for length in (60, 150, 400):
        rows = edge_documents() + passages(length)
        assert run(spark, rows, length) == brute(rows, length), length


def test_digest_and_empty_table(spark):
    text = words(200, 1)
    got = [tuple(r) for r in span_digest(repeated_spans(documents(spark, [(1, text, None, None, 1), (2, text, None, None, 1), (3, None, None, None, 1)]))).collect()]
    none = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert sorted(got) == [(1, len(text), len(text), 1, none), (2, len(text), len(text), 1, none), (3, 0, 0, 0, none)]
    assert repeated_spans(documents(spark, [])).collect() == []
