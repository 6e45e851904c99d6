"""Small tables with the cases that every operator has to take."""

import random

WORDS = "the of and river stone light water green under over tall small bright calm deep wide near far old new".split()


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ing", "ed"]) for _ in range(n))


def edge_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls in each column, empty and long texts, repeats, ties."""
    long = words(6000, 1)
    near = words(200, 2).split()
    near2 = list(near)
    near2[100] = "changed"
    base = [
        (1, words(120, 3), "en", "a", 5), (2, words(120, 3), "en", "b", 5), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \t\n", "en", None, 3), (6, long, "en", None, 1),
        (7, " ".join(near), "en", "a", 1), (8, " ".join(near2), "en", "c", 1), (9, "one", "en", "c", 1), (10, "one two", "en", "c", 1), (11, "ONE two", "en", "c", 1), (None, words(50, 4), "en", "a", 1),
        (None, words(50, 5), None, None, 1), (12, "x" * 5000, "en", "d", 1), (13, "été où ça " * 30, "fr", "d", 1), (13, "été où ça " * 30, "fr", "d", 1), (14, "12 345 !!", "en", "d", 1), (None, None, None, None, None),
    ]
    return base + [(100 + k, words(30 + k, 50 + k), ["en", "fr"][k % 2], f"s{k % 3}", k) for k in range(30)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size long, node long, mark long, score double, bits double"


def documents(spark, rows=None, extra=False):
    rows = edge_documents() if rows is None else rows
    if extra:
        return spark.createDataFrame([(*r, 1, 2, 3, 4.0, 5.0) for r in rows], DOCS + EXTRA).repartition(3)
    return spark.createDataFrame(rows, DOCS).repartition(3)
