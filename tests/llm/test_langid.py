import random

import numpy as np
from llm_fixtures import DOCS, documents, edge_documents
from pyspark.sql import functions as F

from tidemark.llm.langid import Models, fit, gram_hash, held_out, predict, symbols

PARTS = {"aa": "ka to mi ra so ne hi".split(), "bb": "sch ung ein der ach icht".split(), "cc": "eau oi ent ais que ré".split()}


def texts(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(PARTS))
        rows.append((k, " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40))) + ".", lang, "s", 1))
    return rows


def test_held_out_accuracy_and_rejection(spark):
    docs = documents(spark, texts(400, 1) + [(9000, None, "aa", "s", 1), (9001, "12 !!", "bb", "s", 1), (9002, "", None, None, None), (None, "ka to mi", "aa", "s", 1), (9003, "яблоко груша вишня слива " * 9, None, "s", 1)], extra=True)
    held = held_out(F.col("doc_id"), 4, 2)
    models = fit(docs, F.col("doc_id").isNotNull() & ~held)
    got = predict(docs.withColumn("held_out", held), models, keep=["doc_id", "lang", "held_out", "size"]).collect()
    known = [r for r in got if r.lang and r.held_out and r.doc_id < 9000]
    assert len(got) == 405 and sum(r.lang == r.lang_pred for r in known) >= 0.97 * len(known) and not any(r.rejected for r in known)
    odd = {r.doc_id: r for r in got}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].rejected for i in (9000, 9001, 9002))
    assert odd[9003].rejected and odd[9003].lang_pred in PARTS and odd[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_probabilities_add_up():
    chars = np.array([[32, 32, 32, 97], [32, 32, 97, 98], [32, 97, 98, 32], [97, 98, 32, 97], [32, 32, 32, 98], [32, 32, 98, 97]])
    models = Models(["x"], np.zeros(6, np.int64), chars, np.array([3.0, 1, 2, 1, 1, 4]))
    for context in ([32, 32, 32], [32, 32, 97], [1, 2, 3], [32, 97, 98]):
        grams = np.array([[*context, c] for c in (97, 98, 32, 5)])
        assert abs(np.exp2(-models.bits(grams)[:, 0]).sum() - 1) < 1e-5
    assert len(set(gram_hash(chars).tolist())) == 6


def test_symbols_of_rows():
    said = ["Ab, c!", "", "9", "É", "x"]
    raw = np.frombuffer("".join(said).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(s.encode()) for s in said])])
    sym, bounds, letters = symbols(raw, offs)
    assert ["".join(map(chr, sym[a:b])) for a, b in bounds] == ["ab c ", "", "", "é ", "x "] and letters.tolist() == [3, 0, 0, 1, 1]


def test_nothing_learned_and_empty_table(spark):
    models = fit(documents(spark), F.lit(False))
    assert {r.lang_pred for r in predict(documents(spark), models, keep=["doc_id"]).collect()} == {"und"}
    models = fit(documents(spark), F.lit(True))
    assert len(predict(documents(spark), models, keep=["doc_id"]).collect()) == len(edge_documents())
    assert predict(spark.createDataFrame([], DOCS), models, keep=["doc_id"]).collect() == []
