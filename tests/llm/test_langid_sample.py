from llm_fixtures import DOCS, documents
from pyspark.sql import functions as F
from test_langid import texts

from tidemark.llm.langid import _sample, fit, predict


def test_long_documents_and_rare_languages_are_learned(spark):
    long = [(5000 + k, "яблоко груша вишня слива " * 1200, "ru", "s", 1) for k in range(12)]
    rare = [(6000 + k, f"{chr(0x0531 + k)}{chr(0x0561 + k)} " * 30, f"r{k:02}", "s", 1) for k in range(24)]
    docs = documents(spark, texts(200, 1) + long + rare)
    models = fit(docs, F.lit(True))
    assert models.languages == sorted({"aa", "bb", "cc", "ru"} | {r[2] for r in rare})
    got = predict(docs, models, keep=["doc_id", "lang"]).where("doc_id >= 5000").collect()
    assert len(got) == 36 and all(r.lang_pred == r.lang and not r.rejected for r in got)


def test_sample_is_of_rows_that_can_be_learned_from(spark):
    def picked(rows, n, chars=100):
        found = _sample(spark.createDataFrame(rows, DOCS).repartition(3), F.lit(True), "doc_id", "text", "lang", n, chars).collect()
        assert all(0 < len(r.text) <= chars and any(c.isalpha() for c in r.text) for r in found)
        return len(found), sum(r.fold == 0 for r in found)

    mostly_long = [(k, f"w{k} ab " * 100, "x", None, 1) for k in range(1000)] + [(2000 + k, f"short {k}", "x", None, 1) for k in range(10)]
    for rows in (mostly_long, [(None, f"word {k}", "x", None, 1) for k in range(1000)], mostly_long + [(3000, "123", "x", None, 1)] * 9000, [(1, "same", "x", None, 1)] * 5000 + [(k, "other", "x", None, 1) for k in range(1000)]):
        n, held = picked(rows, 200)
        assert 140 < n < 270 and held == n // 4
    assert picked([(k, "ab", "x", None, 1) for k in range(3)], 200) == (3, 0)
    assert picked([(1, " " * 500 + "a" + " " * 500, "x", None, 1)], 200, 5) == (1, 0)
