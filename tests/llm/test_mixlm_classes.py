import numpy as np
from llm_fixtures import documents, words
from pyspark.sql import functions as F

from tidemark.llm import mixlm
from tidemark.llm.common import PLAIN_WORD, word_bounds, word_hashes


def kinds(texts, logs):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    starts, ends, first = word_bounds(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), PLAIN_WORD)
    return mixlm.text_kinds(word_hashes(raw, starts, ends), first, logs).tolist()


def test_classes_are_fitted_on_all_texts(spark):
    """Long texts count: two kinds of them get classes of their own, and every word is in a class's sum."""
    swap = str.maketrans("aeiou", "uoaei")
    texts = [words(4500, k).translate(swap if k % 2 else {}) for k in range(20)]
    assert min(map(len, texts)) > 20_000
    docs = documents(spark, [(k, t, None, None, 1) for k, t in enumerate(texts)]).withColumn("held", F.col("doc_id") >= 16)
    logs = mixlm.document_classes(docs)
    got = kinds(texts, logs)
    assert set(got[0::2]).isdisjoint(got[1::2])
    assert np.allclose(np.exp(logs).sum(axis=0), 1)
    counts = mixlm.class_counts(docs, logs)
    assert counts.sum() == 16 * 4500 and [int(c) for c in counts.sum(axis=0)] == [4500 * got[:16].count(k) for k in range(mixlm.CLASSES)]
