import sys
from pathlib import Path

import pytest
from llm_fixtures import DOCS, edge_documents, words
from test_decontam import ITEMS
from test_decontam import brute as hits
from test_jaccard import family
from test_near_stage import stays

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from tidemark.llm.catalog import QUERIES  # noqa: E402

COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to", "op2_mixing": "doc_id size source_size target taken",
    "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op4_token_ids": "doc_id start n_tokens ids_crc32",
    "op5_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6_jaccard": "doc_id n_shingles component_id",
    "op7_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8_topk": "query_id rank vec_id score",
    "op9_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op10_language_id": "doc_id held_out lang_pred score",
    "op11_spelling": "word n n_near form form_n root", "op12_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = edge_documents() + family()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, f"http://x/{k}", words(20, k % 7)) for k in range(20)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(k // 3, k % 3, ["user", "assistant"][k % 2], words(9, k)) for k in range(30)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(50 * k, [float(k % 7), 1.0, -0.5]) for k in range(30)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows


def test_registered_queries_return_the_contract(spark, folder):
    at, rows = folder
    counts = {"op1_warc": 20, "op7_chat": 11, "op8_topk": 150}
    for name, columns in COLUMNS.items():
        got = QUERIES[name](spark, at)
        assert set(columns.split()) <= set(got.columns), name
        assert name == "op11_spelling" and got.count() > 0 or got.count() == counts.get(name, len(rows)), name


def test_stages(spark, folder, tmp_path):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumnRenamed("n_chars", "bits")
    before, kept = [tuple(r) for r in docs.collect()], {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, at).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [tuple(r) for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "bits"]
    assert sorted(map(str, kept["language_id"])) == sorted(str(r) for r in before if r[1] and any(c.isalpha() for c in r[1]))
    assert sorted((r[0] for r in kept["near_duplicates"]), key=str) == stays(kept["language_id"])
    bad = [h for h in hits(kept["near_duplicates"], ITEMS) if h[5]]
    assert bad and len(kept["decontaminate"]) == len(kept["near_duplicates"]) - len(bad)
    assert {str(h[0]) for h in bad}.isdisjoint(str(r[0]) for r in kept["decontaminate"] if r[0] is not None)
    assert set(kept["mix_sources"]) <= set(kept["decontaminate"])
    assert len(kept["write_tokens"]) == len(kept["mix_sources"])


def test_run_goes_through_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
