"""Registered queries of the operators over whole tables, with checking SQL where SQL has the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .align import alignment_digest
from .chat import format_conversations, format_digest
from .common import kept, shared_dir
from .decontam import build_index, contamination
from .jaccard import jaccard_components
from .langid import fit, held_out, predict
from .licenses import license_digest
from .mixlm import lm_scores
from .mixing import mixed_sizes
from .spelling import document_words, spelling_variants
from .suffix import repeated_spans, span_digest
from .topk import top_k
from .warc import warc_round_trip
from .wavelet import token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc", oracles.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages"), f"{shared_dir(spark, 'warc')}/archive").drop("url")


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixed_sizes(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (drawn.copies * drawn["size"]).alias("taken"))


@query("op3_decontamination", oracles.DECONTAMINATION)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("mark")


@query("op4_token_ids")
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), f"{shared_dir(spark, 'tokens')}/shards", word_tokenizer(), end_id=2)


@query("op8_topk", oracles.TOPK)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op7_chat", oracles.CHAT)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_digest(format_conversations(table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    models = fit(docs, F.col("doc_id").isNotNull() & ~held)
    return predict(docs.withColumn("held_out", held), models, keep=["doc_id", "held_out"])


@query("op6_jaccard", oracles.JACCARD)
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("mark", "group")


@query("op5_lm_scores")
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(repeated_spans(table(spark, sf_dir, "documents")))


@query("op11_spelling", oracles.SPELLING)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(kept(document_words(table(spark, sf_dir, "documents")), "words"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_licenses", oracles.LICENSES)
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))
