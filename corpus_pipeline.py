"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.catalog import word_tokenizer
from tidemark.llm.common import kept, shared_dir
from tidemark.llm.decontam import decontaminated
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.langid import fit, predict
from tidemark.llm.mixing import mix
from tidemark.llm.wavelet import token_ids


BATCH_ROWS = "1000"
#: Near duplicates of a corpus: documents that share 80 % of their runs of five words.  op6's query has limits of its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def small_batches(spark: SparkSession) -> None:
    """Rows per Arrow batch: whole texts of any length go to the workers, so a batch holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: texts that are null or without letters, and texts further from all
    learned languages than any held-back labelled text by a margin.  Models are learned from the rows
    with a ``lang``; without any, only texts without letters go."""
    small_batches(spark)
    models = fit(docs, F.lit(True))
    plain = docs.toDF(*[f"__{k}" for k in range(len(docs.columns))])  # extra columns may have any name
    text = plain.columns[docs.columns.index("text")]
    named = predict(plain, models, text=text, keep=plain.columns)
    gone = F.col("rejected") if models.languages else ~F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return named.where(~gone).select(plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays: that of the smallest doc_id (null last), then of
    the smallest text hash; of equal rows, one.  Rows without words stay.  Only the keys of rows that go
    are joined to the documents."""
    small_batches(spark)
    found = kept(jaccard_components(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT), "components").where("n_shingles > 0")
    stays = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = found.join(stays, "group").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("mark") == F.col("stays.mark"))).alias("stays"))
    gone = kept(member.where("NOT stays").select("__id", "__mark").distinct(), "gone")
    several = kept(member.where("stays").groupBy("__id", "__mark").count().where("count > 1"), "several")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__mark"))
    left = docs.join(gone, same, "left_anti")
    if several.isEmpty():
        return left
    once = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1)))
    one = left.join(several, same, "left_semi").withColumn("__row", once).where("__row = 1").select(docs.columns)
    return left.join(several, same, "left_anti").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in 20 stands in a benchmark phrase."""
    small_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; each document stands as often as the mix draws it."""
    small_batches(spark)
    return mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet-matrix files; returns doc_id, start, n_tokens and ids_crc32 read back from them."""
    small_batches(spark)
    return token_ids(docs, f"{shared_dir(spark, 'tokens')}/shards", word_tokenizer(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("write_tokens", write_tokens),
]
#: The mix draws at random and the first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage keeps is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark, 'pipeline')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
