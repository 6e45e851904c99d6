"""Parquet/CSV/JSON tables: scans, bucketed writes, upserts and ledgers (IO1-IO19)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.functions.symbols import hash_shard, pad_symbol
from tidemark.operators.archive import merge_shards
from tidemark.operators.checks import Checked, DataQualityError, latest_per_key
from tidemark.operators.evidence import DEPTH, FAN, append_plan, compare_snapshots, differing_leaves, hash_tree, key_leaf
from tidemark.operators.factors import changed_panel, extend_panel, factor_panel, panel_tail, validate_bars
from tidemark.operators.normalize import FACT_KEY, validate_facts, validate_master
from tidemark.operators.pit import merge_facts
from tidemark.operators.reconstruct import Reconstruction
from tidemark.sources.keyed import append_keyed, read_keyed
from tidemark.sources.scratch import settled

BUCKETS = 64
_BUCKETED_BARS = T.StructType([*S.BARS.fields, T.StructField("bucket", T.IntegerType()), T.StructField("month", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


_PARTS = ["bucket", "month"]


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumns({"bucket": hash_shard(F.col("symbol"), buckets), "month": F.date_format("trade_date", "yyyy-MM")})


def _write_buckets(df: DataFrame, path: str, mode: str) -> None:
    """One folder per bucket and month. The rebalance hint lets AQE split a folder that holds most rows."""
    (
        df.hint("rebalance", *_PARTS).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(path)
    )


def stored_buckets(spark: SparkSession, root: str, buckets: int | None = None) -> int:
    """The bucket count that was stored with the table; another one asked for is an error."""
    stored = int(spark.read.text(f"{root}/_buckets").first()[0])
    if buckets is not None and buckets != stored:
        raise ValueError(f"{root} has {stored} buckets, not {buckets}")
    return stored


def write_bars(bars: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """IO2: validate (fail closed), then write by symbol bucket and month; the bucket count is stored beside."""
    _write_buckets(_bucketed(validate_bars(bars).require(), buckets), root, "overwrite")
    bars.sparkSession.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_buckets")


def read_bars(spark: SparkSession, root: str, symbols: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """IO1: bars; a symbol list prunes bucket folders and pushes down to Parquet."""
    df = spark.read.schema(_BUCKETED_BARS).parquet(root)
    count = stored_buckets(spark, root, buckets)
    if symbols:
        wanted = [s.zfill(6) for s in symbols]
        ids = sorted({int(hashlib.sha256(s.encode()).hexdigest()[:16], 16) % count for s in wanted})
        df = df.where(F.col("bucket").isin(*ids) & F.col("symbol").isin(*wanted))
    return df.select(*S.BARS.names)


def merge_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """IO3 as a query: one bar per (symbol, day), the incoming one on a tie."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    return latest_per_key(both, ["symbol", "trade_date"], ["_batch"]).drop("_batch")


def upsert_bars(spark: SparkSession, incoming: DataFrame, root: str, buckets: int | None = None) -> None:
    """IO3: rewrite only the bucket and month folders that the incoming bars touch (dynamic partition overwrite)."""
    if not _exists(spark, root):
        write_bars(incoming, root, buckets or BUCKETS)
        return
    new = _bucketed(validate_bars(incoming).require(), count := stored_buckets(spark, root, buckets))
    old = spark.read.schema(_BUCKETED_BARS).parquet(root).join(new.select(*_PARTS).distinct(), _PARTS, "left_semi")
    names = S.BARS.names
    _write_buckets(_bucketed(merge_bars(old.select(*names), new.select(*names)), count), root, "overwrite")


def build_panel(spark: SparkSession, bars_root: str, root: str, **gates) -> None:
    """The factor panel of stored bars, by bucket and month, with each symbol's last bars beside it."""
    count = stored_buckets(spark, bars_root)
    bars = read_bars(spark, bars_root)
    _write_buckets(_bucketed(factor_panel(bars, **gates), count), f"{root}/panel", "overwrite")
    _write_tail(panel_tail(bars), f"{root}/tail", count)


def _write_tail(tail: DataFrame, path: str, count: int) -> None:
    by_bucket = tail.withColumn("bucket", hash_shard(F.col("symbol"), count))
    by_bucket.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def update_panel(spark: SparkSession, incoming: DataFrame, bars_root: str, root: str, **gates) -> None:
    """W1-W6 kept up: merge new bars into the stored ones and make only the panel rows that they change.

    Bars later than their symbol's last one need its tail alone.  Symbols with a corrected or inserted bar
    are read from the stored bars, and rows that a change can reach are made again.  Folders of other
    buckets and months stay as they are.  Repeating an update changes nothing.
    """
    count = stored_buckets(spark, bars_root)
    fresh = settled(_bucketed(validate_bars(incoming).require(), count))
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most the bucket count
    tail = spark.read.parquet(f"{root}/tail").where(F.col("bucket").isin(touched)).drop("bucket")
    ends = tail.groupBy("symbol").agg(F.max("trade_date").alias("_end"))
    dated = fresh.drop("bucket", "month").join(ends, "symbol", "left").withColumn("_late", F.coalesce(F.col("trade_date") <= F.col("_end"), F.lit(False)))
    stored = spark.read.schema(_BUCKETED_BARS).parquet(bars_root).where(F.col("bucket").isin(touched)).select("symbol", "trade_date", F.lit(True).alias("_stored"))
    late = dated.where("_late").select("symbol", "trade_date").join(stored, ["symbol", "trade_date"], "left").select("symbol", "trade_date", F.col("_stored").isNull().alias("inserted"))
    redone = settled(late.unionByName(dated.where("NOT _late").join(late.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "trade_date", F.lit(False).alias("inserted"))))
    upsert_bars(spark, incoming, bars_root)
    later = dated.where("NOT _late").join(redone.select("symbol").distinct(), "symbol", "left_anti")
    rows, ended = extend_panel(tail, later, **gates)
    if not redone.isEmpty():
        bars = spark.read.schema(_BUCKETED_BARS).parquet(bars_root).where(F.col("bucket").isin(touched)).select(*S.BARS.names)
        again = changed_panel(bars, redone, **gates)
        rows = rows.unionByName(again)
        ended = ended.unionByName(panel_tail(bars.join(redone.select("symbol").distinct(), "symbol", "left_semi")))
    rows, ended = settled(_bucketed(rows, count)), settled(ended)
    old = spark.read.parquet(f"{root}/panel").join(rows.select(*_PARTS).distinct(), _PARTS, "left_semi").join(rows.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")
    _write_buckets(old.select(*rows.columns).unionByName(rows), f"{root}/panel", "overwrite")
    _write_tail(tail.join(ended.select("symbol").distinct(), "symbol", "left_anti").select(*ended.columns).unionByName(ended), f"{root}/tail", count)


def upsert_facts(spark: SparkSession, incoming: DataFrame, root: str) -> Checked:
    """IO4: append facts with a new identity; a changed value under a known identity refuses all.

    Only folders that may hold an incoming identity are read.
    """
    fresh = validate_facts(incoming).require()
    if not _exists(spark, root):
        append_keyed(fresh, root, FACT_KEY)
        return Checked(fresh, fresh.limit(0).select(F.lit("").alias("rule")))
    touched = read_keyed(spark, root, fresh, FACT_KEY).select(*S.FACTS.names).join(fresh.select("symbol").distinct(), "symbol", "left_semi")
    merged = merge_facts(touched, fresh)
    merged.require()
    added = fresh.join(touched.select(*FACT_KEY), FACT_KEY, "left_anti")
    if not added.isEmpty():
        append_keyed(added, root, FACT_KEY)
    return merged


def read_facts(spark: SparkSession, root: str) -> Checked:
    """IO5."""
    return validate_facts(spark.read.parquet(root).select(*S.FACTS.names))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """IO7: CSV with string symbols; a missing screen source is named."""
    df = spark.read.option("header", True).csv(path)
    source = F.coalesce("screen_source", F.lit("external_candidate_file")) if "screen_source" in df.columns else F.lit("external_candidate_file")
    return df.withColumns({"symbol": pad_symbol(F.col("symbol")), "screen_source": source})


def read_ledger(spark: SparkSession, root: str, kind: str = "signals") -> DataFrame:
    """IO8: all daily files of a ledger as one table; the date comes from the column."""
    schema = S.SIGNAL_LEDGER if kind == "signals" else S.RANKING_LEDGER
    df = spark.read.schema(schema).option("header", True).csv(os.path.join(root, kind))
    return df.withColumn("symbol", pad_symbol(F.col("symbol")))


def write_selection(ranking: DataFrame, exclusions: DataFrame, summary: DataFrame, root: str, top_n: int) -> None:
    """IO9: ranking, selected, exclusions and a one-row summary."""
    selected = ranking.where(F.col("rank").isNotNull()).orderBy(F.col("composite_score").desc_nulls_last(), "symbol").limit(top_n)
    ranking.write.mode("overwrite").parquet(f"{root}/ranking")
    selected.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/selected")
    exclusions.write.mode("overwrite").option("header", True).csv(f"{root}/exclusions")
    summary.write.mode("overwrite").json(f"{root}/summary")


def write_backtest_report(equity: DataFrame, trades: DataFrame, summary: DataFrame, root: str, comparison: DataFrame | None = None) -> None:
    """IO10: equity, trades, benchmark series and one summary row per portfolio."""
    equity.write.mode("overwrite").parquet(f"{root}/equity")
    trades.write.mode("overwrite").parquet(f"{root}/trades")
    if comparison is not None:
        comparison.write.mode("overwrite").parquet(f"{root}/benchmark")
    summary.write.mode("overwrite").json(f"{root}/summary")


def append_snapshot(master: DataFrame, root: str) -> None:
    """IO11: add a valid, complete master snapshot under its time; refuse one that lacks an exchange.
    The same snapshot again changes nothing; another one of the same time is refused."""
    validate_master(master).require()
    need = F.array(*[F.lit(e) for e in S.REQUIRED_EXCHANGES])
    gaps = master.agg(F.array_except(need, F.collect_set("exchange")).alias("missing")).first()["missing"]
    if gaps:
        raise DataQualityError(f"refusing an incomplete master, missing {sorted(gaps)}")
    stamped = master.select(*S.MASTER.names).withColumn("observed_dt", F.date_format("observed_at", "yyyyMMddHHmmssSSS"))
    spark = master.sparkSession
    if _exists(spark, root):
        stored = spark.read.schema(stamped.schema).parquet(root)
        old = stored.join(stamped.select("observed_dt").distinct(), "observed_dt", "left_semi").select(*stamped.columns)
        new = stamped.join(old.select("observed_dt").distinct(), "observed_dt", "left_semi").select(*stamped.columns)
        if not old.exceptAll(new).isEmpty() or not new.exceptAll(old).isEmpty():
            raise DataQualityError("refusing a changed master under a stored snapshot time")
        stamped = stamped.join(old.select("observed_dt").distinct(), "observed_dt", "left_anti")
        if stamped.isEmpty():
            return
    stamped.write.mode("append").partitionBy("observed_dt").parquet(root)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select(*S.MASTER.names)


def write_ranged_snapshot(rows: DataFrame, root: str, keys: list[str], fan: int = FAN, depth: int = DEPTH) -> None:
    """A snapshot in one folder per key range, with the tree of the ranges' digests beside it."""
    leaf = key_leaf(keys, fan, depth)
    rows.withColumn("leaf", leaf).hint("rebalance", "leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{root}/rows")
    hash_tree(rows, keys, [c for c in rows.columns if c not in keys], fan, depth).coalesce(1).write.mode("overwrite").parquet(f"{root}/tree")


def compare_ranged_snapshots(
    spark: SparkSession, stored: str, fresh: str, keys: list[str], numbers: list[str], others: list[str], *, fan: int = FAN, depth: int = DEPTH, **tolerance
) -> DataFrame:
    """E5 between two stored snapshots: the trees name the ranges that differ, and only their folders are read."""
    trees = [spark.read.parquet(f"{root}/tree") for root in (stored, fresh)]
    leaves = set(differing_leaves(*trees, fan, depth))
    rows = []
    for root, tree in zip((stored, fresh), trees, strict=True):
        have = sorted(leaves & {r["node"] for r in tree.where(F.col("level") == depth).select("node").collect()})
        rows.append(spark.read.parquet(*[f"{root}/rows/leaf={n}" for n in have]) if have else spark.read.parquet(f"{root}/rows").drop("leaf").limit(0))
    return compare_snapshots(*rows, keys, numbers, others, **tolerance)


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """Rows of shard folders ``<root>/shard=<i>/`` with the index from the path."""
    path = F.col("_metadata.file_path")
    df = spark.read.parquet(f"{root}/*/")
    return df.withColumn("shard_index", F.regexp_extract(path, r"shard=([0-9]+)", 1).cast("int"))


def write_merged(rows: DataFrame, summaries: DataFrame, expected_shards: int, out: str, value: str = "amount") -> Checked:
    """IO14/IO15: all gates must hold, then the rows are written by month."""
    merged = merge_shards(rows, summaries, expected_shards, value=value)
    merged.require()
    by_month = merged.clean.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    by_month.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(out)
    return merged


def write_candidate_days(result: Reconstruction, root: str) -> None:
    """IO16: candidates by day, audit and failures."""
    result.candidates.hint("rebalance", "trade_date").write.mode("overwrite").partitionBy("trade_date").parquet(f"{root}/candidates")
    result.audit.write.mode("overwrite").parquet(f"{root}/audit")
    result.failures.write.mode("overwrite").parquet(f"{root}/failures")


def append_immutable(spark: SparkSession, incoming: DataFrame, root: str, keys: list[str], hash_column: str = "content_hash") -> DataFrame:
    """E3 sink: insert new keys, accept equal ones, refuse the whole batch on a conflict.  Only folders that
    may hold an incoming key are read."""
    if not _exists(spark, root):
        append_keyed(incoming, root, keys)
        return incoming.withColumn("action", F.lit("insert"))
    planned = append_plan(read_keyed(spark, root, incoming, keys), incoming, keys, hash_column)
    if planned.where(F.col("action") == "conflict").take(1):
        raise DataQualityError("refusing to rewrite immutable evidence")
    added = planned.where(F.col("action") == "insert").drop("action")
    if not added.isEmpty():
        append_keyed(added, root, keys)
    return planned


def write_inventory(lifecycle: DataFrame, changes: DataFrame, calendar: DataFrame, root: str) -> None:
    """IO19."""
    for name, df in (("lifecycle", lifecycle), ("name_changes", changes), ("membership_calendar", calendar)):
        df.write.mode("overwrite").parquet(f"{root}/{name}")

