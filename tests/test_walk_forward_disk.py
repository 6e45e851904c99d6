"""What a walk-forward run leaves on disk: the columns that later steps read, and no shuffle files of steps that are done."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.plans import catalog, flows
from tidemark.sources.scratch import settled

SF = "/root/testdata/sf0.001"


def test_sweep_gets_its_columns_and_market_is_made_once(spark, monkeypatch):
    made, plain, market = [], flows.settled, []
    swept = flows.portfolio_sweep
    monkeypatch.setattr(flows, "settled", lambda df: made.append(df.columns) or plain(df))
    monkeypatch.setattr(flows, "portfolio_sweep", lambda rankings, *a: market.append(rankings.columns) or swept(rankings, *a))
    monkeypatch.setattr(flows, "target_weight_equity", lambda signals, bars, **k: market.append(len(bars.inputFiles())) or plain(signals.select("config_id")))
    monkeypatch.setattr(flows, "rolling_blocks", lambda equity, *a, **k: equity)
    monkeypatch.setattr(flows, "rolling_summary", lambda blocks, keys: blocks.select("config_id", *[F.lit(0).alias(c) for c in ("block_count", "positive_block_rate", "benchmark_outperformance_rate", "development_gate_passed")]))
    catalog.QUERIES["walk_forward_summary"](spark, SF)
    assert market[0] == flows.SWEPT and flows.SWEPT in made and not any("volatility_20" in c for c in made)
    written = [c for c in made if "open" in c and "_side" not in c]
    assert len(written) == 1


def test_shuffle_files_go_when_later_tables_are_settled(spark):
    jvm = spark.sparkContext._jvm
    folders = [Path(x.toString()) for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: sum(1 for d in folders for f in d.rglob("shuffle_*.data"))
    jvm.System.gc()
    time.sleep(2)
    before = files()
    out = settled(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert files() > before
    for _ in range(3):
        time.sleep(1)
        settled(spark.range(10))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 1000
