"""Queries over the end-to-end flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources.scratch import settled
from tidemark.plans import flows
from tidemark.plans.catalog_evidence import _REC, _RV, FLOOR, LIMIT, raw_recovery
from tidemark.plans.catalog_market import GATES
from tidemark.plans.catalog_portfolio import CONFIGS
from tidemark.plans.oracle_views import V1, scored, with_views
from tidemark.plans.registry import query, r, rounded
from tidemark.sources import views as V

_PICKED = "SELECT * FROM master WHERE is_listed AND NOT is_st"
_FRESH = "SELECT symbol FROM (SELECT b.symbol, max(trade_date) AS m FROM bars b JOIN picked USING (symbol) GROUP BY 1) WHERE m = (SELECT max(trade_date) FROM bars b JOIN picked USING (symbol))"


@query("daily_ranking", with_views(["panel", "master"], f"SELECT s.symbol, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank, p.exchange, p.board FROM scored s JOIN picked p USING (symbol)",
                                   {"picked": _PICKED, "fresh": _FRESH,
                                    "latest": "SELECT *, 1 AS run FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM panel JOIN fresh USING (symbol)) WHERE rn = 1 AND bar_no >= 61 AND average_amount_20 >= 35000",
                                    **scored("latest", "run", V1)}))
def _(spark, sf):
    picked = V.master(spark, sf).where(F.col("is_listed") & ~F.col("is_st"))
    day = flows.daily_ranking(V.bars(spark, sf), picked, **GATES)
    return rounded(day.ranking.select("symbol", "composite_score", "rank", "exchange", "board"), 5)


@query("walk_forward_summary")
def _(spark, sf):
    """The whole research flow over all dates; its parts are checked one by one by other queries."""
    from tidemark.operators.portfolio import config_table

    bars = settled(V.bars(spark, sf))
    run = flows.walk_forward(bars, V.lifecycle(spark, sf).withColumn("is_st", F.lit(False)), bars, V.benchmark(spark, sf), config_table(spark, CONFIGS), capital=1e7, **GATES)
    return rounded(run.summary.select("config_id", "block_count", "positive_block_rate", "benchmark_outperformance_rate", "development_gate_passed"))


@query("reconstruct_history", with_views(_RV, f"SELECT trade_date, symbol, {r('amount', 2)} AS amount, CAST(rn AS INTEGER) AS rank_by_amount FROM ok_rows WHERE rn <= {LIMIT}",
                                         {**_REC, "life": "SELECT * EXCLUDE (delist_date), CASE WHEN NOT currently_listed THEN delist_date - 3 END AS delist_date FROM lifecycle WHERE exchange IN ('SSE','SZSE')"}))
def _(spark, sf):
    life = V.lifecycle(spark, sf)
    gone = life.where(~F.col("currently_listed"))
    fixes = gone.select("symbol", F.col("delist_date").alias("expected"), F.date_sub("delist_date", 3).alias("new"), F.date_sub("delist_date", 10).alias("published"))
    done = flows.reconstruct_history(life.where("currently_listed"), gone, fixes, V.gap_amounts(spark, sf), V.gap_states(spark, sf), raw_recovery(spark, sf), limit=LIMIT, min_amount=FLOOR)
    return rounded(done.candidates.select("trade_date", "symbol", "amount", "rank_by_amount"), 2)
