"""The three end-to-end flows as compositions of operators; each is one lazy plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import TradingRules
from tidemark.operators.archive import build_lifecycle, selection_summary
from tidemark.operators.checks import latest_per_key
from tidemark.operators.evidence import guarded_override
from tidemark.operators.factors import CONFIG_V1, CONFIG_V2, ScoreConfig, attach_metadata, factor_engine, historical_rankings, strict_rankings
from tidemark.operators.performance import rolling_blocks, rolling_summary
from tidemark.operators.portfolio import portfolio_sweep, signal_fills, target_weight_equity
from tidemark.operators.reconstruct import Reconstruction, amounts_with_recovery, reconstruct_candidates, recover_amounts
from tidemark.operators.universe import drop_stale
from tidemark.sources.scratch import settled


class DailyRanking(NamedTuple):
    ranking: DataFrame
    exclusions: DataFrame
    failures: DataFrame
    summary: DataFrame


def daily_ranking(bars: DataFrame, candidates: DataFrame, config: ScoreConfig = CONFIG_V1, *, top_n: int = 10, **gates) -> DailyRanking:
    """Candidates -> their bars -> stale names out -> eligibility, factors, score -> metadata."""
    mine = bars.join(candidates.select("symbol").distinct(), "symbol", "left_semi")
    fresh, failures = drop_stale(mine)
    ranking, exclusions = factor_engine(fresh, config, **gates)
    named = attach_metadata(ranking, candidates)
    return DailyRanking(named, exclusions, failures, selection_summary(ranking, exclusions, failures, top_n))


#: Columns of the rankings that a portfolio sweep reads.
SWEPT = ["as_of", "symbol", "rank", "board", "is_st", "close", "momentum_20", "trend_close_ma20"]


class WalkForward(NamedTuple):
    rankings: DataFrame
    signals: DataFrame
    fills: DataFrame
    equity: DataFrame
    blocks: DataFrame
    summary: DataFrame


def walk_forward(
    bars: DataFrame, metadata: DataFrame, etf_bars: DataFrame, benchmark: DataFrame, configs: DataFrame, *,
    candidates: DataFrame | None = None, config: ScoreConfig = CONFIG_V2, rules: TradingRules = TradingRules.small_account(),
    capital: float = 20_000.0, block_days: int = 20, **gates,
) -> WalkForward:
    """Rankings for every date -> signals of every config -> fills and equity -> blocks.

    With ``candidates`` (as_of, symbol, ...) only names observed that day are ranked.  ``rankings`` is a lazy plan.
    """
    if candidates is None:
        ranked = historical_rankings(bars, config, metadata=metadata, **gates)
    else:
        ranked, _ = strict_rankings(bars, candidates, config, **gates)
    # what the sweep reads is written, not the whole ranking
    swept = settled(ranked.select(*SWEPT))
    signals = settled(portfolio_sweep(swept, etf_bars, configs))
    # a name in both tables is taken from the stock bars
    both = etf_bars.withColumn("_side", F.lit(0)).unionByName(bars.withColumn("_side", F.lit(1)))
    market = settled(latest_per_key(both, ["symbol", "trade_date"], ["_side"]).drop("_side"))  # read for fills and for equity
    keys = ["config_id"]
    fills = signal_fills(signals, market, capital, rules, keys=keys)
    equity = settled(target_weight_equity(signals, market, initial=capital, keys=keys))
    blocks = rolling_blocks(equity, fills, benchmark, block_days=block_days, keys=keys)
    return WalkForward(ranked, signals, fills, equity, blocks, rolling_summary(blocks, keys))


def reconstruct_history(
    current: DataFrame, delisted: DataFrame, corrections: DataFrame, amounts: DataFrame, states: DataFrame, recovered_raw: DataFrame, **options
) -> Reconstruction:
    """Lists -> reviewed lifecycle -> archives with recovered rows -> candidates of every day."""
    lifecycle = guarded_override(build_lifecycle(current, delisted).clean, corrections).clean
    full = amounts_with_recovery(amounts, recover_amounts(recovered_raw, states).amounts)
    return reconstruct_candidates(lifecycle, full, states, **options)


def selected(ranking: DataFrame, top_n: int) -> DataFrame:
    return ranking.where(F.col("rank").isNotNull()).orderBy(F.col("composite_score").desc(), "symbol").limit(top_n)
