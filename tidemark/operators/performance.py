"""Equity, benchmark and block measurements, many portfolios at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import development_gate, validation_phase
from tidemark.operators.normalize import normalize_series

COSTS = ["notional", "commission", "stamp_duty", "transfer_fee", "slippage_cost"]


def _by_date(keys: list[str]):
    """Equity is unique per (portfolio, day): a partition holds at most the calendar's days."""
    return Window.partitionBy(*keys).orderBy("trade_date")


def returns_drawdown(equity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Daily return, running peak and drawdown."""
    w = _by_date(keys or ["portfolio_id"])
    return equity.withColumns({
        "daily_return": F.col("equity") / F.lag("equity").over(w) - 1.0,
        "running_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumn("drawdown", F.col("equity") / F.col("running_peak") - 1.0)


def trade_statistics(equity: DataFrame, trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: activity and costs; portfolios without trades get zeros. Transfer fees are not in total_cost."""
    keys = keys or ["portfolio_id"]
    level = equity.groupBy(*keys).agg(F.avg("equity").alias("_mean"))
    side = F.lower("side")
    sums = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count_if(side == "buy").alias("buy_count"), F.count_if(side == "sell").alias("sell_count"),
        F.sum(F.abs("notional")).alias("gross_traded_notional"), F.sum("commission").alias("commission"), F.sum("stamp_duty").alias("stamp_duty"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return level.join(sums, keys, "left").select(
        *keys, z("trade_count"), z("buy_count"), z("sell_count"), z("gross_traded_notional"),
        (F.coalesce("gross_traded_notional", F.lit(0.0)) / F.col("_mean")).alias("turnover"), z("commission"), z("stamp_duty"),
        (F.coalesce("commission", F.lit(0.0)) + F.coalesce("stamp_duty", F.lit(0.0))).alias("total_cost"),
    )


def performance_summary(equity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A2: total and annualised return, volatility, drawdown, Sharpe (sample deviation)."""
    keys = keys or ["portfolio_id"]
    r = returns_drawdown(equity, keys)
    agg = r.groupBy(*keys).agg(
        F.min_by("equity", "trade_date").alias("_first"), F.max_by("equity", "trade_date").alias("_last"),
        F.greatest(F.datediff(F.max("trade_date"), F.min("trade_date")), F.lit(1)).alias("_days"),
        F.min("drawdown").alias("max_drawdown"), F.avg("daily_return").alias("_mean"), F.stddev_samp("daily_return").alias("_std"),
    )
    year = F.sqrt(F.lit(252.0))
    total = F.col("_last") / F.col("_first")
    return agg.select(
        *keys, (total - 1.0).alias("total_return"), (F.pow(total, F.lit(365.25) / F.col("_days")) - 1.0).alias("annualized_return"),
        F.coalesce(F.col("_std") * year, F.lit(0.0)).alias("annualized_volatility"), "max_drawdown",
        F.coalesce(F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * year), F.lit(0.0)).alias("sharpe"),
    )


def benchmark_comparison(equity: DataFrame, benchmark: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A3 + J4: indexed portfolio, benchmark and excess series on the common dates."""
    keys = keys or ["portfolio_id"]
    both = equity.select(*keys, "trade_date", "equity").join(benchmark.select("trade_date", "close"), "trade_date")
    first = _by_date(keys).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({
        "portfolio_index": F.col("equity") / F.first("equity").over(first), "benchmark_index": F.col("close") / F.first("close").over(first),
    }).withColumn("excess_index", F.col("portfolio_index") / F.col("benchmark_index"))


def benchmark_returns(comparison: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A3 one row per portfolio: final returns over the aligned dates."""
    keys = keys or ["portfolio_id"]
    final = lambda c: (F.max_by(c, "trade_date") - 1.0)
    return comparison.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aligned_dates"), final("portfolio_index").alias("portfolio_return"),
        final("benchmark_index").alias("benchmark_return"), final("excess_index").alias("excess_return"),
    )


def rolling_blocks(
    equity: DataFrame, trades: DataFrame | None = None, benchmark: DataFrame | None = None, *, block_days: int = 20,
    keys: list[str] | None = None,
) -> DataFrame:
    """A4: non-overlapping blocks of N daily returns; the last partial block is dropped.

    Trades meet blocks by an equi join on (portfolio, date) with the block's days, after being
    summed per day, so a busy day is one row before it is shuffled again.
    """
    if block_days <= 0:
        raise ValueError("block_days must be positive")
    keys = keys or ["portfolio_id"]
    w = _by_date(keys)
    daily = normalize_series(equity.select(*keys, "trade_date", "equity"), "equity", keys).withColumn("_before", F.lag("equity").over(w))
    daily = daily.where(F.col("daily_return").isNotNull()).withColumn(
        "block", (F.floor((F.row_number().over(w) - 1) / block_days) + 1).cast("int")
    )
    if benchmark is not None:
        bench = normalize_series(benchmark.select("trade_date", "close"), "close", return_name="benchmark_return")
        daily = daily.join(bench.select("trade_date", "benchmark_return"), "trade_date", "left")
    else:
        daily = daily.withColumn("benchmark_return", F.lit(None).cast("double"))
    in_block = Window.partitionBy(*keys, "block").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("_wealth", F.exp(F.sum(F.log1p("daily_return")).over(in_block)))
    daily = daily.withColumn("_dd", F.col("_wealth") / F.max("_wealth").over(in_block) - 1.0)
    blocks = daily.groupBy(*keys, "block").agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("trading_days"),
        (F.product(1.0 + F.col("daily_return")) - 1.0).alias("return"), F.min("_dd").alias("max_drawdown"),
        F.avg(F.when(F.col("daily_return") > 0, 1.0).otherwise(0.0)).alias("positive_day_rate"),
        F.when(F.count("benchmark_return") == block_days, F.product(1.0 + F.col("benchmark_return")) - 1.0).alias("benchmark_return"),
        F.min_by("_before", "trade_date").alias("_start_equity"),
    ).where(F.col("trading_days") == block_days)
    if trades is not None:
        have = [c if c in trades.columns else F.lit(0.0).alias(c) for c in COSTS]
        per_day = trades.select(*keys, "trade_date", *have).groupBy(*keys, "trade_date").agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in COSTS]
        )
        spans = blocks.select(*keys, "block", "start_date", "end_date")
        span_days = spans.withColumn("trade_date", F.explode(F.sequence("start_date", "end_date")))
        per_block = span_days.join(per_day, [*keys, "trade_date"]).groupBy(*keys, "block").agg(
            F.sum("_n").alias("_n"), F.sum("notional").alias("_notional"),
            F.sum(F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee")).alias("_explicit"), F.sum("slippage_cost").alias("_slip"),
        )
        blocks = blocks.join(per_block, [*keys, "block"], "left")
    else:
        blocks = blocks.withColumns({c: F.lit(None).cast("double") for c in ("_n", "_notional", "_explicit", "_slip")})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.col("_start_equity")
    return blocks.select(
        *keys, "block", "start_date", "end_date", "trading_days", "return", "benchmark_return",
        (F.col("return") - F.col("benchmark_return")).alias("excess_return"), "max_drawdown", "positive_day_rate",
        F.coalesce(F.col("_n").cast("long"), F.lit(0)).alias("trade_count"), (zero("_notional") / base).alias("turnover"),
        zero("_explicit").alias("explicit_cost"), zero("_slip").alias("slippage_cost"),
        ((zero("_explicit") + zero("_slip")) / base).alias("cost_drag"),
    )


def rolling_summary(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5 + A6: medians, rates, best and worst, concentration of log return, and the gate."""
    keys = keys or ["portfolio_id"]
    best = Window.partitionBy(*keys).orderBy(F.col("return").desc(), "block")
    ranked = blocks.withColumn("_rn", F.row_number().over(best)).withColumn("_log", F.when(F.col("return") > -1.0, F.log1p("return")))
    rate = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    total = F.sum("_log")
    share = lambda n: F.when(total > 0, F.sum(F.when(F.col("_rn") <= n, F.col("_log"))) / total)
    rest = F.product(F.when(F.col("_rn") > 1, 1.0 + F.col("return")).otherwise(1.0)) - 1.0
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("block_count"), F.median("return").alias("median_return"),
        rate(F.col("return") > 0).alias("positive_block_rate"), F.median("max_drawdown").alias("median_max_drawdown"),
        F.median("turnover").alias("median_turnover"), F.median("cost_drag").alias("median_cost_drag"),
        F.avg(F.when(F.col("excess_return").isNotNull(), (F.col("excess_return") > 0).cast("double"))).alias("benchmark_outperformance_rate"),
        F.median("excess_return").alias("median_excess_return"), F.min("return").alias("worst_block_return"),
        F.max("return").alias("best_block_return"), rest.alias("return_excluding_best_block"),
        share(1).alias("top_1_log_return_share"), share(2).alias("top_2_log_return_share"),
    )
    return out.withColumn("development_gate_passed", development_gate())


def shadow_metrics(signals: DataFrame, equity: DataFrame, trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A8 + A9: signal dates and names, win rate, observed days and the validation phase."""
    keys = keys or ["portfolio_id"]
    s = signals.groupBy(*keys).agg(
        F.count_distinct("trade_date").alias("signal_dates"), F.count(F.lit(1)).alias("signal_rows"), F.count_distinct("symbol").alias("distinct_symbols"),
    )
    t = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"))
    r = returns_drawdown(equity, keys).groupBy(*keys).agg(
        F.count("daily_return").alias("observed_return_days"), F.avg((F.col("daily_return") > 0).cast("double")).alias("daily_win_rate"),
        F.max_by("equity", "trade_date").alias("latest_equity"), F.max("trade_date").alias("latest_trade_date"),
    )
    return r.join(s, keys, "left").join(t, keys, "left").withColumn(
        "trade_count", F.coalesce("trade_count", F.lit(0))
    ).withColumn("validation_phase", validation_phase(F.col("observed_return_days")))


def portfolio_metrics(rankings: DataFrame, signals: DataFrame, equity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranking dates, rebalance dates and win rate per portfolio."""
    keys = keys or ["config_id"]
    dates = rankings.agg(F.count_distinct("as_of").alias("ranking_dates"), F.max("as_of").alias("latest_ranking_date"))
    s = signals.groupBy(*keys).agg(F.count_distinct("trade_date").alias("rebalance_dates"))
    r = returns_drawdown(equity, keys).groupBy(*keys).agg(
        F.count("daily_return").alias("observed_return_days"), F.avg((F.col("daily_return") > 0).cast("double")).alias("daily_win_rate"),
    )
    return s.join(r, keys, "left").join(F.broadcast(dates))


def bias_comparison(strict: DataFrame, current: DataFrame, key: str = "strategy_version") -> tuple[DataFrame, DataFrame]:
    """(deltas of same-period summaries, refused rows).

    Both sides have one row per strategy: status, strict_point_in_time_universe, start, end,
    total_return, max_drawdown and the A5 columns.
    """
    s, c = strict.alias("s"), current.alias("c")
    both = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"))
    reason = (
        F.when(F.col("s.status") != "complete", "strict_not_complete")
        .when(~F.col("s.strict_point_in_time_universe"), "strict_not_point_in_time")
        .when(~F.col("s.start").eqNullSafe(F.col("c.start")), "start_dates_differ")
        .when(~F.col("s.end").eqNullSafe(F.col("c.end")), "end_dates_differ")
    )
    pair = lambda name, col: [F.col(f"s.{col}").alias(f"strict_{name}"), F.col(f"c.{col}").alias(f"current_{name}")]
    ok = both.where(reason.isNull()).select(
        F.col(f"s.{key}").alias(key), F.col("s.start").alias("start"), F.col("s.end").alias("end"), *pair("total_return", "total_return"),
        (F.col("s.total_return") - F.col("c.total_return")).alias("strict_minus_current_return"),
        (F.col("c.total_return") - F.col("s.total_return")).alias("current_minus_strict_return"),
        *pair("max_drawdown", "max_drawdown"), *pair("median_block_return", "median_return"), *pair("median_block_excess", "median_excess_return"),
        *pair("outperformance_rate", "benchmark_outperformance_rate"), *pair("return_excluding_best_block", "return_excluding_best_block"),
    )
    refused = both.where(reason.isNotNull()).select(F.col(f"s.{key}").alias(key), reason.alias("reason"))
    return ok, refused


