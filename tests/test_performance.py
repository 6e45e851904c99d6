import numpy as np
import pandas as pd
import pytest
from helpers import business_days, day

from tidemark.operators import performance as Q


def equity(spark, values, start="2024-01-02"):
    return spark.createDataFrame([("p", d, float(v)) for d, v in zip(business_days(start, len(values)), values)], "portfolio_id string, trade_date date, equity double")


def test_trade_statistics(spark):
    t = spark.createDataFrame([("p", "buy", 50000.0, 15.0, 0.0), ("p", "sell", 52000.0, 15.6, 26.0)], "portfolio_id string, side string, notional double, commission double, stamp_duty double")
    r = Q.trade_statistics(equity(spark, [100000, 102000, 105000]), t).first()
    assert (r["trade_count"], r["buy_count"], r["sell_count"], r["gross_traded_notional"]) == (2, 1, 1, 102000.0)
    assert r["total_cost"] == pytest.approx(56.6) and r["turnover"] == pytest.approx(102000 / np.mean([100000, 102000, 105000]))
    none = Q.trade_statistics(equity(spark, [1.0, 2.0]), t.limit(0)).first()
    assert (none["trade_count"], none["total_cost"]) == (0, 0.0)


def test_benchmark(spark):
    bench = spark.createDataFrame([(d, float(v)) for d, v in zip(business_days("2024-01-02", 3), (100, 101, 102))], "trade_date date, close double")
    r = Q.benchmark_returns(Q.benchmark_comparison(equity(spark, [100000, 102000, 105000]), bench)).first()
    assert r["portfolio_return"] == pytest.approx(0.05) and r["benchmark_return"] == pytest.approx(0.02) and r["excess_return"] == pytest.approx(1.05 / 1.02 - 1)


def test_performance_against_pandas(spark):
    rng = np.random.default_rng(5)
    values = 1000 * np.cumprod(1 + rng.normal(0, 0.02, 60))
    r = Q.performance_summary(equity(spark, values)).first()
    s = pd.Series(values)
    ret = s.pct_change().dropna()
    assert r["annualized_volatility"] == pytest.approx(ret.std(ddof=1) * np.sqrt(252)) and r["max_drawdown"] == pytest.approx((s / s.cummax() - 1).min())
    assert r["sharpe"] == pytest.approx(ret.mean() / ret.std(ddof=1) * np.sqrt(252)) and r["total_return"] == pytest.approx(values[-1] / values[0] - 1)


def test_two_blocks_of_twenty(spark):
    n = 41
    days = business_days("2024-01-02", n)
    eq = equity(spark, [20000 * 1.001**i for i in range(n)])
    bench = spark.createDataFrame([(d, 4000 * 1.0002**i) for i, d in enumerate(days)], "trade_date date, close double")
    trades = spark.createDataFrame([("p", days[5], 5000.0, 5.0, 0.0, 0.05, 1.0), ("p", days[25], 6000.0, 5.0, 3.0, 0.06, 1.0)],
                                   "portfolio_id string, trade_date date, notional double, commission double, stamp_duty double, transfer_fee double, slippage_cost double")
    blocks = Q.rolling_blocks(eq, trades, bench)
    got = blocks.orderBy("block").collect()
    assert [r["block"] for r in got] == [1, 2] and all(r["trading_days"] == 20 and r["trade_count"] == 1 for r in got)
    assert got[0]["return"] == pytest.approx(1.001**20 - 1) and got[0]["explicit_cost"] == pytest.approx(5.05) and got[1]["turnover"] == pytest.approx(6000 / (20000 * 1.001**20))
    s = Q.rolling_summary(blocks).first()
    assert s["benchmark_outperformance_rate"] == 1.0 and 0 < s["top_1_log_return_share"] <= s["top_2_log_return_share"] and s["development_gate_passed"] is False


def test_missing_benchmark_return_leaves_block_without_excess(spark):
    days = business_days("2024-01-02", 21)
    bench = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(days) if i != 7], "trade_date date, close double")
    r = Q.rolling_blocks(equity(spark, [100 + i for i in range(21)]), None, bench).first()
    assert r["benchmark_return"] is None and r["excess_return"] is None and r["trade_count"] == 0


def test_bias_needs_the_same_period(spark):
    cols = "strategy_version string, status string, strict_point_in_time_universe boolean, start string, end string, total_return double, max_drawdown double, median_return double, median_excess_return double, benchmark_outperformance_rate double, return_excluding_best_block double"
    row = ("v2", "complete", True, "2024-01-01", "2024-06-30", 0.1, -0.05, 0.01, 0.0, 0.5, 0.02)
    a = spark.createDataFrame([row], cols)
    ok, refused = Q.bias_comparison(a, a.withColumn("total_return", a["total_return"] + 0.2))
    assert ok.first()["strict_minus_current_return"] == pytest.approx(-0.2) and refused.count() == 0
    from pyspark.sql import functions as F

    ok, refused = Q.bias_comparison(a, a.withColumn("end", F.lit("2024-07-01")))
    assert ok.count() == 0 and refused.first()["reason"] == "end_dates_differ"


def test_phase_labels(spark):
    sig = spark.createDataFrame([("p", day("2024-01-02"), "000001")], "portfolio_id string, trade_date date, symbol string")
    r = Q.shadow_metrics(sig, equity(spark, [100, 101, 100]), sig.limit(0)).first()
    assert (r["validation_phase"], r["trade_count"], r["observed_return_days"]) == ("collecting", 0, 2) and r["daily_win_rate"] == 0.5
