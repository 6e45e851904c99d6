import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import bars_from, business_days, trend_bars
from pyspark.sql import functions as F

from tidemark.operators import crosssection as C
from tidemark.operators import factors as W
from tidemark.operators.checks import DataQualityError
from tidemark.operators.universe import market_eligibility


def test_trend_factors(spark):
    row = W.market_factors(trend_bars(spark, [("1", 0.01, 3e7)]).withColumn("symbol", F.lit("000001"))).first()
    assert row["momentum_20"] > 0 and row["momentum_60"] > row["momentum_20"]
    assert row["trend_ma20_ma60"] > 0 and row["trend_close_ma20"] > 0 and row["max_drawdown_60"] == 0.0
    assert row["average_amount_20"] == pytest.approx(3e7) and row["log_amount_20"] == pytest.approx(math.log1p(3e7))


def test_short_history_is_refused(spark):
    bars = trend_bars(spark, [("000001", 0.01, 3e7)], n=60)
    assert W.market_factors(bars).count() == 0
    assert market_eligibility(bars).first()["reason"] == "insufficient_history:60<61"


def test_factor_engine_excludes_illiquid(spark):
    bars = trend_bars(spark, [("000001", 0.04, 8e7), ("000002", 0.01, 4e7), ("000003", 0.02, 5e6)], n=90)
    ranking, exclusions = W.factor_engine(bars)
    got = ranking.orderBy("rank").collect()
    assert [r["symbol"] for r in got] and {r["symbol"] for r in got} == {"000001", "000002"}
    assert all(r["factor_coverage"] == pytest.approx(1.0) for r in got)
    out = exclusions.collect()
    assert [(r["symbol"], r["reason"]) for r in out] == [("000003", "below_min_average_amount_20")]


def _pandas_factors(close, amount):
    c = pd.Series(close)
    ret = c.pct_change()
    t = c.tail(60)
    return {
        "momentum_20": c.iloc[-1] / c.iloc[-21] - 1, "momentum_60": c.iloc[-1] / c.iloc[-61] - 1, "trend_ma20_ma60": c.tail(20).mean() / c.tail(60).mean() - 1,
        "trend_close_ma20": c.iloc[-1] / c.tail(20).mean() - 1, "volatility_20": ret.tail(20).std(ddof=0) * math.sqrt(252),
        "max_drawdown_60": -(t / t.cummax() - 1).min(), "log_amount_20": math.log1p(pd.Series(amount).tail(20).mean()),
    }


def test_panel_equals_brute_force_on_every_date(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for symbol in ("000001", "600000"):
        closes, amounts = [], []
        for d in business_days("2024-01-02", 75):
            closes.append(round(10 * math.exp(rng.gauss(0, 0.3)), 2))
            amounts.append(float(rng.randint(10**7, 10**8)))
            rows.append((symbol, d, closes[-1], amounts[-1]))
            if len(closes) >= 61:
                truth[symbol, d] = _pandas_factors(closes, amounts)
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, close double, amount double")
    got = W.factor_panel(bars, min_average_amount=0.0).where(F.col("reason") == "eligible").collect()
    assert len(got) == len(truth)
    for r in got:
        for name, value in truth[r["symbol"], r["trade_date"]].items():
            assert r[name] == pytest.approx(value, rel=1e-9, abs=1e-12), name


@pytest.mark.parametrize("n", [1, 2, 5, 7, 60, 64])
def test_rolling_drawdown_any_length(spark, n):
    rng = random.Random(n)
    closes = [rng.uniform(1, 10) for _ in range(80)]
    days = business_days("2024-01-02", 80)
    df = spark.createDataFrame([("a", d, c) for d, c in zip(days, closes)], "symbol string, trade_date date, close double")
    got = {r["trade_date"]: r["dd"] for r in W.rolling_drawdown(df, n, "dd").collect()}
    for i, d in enumerate(days):
        t = pd.Series(closes[max(0, i - n + 1): i + 1])
        assert got[d] == pytest.approx(-(t / t.cummax() - 1).min(), abs=1e-12)


def _factor_rows():
    return [("d", "000001", 0.30, 0.10), ("d", "000002", 0.10, 0.20), ("d", "000003", -0.10, 0.40)]


CFG = W.ScoreConfig((W.FactorSpec("return_factor", 0.5, "higher"), W.FactorSpec("risk_factor", 0.5, "lower")))


def test_score_table(spark):
    table = spark.createDataFrame(_factor_rows(), "as_of string, symbol string, return_factor double, risk_factor double")
    got = {r["symbol"]: r for r in W.score_table(table, CFG).collect()}
    assert got["000001"]["rank"] == 1 and got["000001"]["score_percentile"] == 100.0 and got["000003"]["score_percentile"] == 0.0
    assert got["000001"]["score_return_factor"] > 0 and got["000001"]["score_risk_factor"] > 0


def test_missing_factor_lowers_coverage(spark):
    table = spark.createDataFrame(_factor_rows() + [("d", "000004", None, 0.3)], "as_of string, symbol string, return_factor double, risk_factor double")
    r = W.score_table(table, CFG).where("symbol = '000004'").first()
    assert r["factor_coverage"] == pytest.approx(0.5) and r["composite_score"] is None and r["rank"] is None


def test_bad_configs():
    with pytest.raises(ValueError):
        W.ScoreConfig((W.FactorSpec("x", -1.0),))
    with pytest.raises(ValueError):
        W.ScoreConfig((W.FactorSpec("x", 1.0, "sideways"),))


@pytest.fixture(scope="module")
def skewed(spark):
    """One cross-section holds most rows, and a third of them share one value."""
    rng = np.random.default_rng(3)
    rows = [("hot", f"{i:06d}", float(rng.normal()), 1.0 if i % 3 == 0 else float(rng.lognormal(0, 3))) for i in range(4000)]
    rows += [("cold", f"{i:06d}", float(rng.normal()), 5.0) for i in range(7)] + [("cold", "x", None, None)]
    return spark.createDataFrame(rows, "as_of string, symbol string, return_factor double, risk_factor double").cache()


@pytest.mark.parametrize("steps", [1, 300, None])
def test_quantiles_are_exact(spark, skewed, steps):
    got = {r["as_of"]: r for r in C.quantile_columns(skewed, ["as_of"], ["return_factor", "risk_factor"], [0.05, 0.95, 0.5], steps=steps).collect()}
    pdf = skewed.toPandas()
    for key, part in pdf.groupby("as_of"):
        for f in ("return_factor", "risk_factor"):
            for i, p in enumerate([0.05, 0.95, 0.5]):
                assert got[key][f"{f}_q{i}"] == pytest.approx(part[f].dropna().quantile(p), rel=1e-12)


def test_split_dates_rank_like_whole_ones(spark, skewed):
    a = C.rank_min(skewed, ["as_of"], "risk_factor", "rank", count_out="n")
    b = C.rank_min(skewed, ["as_of"], "risk_factor", "rank", count_out="n", steps=2000)
    pdf = skewed.toPandas()
    want = pdf.groupby("as_of").risk_factor.rank(method="min", ascending=False)
    rows = {(r["as_of"], r["symbol"]): r["rank"] for r in a.collect()}
    assert all(rows[k] == (None if np.isnan(w) else w) for k, w in zip(zip(pdf.as_of, pdf.symbol), want))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_split_dates_score_like_whole_ones(spark, skewed, monkeypatch):
    a = {(r["as_of"], r["symbol"]): r for r in W.score_table(skewed, CFG).collect()}
    monkeypatch.setattr(C, "STEPS", 1)
    b = W.score_table(skewed, CFG).collect()
    assert len(a) == len(b)
    for r in b:
        other = a[r["as_of"], r["symbol"]]
        assert r["composite_score"] == (None if other["composite_score"] is None else pytest.approx(other["composite_score"], abs=1e-12))


@pytest.mark.parametrize("scale", [1e12, 1e-12, 1.0, 1e300])
def test_any_scale_and_offset(spark, scale):
    values = [scale * (3 + k) for k in range(40)]
    table = spark.createDataFrame([("d", str(k), v) for k, v in enumerate(values)], "as_of string, symbol string, f double")
    z = [r["z_f"] for r in C.winsorized_zscores(table, ["as_of"], ["f"]).orderBy(F.col("symbol").cast("int")).collect()]
    low, high = np.quantile(np.arange(40) + 3.0, [0.05, 0.95])
    c = np.clip(np.arange(40) + 3.0, low, high)
    assert z == pytest.approx(((c - c.mean()) / c.std()).tolist(), abs=1e-9)


def test_nan_is_missing(spark):
    rows = [("d", str(k), float(k)) for k in range(9)] + [("d", "9", float("nan"))]
    table = spark.createDataFrame(rows, "as_of string, symbol string, f double")
    got = {r["symbol"]: r["z_f"] for r in C.winsorized_zscores(table, ["as_of"], ["f"]).collect()}
    c = np.clip(np.arange(9.0), *np.quantile(np.arange(9.0), [0.05, 0.95]))
    assert got["9"] is None and [got[str(k)] for k in range(9)] == pytest.approx(((c - c.mean()) / c.std()).tolist())
    ranks = {r["symbol"]: r["rank"] for r in C.rank_min(table, ["as_of"], "f", "rank").collect()}
    assert ranks["9"] is None and ranks["8"] == 1


def test_zeros_signs_and_infinities(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 1e308, -1e308, float("inf"), float("-inf"), 2.0, -2.0, None]
    table = spark.createDataFrame([(k % 2 or None, str(k), v) for k, v in enumerate(values * 2)], "as_of int, symbol string, f double")
    got = {r["symbol"]: (r["rank"], r["n"]) for r in C.rank_min(table, ["as_of"], "f", "rank", descending=False, count_out="n").collect()}
    for odd in (0, 1):
        own = [v for k, v in enumerate(values * 2) if k % 2 == odd and v is not None]
        assert all(got[str(k)] == (1 + sum(x < v for x in own), len(own)) for k, v in enumerate(values * 2) if k % 2 == odd and v is not None)
    assert got["12"] == (None, None)
    q = C.quantile_columns(table, ["as_of"], ["f"], [0.0, 0.5, 1.0]).where("as_of = 1").first()
    assert (q.f_q0, q.f_q1, q.f_q2) == (float("-inf"), 0.0, float("inf")) or q.f_q1 == pytest.approx(np.median([v for k, v in enumerate(values * 2) if k % 2 and v is not None]))


def test_duplicate_members_are_refused(spark):
    table = spark.createDataFrame([*_factor_rows(), ("d", "000001", 0.2, 0.2)], "as_of string, symbol string, return_factor double, risk_factor double")
    with pytest.raises(ValueError, match="000001"):
        W.score_table(table, CFG)


def test_one_scratch_table_a_call(spark, skewed, monkeypatch):
    made = []
    monkeypatch.setattr(W, "settled", lambda df: made.append(df) or df)
    W.score_table(skewed, CFG).collect()
    assert len(made) == 1


def test_flat_factor_scores_zero(spark):
    table = spark.createDataFrame([("d", str(i), 2.5, float(i)) for i in range(5)], "as_of string, symbol string, return_factor double, risk_factor double")
    z = C.winsorized_zscores(table, ["as_of"], ["return_factor"])
    assert {r["z_return_factor"] for r in z.collect()} == {0.0}


def test_historical_rankings_stale_modes(spark):
    bars = trend_bars(spark, [("000001", 0.04, 8e7), ("000002", 0.01, 8e7), ("000003", 0.02, 8e7)], n=70)
    last = bars.agg(F.max("trade_date")).first()[0]
    bars = bars.where(~((F.col("symbol") == "000001") & (F.col("trade_date") == F.lit(last))))
    scored = W.historical_rankings(bars, W.CONFIG_V2, stale="score_then_drop").where(F.col("as_of") == F.lit(last))
    fresh = W.historical_rankings(bars, W.CONFIG_V2, stale="drop_then_score").where(F.col("as_of") == F.lit(last))
    assert {r["symbol"] for r in scored.collect()} == {r["symbol"] for r in fresh.collect()} == {"000002", "000003"}
    assert sorted(r["rank"] for r in fresh.collect()) == [1, 2]
    assert len({r["rank"] for r in scored.collect()}) == 2 and max(r["rank"] for r in scored.collect()) == 3


def test_registered_factor_joins_the_panel(spark):
    W.register_factor("close_squared", lambda w: F.col("close") * F.col("close"))
    bars = trend_bars(spark, [("000001", 0.01, 3e7)])
    r = W.latest_bars(W.factor_panel(bars, extra=["close_squared"])).first()
    assert r["close_squared"] == pytest.approx(r["close"] ** 2)


def test_validate_bars_rules(spark):
    d = business_days("2024-01-02", 3)
    good = bars_from(spark, [("1", d[0], 10, 10, 1), ("1", d[1], 10, 10, 1)])
    clean = W.validate_bars(good).require()
    assert {r["symbol"] for r in clean.collect()} == {"000001"}
    bad = bars_from(spark, [("1", d[0], 10, 10, 1), ("1", d[0], 10, 11, 1), ("1", d[2], -1, 10, 1)])
    checked = W.validate_bars(bad)
    assert {r["rule"] for r in checked.violations.collect()} == {"duplicate_key", "price_not_positive"}
    assert checked.clean.count() == 0
    with pytest.raises(DataQualityError):
        checked.require()


def test_long_symbol_is_not_cut(spark):
    from tidemark.functions.symbols import pad_symbol

    got = spark.createDataFrame([("1",), ("12345678",)], "s string").select(pad_symbol(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in got] == ["000001", "12345678"]
