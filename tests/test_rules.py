import pytest
from helpers import day, ts
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions import rules as R


def one(spark, **exprs):
    return spark.range(1).select(*[v.alias(k) for k, v in exprs.items()]).first()


def cost(spark, notional, side, date, kind="stock", rules=R.TradingRules()):
    return one(spark, **R.trade_cost(F.lit(float(notional)), F.lit(side), F.lit(date).cast("date"), F.lit(kind), rules))


def test_stamp_duty_cutover(spark):
    for date, rate in (("2023-08-25", 0.001), ("2023-08-28", 0.0005), ("2008-09-18", None)):
        assert one(spark, r=R.stamp_duty_rate(F.lit(date).cast("date"), F.lit("sell")))["r"] == rate
    assert one(spark, r=R.stamp_duty_rate(F.lit("2000-01-01").cast("date"), F.lit("buy")))["r"] == 0.0


@pytest.mark.parametrize("board,st,date,pct", [
    ("创业板", False, "2020-08-21", 0.10), ("创业板", False, "2020-08-24", 0.20), ("科创板", False, "2024-01-02", 0.20), ("北交所", False, "2024-01-02", 0.30),
    ("上证主板", True, "2026-07-03", 0.05), ("上证主板", True, "2026-07-06", 0.10), ("主板", False, "2024-01-02", 0.10), ("ETF20", False, "2024-01-02", 0.20), ("ETF10", True, "2024-01-02", 0.10),
])
def test_price_limits(spark, board, st, date, pct):
    assert one(spark, p=R.price_limit_pct(F.lit(board), F.lit(st), F.lit(date).cast("date")))["p"] == pct


def test_default_costs(spark):
    buy, sell = cost(spark, 1000, "buy", "2026-01-05"), cost(spark, 10000, "sell", "2026-01-05")
    assert (buy["commission"], buy["stamp_duty"]) == (5.0, 0.0) and (sell["commission"], sell["stamp_duty"]) == (5.0, 5.0)


def test_small_account_costs(spark):
    rules = R.TradingRules.small_account()
    buy, sell = cost(spark, 5512, "buy", "2026-01-05", rules=rules), cost(spark, 5584, "sell", "2026-01-05", rules=rules)
    assert (buy["commission"], buy["transfer_fee"], buy["stamp_duty"]) == (5.0, 0.06, 0.0)
    assert (sell["commission"], sell["transfer_fee"], sell["stamp_duty"]) == (5.0, 0.06, 2.79)
    assert cost(spark, 20000, "buy", "2026-01-05", rules=rules)["commission"] == 5.86
    etf = cost(spark, 3000, "sell", "2026-01-05", "etf", rules)
    assert (etf["commission"], etf["stamp_duty"], etf["transfer_fee"]) == (0.5, 0.0, 0.0)


def test_cost_violations(spark):
    assert cost(spark, -1, "buy", "2026-01-05")["cost_violation"] == "negative_notional"
    assert cost(spark, 10, "hold", "2026-01-05")["cost_violation"] == "unsupported_side"
    assert cost(spark, 10, "sell", "2001-01-05")["cost_violation"] == "stamp_duty_not_modelled"
    assert cost(spark, 0, "sell", "2026-01-05")["total_cost"] == 0.0


def test_limits_and_fills(spark):
    low, high = R.limit_prices(F.lit(10.0), F.lit(0.1))
    r = one(spark, lo=low, hi=high, b=R.limit_blocked(F.lit("buy"), F.lit(11.0), F.lit(10.0), F.lit(0.1)), s=R.limit_blocked(F.lit("sell"), F.lit(9.0), F.lit(10.0), F.lit(0.1)),
            p=R.fill_price(F.lit(10.0), F.lit("buy"), 5), q=R.fill_price(F.lit(10.0), F.lit("sell"), 5), z=R.fill_price(F.lit(0.0), F.lit("buy"), 5), n=R.round_lot(F.lit(250.0)), m=R.round_lot(F.lit(-5.0)))
    assert (r["lo"], r["hi"], r["b"], r["s"], r["n"], r["m"], r["z"]) == (9.0, 11.0, True, True, 200, 0, None)
    assert r["p"] == pytest.approx(10.005) and r["q"] == pytest.approx(9.995)


@pytest.mark.parametrize("signal,at,reason", [
    ("2026-10-12", "2026-10-12 07:00", "before_signal_close_or_future_signal"), ("2026-10-12", "2026-10-12 07:10", "eligible_after_close"), ("2026-10-12", "2026-10-12 16:30", "eligible_overnight"),
    ("2026-10-12", "2026-10-13 01:14", "eligible_overnight"), ("2026-10-12", "2026-10-13 01:15", "expired_before_preopen"), ("2026-10-10", "2026-10-10 08:00", "non_weekday_signal"),
])
def test_clock(spark, signal, at, reason):
    df = spark.createDataFrame([(day(signal), ts(at))], "d date, t timestamp")
    assert df.select(L.after_close_gate(F.col("d"), F.col("t")).alias("r")).first()["r"] == reason


def test_labels(spark):
    got = one(spark, a=L.data_quality_label(F.lit("bootstrap_x"), F.lit("m")), b=L.data_quality_label(F.lit("spot"), F.lit("degraded_current_universe")), c=L.data_quality_label(F.lit("spot"), F.lit("m")))
    assert (got["a"], got["b"], got["c"]) == ("degraded", "degraded", "normal")


@pytest.mark.parametrize("title,label", [
    ("关于公司股票被实施其他风险警示的公告", "risk_warning_apply_candidate"), ("关于撤销退市风险警示的公告", "risk_warning_remove_candidate"), ("关于撤销公司股票*ST的公告", "risk_warning_remove_candidate"),
    ("关于股票终止上市的公告", "delisting_related"), ("年度报告", "other_risk_disclosure"), ("关于撤销退市风险警示并实施其他风险警示的公告", "risk_warning_remove_candidate"),
])
def test_titles(spark, title, label):
    assert one(spark, t=L.classify_title(F.lit(title)))["t"] == label
