import random

import pytest
from helpers import bars_from, business_days, day, rows, trend_bars
from pyspark.sql import functions as F

from tidemark.operators import asof as J
from tidemark.operators import portfolio as P

RANK_SCHEMA = "as_of date, symbol string, board string, rank int, is_st boolean, close double, momentum_20 double, trend_close_ma20 double"


def ranking(spark, data):
    return spark.createDataFrame(data, RANK_SCHEMA)


def model(data, c):
    """The selection rule as plain Python over one config."""
    dates, held, out = sorted({r[0] for r in data}), {}, []
    for i, d in enumerate(dates):
        if i % c.rebalance_every:
            continue
        frame = sorted([r for r in data if r[0] == d], key=lambda r: (r[3], r[1]))
        at = {r[1]: r for r in frame}
        picked = []
        for s in sorted(held):
            age, r = i - held[s][2], at.get(s)
            young = age < c.minimum_holding
            good = r is not None and r[3] <= c.keep_rank_max and (not c.keep_needs_trend or r[7] > 0)
            if young or good:
                picked.append(s)
        picked = picked[: c.max_stock_positions]
        for r in frame:
            if len(picked) >= c.max_stock_positions:
                break
            ok = r[1] not in picked and r[3] <= c.entry_rank_max and (not c.entry_needs_momentum or r[6] > 0) and (not c.entry_needs_trend or r[7] > 0)
            if ok and r[5] * 100 * (1 + c.affordability_buffer) <= c.ticket:
                picked.append(r[1])
        for s in set(held) - set(picked):
            out.append((c.config_id, d, s, 0.0, held[s][0], None))
        new = {}
        for s in picked:
            r, old = at.get(s), held.get(s)
            new[s] = old or (r[2], r[4], i)
            out.append((c.config_id, d, s, c.stock_weight_per_position, new[s][0], r[3] if r else None))
        held = new
    return sorted(out, key=str)


def test_hold_buffer_matches_model_on_random_portfolios(spark):
    rng, data = random.Random(11), []
    for d in business_days("2026-01-05", 24):
        names = rng.sample(range(1, 30), 22)
        for rank, n in enumerate(names, 1):
            data.append((d, f"{n:06d}", rng.choice(["主板", "创业板"]), max(1, rank - rank % 2), False, rng.choice([5.0, 20.0, 49.0, 80.0]), rng.uniform(-1, 2), rng.uniform(-1, 2)))
    configs = [
        P.PortfolioRules("a"), P.PortfolioRules("b", rebalance_every=1, minimum_holding=3, max_stock_positions=4, stock_weight_per_position=0.15),
        P.PortfolioRules("c", rebalance_every=2, minimum_holding=0, entry_rank_max=12, keep_rank_max=14, entry_needs_momentum=False, keep_needs_trend=False),
    ]
    got = rows(P.hold_buffer_signals(ranking(spark, data), P.config_table(spark, configs)), "config_id", "trade_date", "symbol", "target_weight", "board", "source_rank")
    want = sorted([x for c in configs for x in model(data, c)], key=lambda t: tuple(map(str, t)))
    assert got == want


@pytest.mark.parametrize("rows_a_batch", [1, 3, 100_000])
def test_holdings_go_from_batch_to_batch(spark, rows_a_batch):
    rng, data = random.Random(12), []
    for d in business_days("2026-01-05", 15):
        for n in range(1, 41):  # most names tie at the keep rank
            data.append((d, f"{n:06d}", "主板", rng.choice([1, 2, 10, 10, 10, 10]), False, rng.choice([5.0, 20.0]), rng.uniform(-1, 2), rng.uniform(-1, 2)))
    configs = [P.PortfolioRules("a", rebalance_every=1, minimum_holding=2), P.PortfolioRules("b", rebalance_every=3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        got = rows(P.hold_buffer_signals(ranking(spark, data), P.config_table(spark, configs)), "config_id", "trade_date", "symbol", "target_weight", "board", "source_rank")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted([x for c in configs for x in model(data, c)], key=lambda t: tuple(map(str, t)))


def test_unaffordable_name_is_skipped(spark):
    d = day("2026-01-05")
    data = [(d, f"00000{i}", "主板", i, False, c, 0.1, 0.1) for i, c in enumerate([1400.0, 12.0, 10.0, 8.0], 1)]
    got = P.hold_buffer_signals(ranking(spark, data), P.config_table(spark, [P.PortfolioRules()]))
    assert [r[0] for r in rows(got, "symbol")] == ["000002", "000003", "000004"]
    assert got.agg(F.sum("target_weight")).first()[0] == pytest.approx(0.75)


def test_cadence_and_keep_buffer(spark):
    data = []
    for i, d in enumerate(business_days("2026-01-05", 10)):
        order = ["000001", "000002", "000003"] + [f"9{k:05d}" for k in range(9)]
        if i >= 5:
            order = order[1:9] + ["000001"] + order[9:]
        data += [(d, s, "主板", r, False, 10.0, 0.1, 0.1) for r, s in enumerate(order, 1)]
    got = P.hold_buffer_signals(ranking(spark, data), P.config_table(spark, [P.PortfolioRules()])).collect()
    days = business_days("2026-01-05", 10)
    assert {r["trade_date"] for r in got} == {days[0], days[5]}
    assert any(r["symbol"] == "000001" and r["trade_date"] == days[5] and r["target_weight"] == 0.25 for r in got)


def test_equal_weight_zero_rows(spark):
    a, b = day("2024-01-02"), day("2024-01-03")
    data = [(a, "000001", "主板", 1, False, 1.0, 1.0, 1.0), (a, "000002", "主板", 2, False, 1.0, 1.0, 1.0), (a, "000003", "主板", 3, False, 1.0, 1.0, 1.0),
            (b, "000001", "主板", 1, False, 1.0, 1.0, 1.0), (b, "000003", "主板", 2, False, 1.0, 1.0, 1.0), (b, "000002", "主板", 3, False, 1.0, 1.0, 1.0)]
    got = rows(P.equal_weight_signals(ranking(spark, data), 2), "trade_date", "symbol", "target_weight")
    assert (b, "000002", 0.0) in got and (b, "000003", 0.5) in got and len(got) == 5
    capped = P.equal_weight_signals(ranking(spark, data), 2, 0.3).where("target_weight > 0")
    assert {r["target_weight"] for r in capped.collect()} == {0.3}


def test_etf_sleeve_takes_unused_stock_budget(spark):
    etf = trend_bars(spark, [("510300", 0.01, 1e8), ("510500", 0.0, 1e8)], n=70, start="2025-09-01")
    last = etf.agg(F.max("trade_date")).first()[0]
    configs = P.config_table(spark, [P.PortfolioRules()])
    reb = spark.createDataFrame([("v2", last)], "config_id string, as_of date")
    stock = spark.createDataFrame([("v2", last, "000001", 0.25, "主板", False, "stock", 1)], "config_id string, trade_date date, symbol string, target_weight double, board string, is_st boolean, instrument_type string, source_rank int")
    got = P.etf_rotation(etf, reb, stock, configs)
    assert [(s, pytest.approx(w)) for s, w in rows(got, "symbol", "target_weight")] == [("510300", pytest.approx(0.40))]
    both, over = P.combine_signals(stock, got)
    assert both.agg(F.sum("target_weight")).first()[0] == pytest.approx(0.65) and over.count() == 0


def four_days(spark, opens, volumes=(1, 1, 1, 1), closes=(10, 10, 10, 10)):
    days = [day(f"2024-01-0{i}") for i in (2, 3, 4, 5)]
    return bars_from(spark, [("000001", d, o, c, v) for d, o, c, v in zip(days, opens, closes, volumes)])


def buy(spark, d="2024-01-02", board="主板", side="buy", symbol="000001"):
    return spark.createDataFrame([(day(d), symbol, board, False, side)], "trade_date date, symbol string, board string, is_st boolean, side string")


@pytest.mark.parametrize("opens,volumes,fill", [
    ((10, 10, 10, 10), (1, 1, 1, 1), "2024-01-03"), ((10, 11, 10.2, 10), (1, 1, 1, 1), "2024-01-04"), ((10, 10, 10, 10), (1, 0, 1, 1), "2024-01-04"), ((10, 11, 11, 11), (1, 1, 1, 1), None),
])
def test_next_tradable_bar(spark, opens, volumes, fill):
    r = J.next_tradable_bar(buy(spark), four_days(spark, opens, volumes)).first()
    assert r["fill_date"] == (day(fill) if fill else None)


def test_exit_uses_the_wider_board_limit(spark):
    days = [day(f"2024-01-0{i}") for i in (2, 3, 4, 5)]
    bars = bars_from(spark, [("300001", d, o, 10, 1) for d, o in zip(days, (10, 10, 8.8, 8.9))])
    sell = buy(spark, "2024-01-03", "创业板", "sell", "300001")
    assert J.next_tradable_bar(sell, bars).first()["fill_date"] == days[2]
    assert J.next_tradable_bar(sell.withColumn("board", F.lit("主板")), bars).first()["fill_date"] is None


def test_superseded_and_bounded_wait(spark):
    bars = four_days(spark, (10, 11, 11, 10))
    s = buy(spark).unionByName(buy(spark, "2024-01-03", side="sell")).withColumn("portfolio_id", F.lit("p"))
    got = {r["side"]: r["fill_date"] for r in J.next_tradable_bar(s, bars, keys=["portfolio_id"]).collect()}
    assert got["buy"] is None and got["sell"] == day("2024-01-04")
    assert J.next_tradable_bar(buy(spark), four_days(spark, (10, 11, 11, 10)), max_wait_days=2).first()["fill_date"] is None


def test_signal_fills_costs(spark):
    s = spark.createDataFrame([(day("2024-01-02"), "000001", 0.5, "主板", False, "stock")], "trade_date date, symbol string, target_weight double, board string, is_st boolean, instrument_type string")
    got = {r["scenario_id"]: r for r in P.signal_fills(s, four_days(spark, (10, 10, 10, 10)), 20000.0, scenarios={"s5": 5, "s20": 20}).collect()}
    assert got["s5"]["shares"] == 900 and got["s5"]["price"] == pytest.approx(10.005) and got["s20"]["slippage_cost"] > got["s5"]["slippage_cost"]
    assert got["s5"]["trade_date"] == day("2024-01-03") and got["s5"]["commission"] == 5.0 and got["s5"]["stamp_duty"] == 0.0


def test_target_weight_equity(spark):
    days = business_days("2024-01-02", 6)
    px = {"a": [10, 11, 12, 12, 12, 15], "b": [20, 20, 10, 10, 20, 20]}
    bars = bars_from(spark, [(s, d, p, p, 1) for s, ps in px.items() for d, p in zip(days, ps)])
    sig = spark.createDataFrame([("p", days[0], "a", 0.5), ("p", days[0], "b", 0.25), ("p", days[3], "a", 0.0), ("p", days[3], "b", 1.0)], "portfolio_id string, trade_date date, symbol string, target_weight double")
    got = {r["trade_date"]: r["equity"] for r in P.target_weight_equity(sig, bars).collect()}
    first = {1: 1.05, 2: 1 + 0.1 - 0.125, 3: 1 + 0.1 - 0.125}
    for i, v in first.items():
        assert got[days[i]] == pytest.approx(v)
    assert got[days[4]] == pytest.approx(first[3] * 2) and got[days[5]] == pytest.approx(first[3] * 2) and days[0] not in got
    paid = {r["trade_date"]: r["equity"] for r in P.target_weight_equity(sig, bars, cost_bps=10.0).collect()}
    assert paid[days[1]] == pytest.approx(1.05 * (1 - 0.75 * 0.001)) and paid[days[5]] == pytest.approx(first[3] * 2 * (1 - 0.75 * 0.001) * (1 - 1.25 * 0.001))


def test_mark_to_market_uses_last_close(spark):
    days = business_days("2024-01-02", 3)
    bars = bars_from(spark, [("a", days[0], 9, 10, 1), ("a", days[2], 11, 12, 1)])
    pos = spark.createDataFrame([("p", d, "a", 100.0) for d in days], "portfolio_id string, trade_date date, symbol string, shares double")
    got = dict(rows(J.mark_to_market(pos, bars, field="open"), "trade_date", "market_value"))
    assert got == {days[0]: 900.0, days[1]: 1000.0, days[2]: 1100.0}


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        P.PortfolioRules(entry_rank_max=20, keep_rank_max=10)
    with pytest.raises(ValueError):
        P.PortfolioRules(stock_weight_per_position=0.9)
    with pytest.raises(ValueError):
        P.PortfolioRules(max_stock_positions=5, stock_weight_per_position=0.25)
