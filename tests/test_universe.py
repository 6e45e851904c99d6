import pytest
from helpers import day, rows, trend_bars, ts
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import normalize as N
from tidemark.operators import universe as U


@pytest.fixture(scope="module")
def master(spark):
    m = lambda s, x, b, d, st: (s, "n" + s, x, b, day(d), None, 100.0, 50.0, st, True, ts("2026-10-12T08:00"))
    return spark.createDataFrame([m("000001", "SZSE", "主板", "1991-04-03", False), m("000002", "SZSE", "主板", "1991-01-29", False), m("300001", "SZSE", "创业板", "2026-08-01", False),
                                  m("600001", "SSE", "上证主板", "2000-01-01", True), m("920001", "BSE", "北交所", "2020-01-01", False)], S.MASTER)


@pytest.fixture(scope="module")
def spot(spark):
    raw = spark.createDataFrame([(s, "n", 10.0, a, 1.0, 1e9, 5e8, k) for k, (s, a) in enumerate((("1", 1e8), ("2", 3e8), ("300001", 5e8), ("600001", 8e8), ("920001", 2e9)))],
                                "`代码` string, `名称` string, `最新价` double, `成交额` double, `换手率` double, `总市值` double, `流通市值` double, seq long")
    return N.normalize_spot(raw, order="seq")


def test_select_liquid(spark, master, spot):
    got = U.select_liquid(master, spot, "2026-10-12", limit=5)
    assert [r["symbol"] for r in got.collect()] == ["000002", "000001"] and {r["screen_source"] for r in got.collect()} == {"spot_amount"}
    with pytest.raises(ValueError):
        U.select_liquid(master, spot, "2026-10-12", exchanges=("NYSE",))


def test_spot_coverage_gate(spark, master, spot):
    r = U.spot_coverage(master, spot.where("symbol in ('000001')")).first()
    assert (r["listed"], r["covered"], r["coverage"], r["passed"]) == (4, 1, 0.25, False)
    assert U.spot_coverage(master, spot).first()["passed"] is True


def test_layers_fall_through(spark, master, spot):
    live = U.select_liquid(master, spot, "2026-10-12", limit=5, min_amount=1e10).select("symbol", "amount")
    cached = U.revalidate_candidates(spot, master, "2026-10-12", limit=2).select("symbol", "amount")
    got = U.layered_universe([("live", live), ("cache", cached)], needed=2)
    assert rows(got, "symbol", "layer_name") == [("000001", "cache"), ("000002", "cache")]
    closed = {"cache": spark.createDataFrame([(False,)], "passed boolean")}
    assert U.layered_universe([("live", live), ("cache", cached)], 2, closed).count() == 0


def test_spot_only_and_history(spark, master, spot):
    got = U.select_liquid_spot_only(spot, limit=3, exchanges=("SSE", "SZSE"))
    assert [r["symbol"] for r in got.collect()] == ["600001", "300001", "000002"] and {r["listing_age_verified"] for r in got.collect()} == {False}
    bars = trend_bars(spark, [("000001", 0.01, 6e7), ("000002", 0.01, 9e7)], n=40, start="2026-08-17")
    hist = U.select_liquid_from_history(master, bars, "2026-10-12", limit=2)
    assert [(r["symbol"], r["amount"]) for r in hist.collect()] == [("000002", pytest.approx(9e7)), ("000001", pytest.approx(6e7))]


def test_last_copy_of_a_spot_symbol_wins(spark):
    raw = spark.createDataFrame([("sh600000", "a", "1.0", 5.0, 1), ("sh600000", "b", "2.0", 6.0, 2), ("junk", "c", "1", 1.0, 3), ("sz000001", "d", "-", 1.0, 4)], "`代码` string, `名称` string, `最新价` string, `成交额` double, seq int")
    assert rows(N.normalize_spot(raw, layout="short", order="seq"), "symbol", "name", "last") == [("600000", "b", 2.0)]


def test_membership_boundaries(spark):
    life = spark.createDataFrame([("a", "SSE", day("2024-01-02"), day("2024-01-05")), ("b", "SZSE", day("2024-01-03"), None)], "symbol string, exchange string, list_date date, delist_date date")
    at = lambda d: [r[0] for r in rows(U.membership_as_of(life, d), "symbol")]
    assert at("2024-01-01") == [] and at("2024-01-02") == ["a"] and at("2024-01-04") == ["a", "b"] and at("2024-01-05") == ["b"]
    cal = spark.createDataFrame([(day(f"2024-01-0{i}"),) for i in range(1, 7)], "trade_date date")
    got = rows(U.membership_calendar(life, cal), "trade_date", "listed_total", "sse_listed", "szse_listed")
    assert [t[1:] for t in got] == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (2, 1, 1), (1, 0, 1), (1, 0, 1)]


def test_drop_stale(spark):
    bars = trend_bars(spark, [("000001", 0.01, 1e8), ("000002", 0.01, 1e8)], n=5)
    last = bars.agg(F.max("trade_date")).first()[0]
    kept, failed = U.drop_stale(bars.where(~((F.col("symbol") == "000001") & (F.col("trade_date") == F.lit(last)))))
    assert {r["symbol"] for r in kept.collect()} == {"000002"} and failed.first()["error"].startswith("stale_latest_bar:")


def test_master_layouts_and_rules(spark):
    raw = spark.createDataFrame([("1", "*ST甲", "主板", "1991-04-03"), ("2", "乙", "主板", "1991-01-29"), ("2", "乙", "主板", "1991-01-29")], "`A股代码` string, `A股简称` string, `板块` string, `A股上市日期` string")
    m = N.normalize_master(raw, "SZSE", F.lit("2026-01-01").cast("timestamp"))
    assert rows(m.distinct(), "symbol", "is_st") == [("000001", True), ("000002", False)]
    checked = N.validate_master(m)
    assert rows(checked.violations, "rule", "key") == [("duplicate_key", "000002")] and rows(checked.clean, "symbol") == [("000001",)]
    assert rows(N.validate_master(m.withColumn("exchange", F.lit("X"))).violations.distinct(), "rule")[0] == ("duplicate_key",)


def test_delisted_keeps_a_shares(spark):
    raw = spark.createDataFrame([("600001", "a", "1998-01-22", "2009-12-29"), ("900901", "b", "1992-02-21", "2020-01-01")], "`公司代码` string, `公司简称` string, `上市日期` string, `暂停上市日期` string")
    assert rows(N.normalize_delisted(raw, "SSE"), "symbol", "delist_date", "currently_listed") == [("600001", day("2009-12-29"), False)]


def test_name_changes_need_both_names(spark):
    ok = spark.createDataFrame([("000001", "2024-05-06", "甲", "*ST甲")], "`证券代码` string, `变更日期` string, `变更前简称` string, `变更后简称` string")
    got, warnings = N.name_changes_to_transitions(ok)
    assert not warnings and got.first()["st_transition"] is True
    got, warnings = N.name_changes_to_transitions(ok.drop("变更前简称"))
    assert warnings and got.count() == 0


def test_states_strict_and_lenient_flags(spark):
    raw = spark.createDataFrame([("1", "2024-01-02", "maybe", "1", 1.0), ("2", "2024-01-02", "0", "true", 0.0), ("3", "2024-01-02", "0", "0", None)], "symbol string, trade_date string, is_st string, trade_status string, close double")
    c = N.validate_states(raw)
    assert {r[0] for r in rows(c.violations, "rule")} == {"is_st_unknown", "tradable_without_close"} and rows(c.clean, "symbol") == [("000003",)]
    from tidemark.functions.symbols import parse_flag

    assert raw.select(parse_flag(F.col("is_st"), lenient=True).alias("f")).first()["f"] is False
