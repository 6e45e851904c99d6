import pytest
from helpers import rows, ts

from tidemark import schema as S
from tidemark.operators import normalize as N
from tidemark.operators import pit as P
from tidemark.operators.checks import DataQualityError


@pytest.fixture
def facts(spark):
    f = lambda sym, v, p, a, s: (sym, "roe", v, ts(p), ts(a), s)
    return spark.createDataFrame([
        f("000001", 0.10, "2023-12-31", "2024-03-20", "demo"), f("000001", 0.12, "2024-03-31", "2024-04-30", "demo"),
        f("000001", 0.125, "2024-03-31", "2024-05-15", "restatement"), f("600000", 0.08, "2023-12-31", "2024-03-25", "demo"),
    ], S.FACTS)


def test_revisions_become_visible_in_time(spark, facts):
    early = P.facts_visible_as_of(facts, "2024-05-10").where("symbol = '000001'")
    assert sorted(r["value"] for r in early.collect()) == [0.10, 0.12]
    late = P.facts_visible_as_of(facts, "2024-06-01").where("symbol = '000001'")
    assert sorted(r["value"] for r in late.collect()) == [0.10, 0.125]
    assert P.facts_latest_as_of(facts, "2024-04-15").where("symbol = '000001'").first()["value"] == 0.10


def test_many_cutoffs_equal_single_cutoffs(spark, facts):
    cutoffs = ["2024-01-01", "2024-03-22", "2024-04-15", "2024-05-10", "2024-06-01", "2024-07-01"]
    cols = ["symbol", "value", "period_end", "available_at"]
    visible = P.facts_visible_at_cutoffs(facts, cutoffs)
    latest = P.facts_latest_at_cutoffs(facts, cutoffs)
    for c in cutoffs:
        at = f"as_of = timestamp '{c}'"
        assert rows(visible.where(at), *cols) == rows(P.facts_visible_as_of(facts, c), *cols)
        assert rows(latest.where(at), *cols) == rows(P.facts_latest_as_of(facts, c), *cols)


def test_cutoffs_inside_days_and_as_a_table(spark, facts):
    f = lambda sym, v, p, a, s: (sym, "roe", v, ts(p), ts(a), s)
    more = facts.unionByName(spark.createDataFrame([f("7", 1.0, "2024-01-01T10:30", "2024-01-01T09:00", "a"), f("7", 2.0, "2024-01-01T10:30", "2024-01-01T10:45", "a"), ("7", "roe", 3.0, None, ts("2024-01-01"), "a")], S.FACTS))
    cutoffs = ["2024-01-01T08:00", "2024-01-01T10:30", "2024-01-01T10:44", "2024-01-01T10:45", "2024-01-01T23:59", "2024-05-01", "2024-05-15"]
    table = spark.createDataFrame([(ts(c),) for c in [*cutoffs, cutoffs[0]]], "at timestamp")
    cols = ["symbol", "value", "period_end", "available_at"]
    for many, one in ((P.facts_visible_at_cutoffs, P.facts_visible_as_of), (P.facts_latest_at_cutoffs, P.facts_latest_as_of)):
        got = many(more, table)
        assert rows(got, "as_of", *cols) == rows(many(more, cutoffs), "as_of", *cols)
        for c in cutoffs:
            assert rows(got.where(f"as_of = timestamp '{c}'"), *cols) == rows(one(more, c), *cols)


def test_summary_at_cutoffs_equals_the_rows_and_makes_none_of_them(spark, facts, capsys):
    from pyspark.sql import functions as F

    more = facts.unionByName(spark.createDataFrame([("7", "roe", None, ts("2024-04-01"), ts("2024-04-02"), "a"), ("7", "debt", 0.3, ts("2023-12-31"), ts("2024-06-20"), "a")], S.FACTS))
    cuts = spark.range(250).selectExpr("date_add(date'2023-12-01', cast(id as int)) AS at")
    for latest, listed in ((False, P.facts_visible_at_cutoffs), (True, P.facts_latest_at_cutoffs)):
        got = P.facts_summary_at_cutoffs(more, cuts, latest=latest)
        want = listed(more, cuts).groupBy("as_of").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("symbol").alias("symbols"), F.round(F.sum("value"), 6).alias("total"), F.max("period_end").alias("period_end"))
        cols = ["as_of", "facts", "symbols", "total", "period_end"]
        assert rows(got.withColumn("total", F.round("total", 6)), *cols) == rows(want, *cols)
        got.explain()
        assert "sequence(_first" not in capsys.readouterr().out


def test_plan_size_does_not_depend_on_the_number_of_cutoffs(spark, facts, capsys):
    sizes = []
    for n in (2, 400):
        cut = spark.range(n).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS at")
        P.facts_latest_at_cutoffs(facts, cut).explain()
        sizes.append(len(capsys.readouterr().out))
    assert abs(sizes[0] - sizes[1]) < 200


def test_fact_before_its_period_is_refused(spark):
    bad = spark.createDataFrame([("1", "roe", 0.1, ts("2024-03-31"), ts("2024-03-01"), "x")], S.FACTS)
    with pytest.raises(DataQualityError):
        N.validate_facts(bad).require()


def test_merge_facts(spark, facts):
    same = P.merge_facts(facts, facts)
    assert same.violations.count() == 0 and same.clean.count() == 4
    changed = facts.withColumn("value", facts["value"] + 1)
    assert P.merge_facts(facts, changed).violations.count() == 4


ITEMS = {"revenue": "利润表::营业总收入", "profit": "利润表::净利润", "ocf": "现金流量表::经营活动产生的现金流量净额", "assets": "资产负债表::资产总计", "debt": "资产负债表::负债合计"}


@pytest.fixture
def statements(spark):
    out = []
    for period, seen, values in (
        ("2023-06-30", "2023-08-30", dict(revenue=100, profit=10, ocf=12, assets=80, debt=36)), ("2024-06-30", "2024-08-30", dict(revenue=120, profit=12, ocf=15, assets=100, debt=50)),
        ("2024-06-30", "2024-09-15", dict(revenue=126, profit=14)),
    ):
        out += [("000001", ITEMS[k], float(v), ts(period), ts(seen), "demo") for k, v in values.items()]
    return spark.createDataFrame(out, S.FACTS)


def test_fundamental_factors(spark, statements):
    r = P.fundamental_factors(statements, "2024-09-01").first()
    want = dict(revenue_yoy=0.20, net_profit_yoy=0.20, net_margin=0.10, ocf_to_net_profit=1.25, debt_to_assets=0.50, fundamental_coverage=1.0)
    for k, v in want.items():
        assert r[k] == pytest.approx(v)
    later = P.fundamental_factors(statements, "2024-09-20").first()
    assert later["revenue_yoy"] == pytest.approx(0.26) and later["net_profit_yoy"] == pytest.approx(0.40)


def test_growth_is_null_after_a_loss(spark, statements):
    from pyspark.sql import functions as F

    loss = (F.col("metric") == ITEMS["profit"]) & (F.year("period_end") == 2023)
    r = P.fundamental_factors(statements.withColumn("value", F.when(loss, -5.0).otherwise(F.col("value"))), "2024-09-01").first()
    assert r["net_profit_yoy"] is None and r["fundamental_coverage"] == pytest.approx(0.8)


def test_snapshot_failures(spark, statements):
    wanted = spark.createDataFrame([("000001",), ("000002",)], "symbol string")
    ok, failed = P.fundamental_snapshot(wanted, statements, "2024-09-01")
    assert rows(ok, "symbol") == [("000001",)] and rows(failed, "symbol", "error") == [("000002", "no_visible_fundamental_factors")]


def test_statement_to_facts(spark):
    raw = spark.createDataFrame([("1", "利润表", "2024-03-31", "2024-04-26", "2024-05-03", "CNY", "123.0", "10.0")],
                                "symbol string, statement string, `报告日` string, `公告日期` string, `更新日期` string, `币种` string, `营业收入` string, `净利润` string")
    got = N.statement_to_facts(raw)
    assert rows(got, "symbol", "metric", "value") == [("000001", "利润表::净利润", 10.0), ("000001", "利润表::营业收入", 123.0)]
    assert {r["available_at"] for r in got.collect()} == {ts("2024-05-03")}


def test_fundamentals_at_cutoffs_equal_single_ones(spark, statements):
    cuts = ["2024-09-01", "2024-09-20", "2000-01-01"]
    many = P.fundamental_factors_at_cutoffs(statements, cuts)
    one = P.fundamental_factors(statements, cuts[0]).unionByName(P.fundamental_factors(statements, cuts[1]))
    assert sorted(map(str, many.select(one.columns).collect())) == sorted(map(str, one.collect()))
    wanted = spark.createDataFrame([("000001",), ("000002",)], "symbol string")
    ok, failed = P.fundamental_snapshot_at_cutoffs(wanted, statements, cuts)
    assert ok.count() == 2 and failed.count() == 4


def test_fundamentals_at_every_day_make_no_row_per_fact_and_change(spark, statements):
    """Revised prior years, revisions to nothing, another name of an item, older periods that come late."""
    more = [("000001", ITEMS["revenue"], 105.0, "2023-06-30", "2024-09-20"), ("000001", ITEMS["profit"], None, "2024-06-30", "2024-10-05"), ("000001", "利润表::营业收入", 90.0, "2023-12-31", "2024-10-08"),
            ("000001", "利润表::归属于母公司所有者的净利润", 13.0, "2024-06-30", "2024-10-10"), ("000002", ITEMS["profit"], 3.0, "2024-06-30", "2024-09-01"), ("000002", ITEMS["revenue"], None, "2024-06-30", "2024-09-11"),
            ("000001", ITEMS["revenue"], 150.0, "2024-09-30", "2024-10-12"), ("000001", ITEMS["revenue"], 99.0, "2023-09-30", "2024-10-14"), ("000001", ITEMS["revenue"], 160.0, "2024-12-31", "2024-10-14")]
    facts = statements.unionByName(spark.createDataFrame([(a, b, c, ts(d), ts(e), "demo") for a, b, c, d, e in more], S.FACTS))
    cuts = [f"2024-{m:02}-{d:02}" for m, d in ((9, 1), (9, 12), (9, 16), (9, 21), (10, 6), (10, 9), (10, 11), (10, 13), (10, 15))] + ["2025-01-02"]
    many = P.fundamental_factors_at_cutoffs(facts, cuts)
    assert "_changes" not in str(many._jdf.queryExecution().optimizedPlan())
    got = {(r["symbol"], r["fundamental_as_of"]): r.asDict() for r in many.collect()}
    want = {}
    for c in cuts:
        want |= {(r["symbol"], r["fundamental_as_of"]): r.asDict() for r in P.fundamental_factors(facts, c).collect()}
    assert got == want


def test_snapshot_as_of(spark):
    m = spark.createDataFrame([("1", "old", ts("2024-01-05")), ("1", "new", ts("2024-02-05"))], "symbol string, name string, observed_at timestamp")
    got = P.snapshot_as_of(m, ["2023-12-31", "2024-01-20", "2024-03-01"])
    assert rows(got, "as_of", "name") == [(ts("2024-01-20"), "old"), (ts("2024-03-01"), "new")]
    assert rows(P.snapshot_latest(m), "name") == [("new",)]
    assert rows(P.uncovered_cutoffs(m, ["2023-12-31", "2024-01-20"]), "as_of") == [(ts("2023-12-31"),)]
    assert P.uncovered_cutoffs(m.limit(0), ["2024-01-20"]).count() == 1
