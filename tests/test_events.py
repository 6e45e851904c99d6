import pytest
from helpers import day, rows, ts
from pyspark.sql import functions as F

from tidemark.operators import events as X
from tidemark.operators import normalize as N


def parse(spark, text, announced):
    df = spark.createDataFrame([(text, ts(announced))], "text string, announcement_time timestamp")
    return X.extract_status_events(df).first()


def test_apply_event(spark):
    r = parse(spark, "公司股票将于2023年5月4日停牌一天，2023年5月5日开市起复牌并实施退市风险警示，股票简称由“测试股份”变更为“*ST测试”。", "2023-05-04")
    assert (r["parse_status"], r["action"], r["effective_date"], r["before_name"], r["after_name"]) == ("verified", "apply_st", day("2023-05-05"), "测试股份", "*ST测试")
    assert r["is_st_before"] is False and r["is_st_after"] is True and "风险警示" in r["evidence_snippet"]


def test_remove_event(spark):
    r = parse(spark, "自2024年6月3日\n开市起撤销其他风险警示， 证券简称由“ST测试”变更为“测试股份”", "2024-05-31")
    assert (r["parse_status"], r["action"], r["effective_date"]) == ("verified", "remove_st", day("2024-06-03"))


@pytest.mark.parametrize("text", [
    "自2024年6月3日起实施退市风险警示，股票简称由“ST测试”变更为“*ST测试”。", "自2024年6月3日起撤销退市风险警示并继续实施其他风险警示，股票简称由“*ST测试”变更为“ST测试”。",
])
def test_no_boolean_transition(spark, text):
    assert parse(spark, text, "2024-05-31")["parse_status"] == "no_boolean_name_transition"


def test_year_is_resolved(spark):
    r = parse(spark, "公司股票自5月8日开市起实施其他风险警示，股票简称由测试股份变更为ST测试。", "2025-05-07")
    assert (r["parse_status"], r["effective_date"]) == ("verified", day("2025-05-08"))
    over = parse(spark, "公司股票自1月2日起实施其他风险警示，股票简称由“测试”变更为“ST测试”。", "2024-12-31")
    assert over["effective_date"] == day("2025-01-02")


def test_old_background_date_loses_by_distance(spark):
    filler = "说明" * 80
    r = parse(spark, f"公司自2024年4月20日起被立案调查。{filler}公司股票自2024年6月11日起实施其他风险警示，股票简称由“测试”变更为“ST测试”。", "2024-06-07")
    assert (r["parse_status"], r["effective_date"]) == ("verified", day("2024-06-11"))


@pytest.mark.parametrize("text,status", [
    ("   　\n", "no_text"), ("年度报告", "no_boolean_name_transition"), ("股票简称由“甲”变更为“ST甲”，风险警示", "no_explicit_effective_date"), ("股票简称由“甲”变更为“ST甲”，自2024年6月3日起", "no_consistent_action_date_pair"),
    ("自2024年6月3日起实施风险警示，股票简称由“甲”变更为“ST甲”。" + "说" * 600 + "股票简称由“甲”变更为“ST甲”", "verified"),
    ("自2024年6月3日起实施风险警示，撤销风险警示，简称由“甲”变更为“ST甲”，简称由“ST乙”变更为“乙”", "ambiguous_multiple_verified_events"),
    ("自2024年6月3日起撤销风险警示，继续被实施其他风险警示，简称由“ST乙”变更为“乙”", "no_consistent_action_date_pair"), ("自2024年13月3日起实施风险警示，简称由“甲”变更为“ST甲”", "no_explicit_effective_date"),
    ("其他风险警示的起始日为2024年6月3日，实施风险警示，简称由“甲”变更为“ST甲”", "verified"),
    ("其他风险警示的起始日为２０２４年６月３日，实施风险警示，简称由“甲”变更为“ST甲”", "verified"),
])
def test_statuses(spark, text, status):
    assert parse(spark, text, "2024-06-01")["parse_status"] == status


EV = "symbol string, cohort string, announcement_time timestamp, effective_date date, action string, is_st_before string, is_st_after string, pdf_url string, pdf_sha256 string"
ST = "symbol string, trade_date date, is_st boolean, trade_status boolean"


def event(spark, **change):
    base = dict(symbol="600001", cohort="SSE_apply", announcement_time=ts("2023-05-03"), effective_date=day("2023-05-04"), action="apply_st", is_st_before="False", is_st_after="true", pdf_url="http://x", pdf_sha256="a" * 64)
    base.update(change)
    return spark.createDataFrame([tuple(base.values())], EV)


def states(spark, data=(("2023-04-28", False, True), ("2023-05-04", True, True))):
    return spark.createDataFrame([("600001", day(d), s, t) for d, s, t in data], ST)


@pytest.mark.parametrize("change,data,verdict", [
    ({}, None, "sample_match"), ({"announcement_time": ts("2023-05-05")}, None, "publication_after_effective_date"), ({"announcement_time": ts("2023-05-04")}, None, "same_day_disclosure_timing_unverified"),
    ({"cohort": "SSE_remove"}, None, "pdf_direction_conflicts_with_announcement_cohort"), ({}, (("2023-04-28", False, True),), "missing_effective_date_state"),
    ({}, (("2023-03-01", False, True), ("2023-05-04", True, True)), "missing_or_stale_prior_state"), ({}, (("2023-04-28", True, True), ("2023-05-04", True, True)), "independent_state_conflict"),
])
def test_reconcile_verdicts(spark, change, data, verdict):
    s = states(spark, data) if data else states(spark)
    assert X.reconcile_events(event(spark, **change), s).require().first()["verdict"] == verdict


@pytest.mark.parametrize("change,rule", [({"pdf_sha256": "zz"}, "digest_invalid"), ({"pdf_url": "ftp"}, "url_invalid"), ({"is_st_before": "true"}, "no_transition")])
def test_reconcile_violations(spark, change, rule):
    assert rows(X.reconcile_events(event(spark, **change), states(spark)).violations, "rule") == [(rule,)]


CH = "symbol string, change_date date, old_name string, new_name string, is_st_before boolean, is_st_after boolean, st_transition boolean, source string"


@pytest.mark.parametrize("new,before,after,data,verdict", [
    ("*ST甲", False, True, (("2024-04-30", False, True), ("2024-05-06", True, True)), "historical_state_matches_official_change"),
    ("甲退", True, False, (("2024-04-30", True, True), ("2024-05-06", False, True)), "delisting_rename_not_st_removal_evidence"),
    ("*ST甲", False, True, (("2024-04-30", False, True),), "missing_exact_change_day_state"), ("*ST甲", False, True, (("2024-03-01", False, True), ("2024-05-06", True, True)), "missing_or_stale_previous_state"),
    ("*ST甲", False, True, (("2024-04-30", False, True), ("2024-05-06", True, False)), "status_on_suspended_day_requires_review"), ("*ST甲", False, True, (("2024-04-30", True, True), ("2024-05-06", True, True)), "official_vs_archive_state_conflict"),
])
def test_name_transition_verdicts(spark, new, before, after, data, verdict):
    c = spark.createDataFrame([("600001", day("2024-05-06"), "甲", new, before, after, True, N.TRANSITION_SOURCE)], CH)
    got = X.audit_name_transitions(c, states(spark, data), first="2023-01-03", last="2026-11-03")
    assert got.require().first()["verdict"] == verdict


def test_crosscheck_window(spark):
    e = event(spark)
    assert X.crosscheck_events(e, states(spark)).first()["status"] == "matched"
    assert X.crosscheck_events(e, states(spark, (("2023-04-01", False, True), ("2023-05-04", True, True)))).first()["status"] == "missing_prior_state"
    assert X.crosscheck_events(e, states(spark, (("2023-04-28", False, True),))).first()["status"] == "missing_effective_date_row"
    assert X.crosscheck_events(e, states(spark, (("2022-04-28", False, True),))).first()["status"] == "error:no_history"


def test_exceptions(spark):
    v = spark.createDataFrame([("200001", day("2024-01-02"), X.VERDICT_MISSING), ("000001", day("2024-01-03"), X.VERDICT_DELISTING), ("000002", day("2024-01-04"), X.VERDICT_MATCH)], "symbol string, change_date date, verdict string")
    life = spark.createDataFrame([("000001",), ("000002",)], "symbol string")
    scoped = X.exception_scope(v, life).require()
    assert rows(scoped, "symbol", "scope") == [("000001", "delisting_rename"), ("200001", "b_share_out_of_scope")]
    c = spark.createDataFrame([("000001", day("2024-01-02")), ("000001", day("2024-01-03")), ("000001", day("2024-01-05"))], "symbol string, trade_date date")
    impact = X.exception_membership(scoped, c)
    assert rows(impact, "symbol", "candidate_days_on_or_after") == [("000001", 2), ("200001", 0)]
    s = X.exception_summary(impact).first()
    assert (s["membership_hits"], s["no_overlap"]) == (2, False)
    bad = X.exception_scope(v.withColumn("symbol", F.lit("000001")), life)
    assert ("missing_state_of_a_share",) in rows(bad.violations, "rule")


def test_month_windows(spark):
    p = spark.createDataFrame([(day("2024-01-15"), day("2024-03-05"))], "start date, end date")
    assert rows(X.month_windows(p), "window_start", "window_end") == [(day("2024-01-15"), day("2024-01-31")), (day("2024-02-01"), day("2024-02-29")), (day("2024-03-01"), day("2024-03-05"))]


def test_announcement_times(spark):
    cols = "secCode string, secName string, announcementTitle string, announcementTime string"
    epoch = spark.createDataFrame([("600000", "n", "t", "1704067200000"), ("900901", "b", "t", "1704067200000")], cols)
    assert rows(N.normalize_announcements(epoch, "c"), "symbol", "announcement_time") == [("600000", ts("2024-01-01T08:00"))]
    text = spark.createDataFrame([("600000", "n", "t", "2024-01-01 09:30:00")], cols)
    assert rows(N.normalize_announcements(text, "c"), "announcement_time") == [(ts("2024-01-01T09:30"),)]
    with pytest.raises(ValueError):
        N.normalize_announcements(text.drop("secName"), "c")
