import pytest
from helpers import day, rows, ts
from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators import evidence as E
from tidemark.operators import reconstruct as K
from tidemark.operators.checks import DataQualityError

LIFE = "symbol string, name string, exchange string, board string, list_date date, delist_date date"


@pytest.fixture
def archive(spark):
    d = day("2024-05-09")
    life = spark.createDataFrame([(s, f"n{s}", x, "主板", day("2020-01-01"), day(e) if e else None) for s, x, e in (
        ("000001", "SZSE", None), ("000002", "SZSE", None), ("600000", "SSE", None), ("600001", "SSE", None), ("600002", "SSE", "2024-05-10"))], LIFE)
    amounts = spark.createDataFrame([(s, d, a) for s, a in (("000001", 1e8), ("000002", 9e7), ("600000", 8e7), ("600001", 7e7), ("600002", 6e7))], "symbol string, trade_date date, amount double")
    states = spark.createDataFrame([("000001", d, False, True, 10.0), ("000002", d, True, True, 11.0), ("600000", d, False, True, 12.0), ("600001", d, False, False, 13.0), ("600002", d, False, True, 14.0)],
                                   "symbol string, trade_date date, is_st boolean, trade_status boolean, close double")
    return life, amounts, states


def test_reconstruct_day(spark, archive):
    got = K.reconstruct_candidates(*archive, limit=3)
    assert rows(got.candidates, "rank_by_amount", "symbol") == [(1, "000001"), (2, "600000"), (3, "600002")]
    a = got.audit.first()
    assert (a["state_coverage"], a["members"], a["cutoff_amount"], a["cutoff_tie_count"]) == (1.0, 5, 6e7, 1) and got.failures.count() == 0


def test_delist_day_is_exclusive(spark, archive):
    life, amounts, states = archive
    nxt = lambda df: df.withColumn("trade_date", F.date_add("trade_date", 1))
    got = K.reconstruct_candidates(life, nxt(amounts), nxt(states), limit=3)
    assert rows(got.failures, "reason", "members", "liquid_count") == [("too_few_liquid_members", 4, 2)]


@pytest.mark.parametrize("drop_amount,drop_state,reason", [
    (None, "000001", "state_archive_incomplete"), ("000001", None, "amount_archive_incomplete"), ("000002", None, None), ("600001", None, None),
])
def test_missing_rows(spark, archive, drop_amount, drop_state, reason):
    life, amounts, states = archive
    got = K.reconstruct_candidates(life, amounts.where(F.col("symbol") != (drop_amount or "")), states.where(F.col("symbol") != (drop_state or "")), limit=3)
    assert [r["reason"] for r in got.failures.collect()] == ([reason] if reason else [])
    assert got.candidates.count() == (0 if reason else 3)


def test_calendar_dates_without_archives_fail(spark, archive):
    cal = spark.createDataFrame([(day("2024-05-09"),), (day("2024-05-10"),)], "trade_date date")
    got = K.reconstruct_candidates(*archive, calendar=cal, limit=3)
    assert rows(got.failures, "trade_date", "reason") == [(day("2024-05-10"), "missing_amount_and_state")]
    outside = K.archive_calendar(archive[1], archive[2], cal.where("trade_date > '2024-05-09'"))
    assert ("not_in_calendar",) in rows(outside, "status")
    s = K.calendar_summary(got, external_calendar=True).first()
    assert (s["status"], s["success_rate"], s["candidate_calendar_complete"]) == ("incomplete", 0.5, False)


def test_cutoff_ties_are_counted(spark, archive):
    life, amounts, states = archive
    tied = amounts.withColumn("amount", F.lit(6e7))
    r = K.reconstruct_candidates(life, tied, states, limit=2)
    assert rows(r.candidates, "symbol") == [("000001",), ("600000",)] and r.audit.first()["cutoff_tie_count"] == 3


def recovery(spark, **change):
    base = [("600001", f"2024-01-0{i}", "sh.600001", a, t, s) for i, a, t, s in ((2, "5000", "1", "0"), (3, "", "1", "1"), (4, "", "0", "0"))]
    raw = spark.createDataFrame(base, "symbol string, date string, code string, amount string, tradestatus string, isST string")
    states = spark.createDataFrame([("600001", day("2024-01-02"), False, True, 10.0), ("600001", day("2024-01-03"), True, True, 10.0), ("600001", day("2024-01-04"), False, False, 10.0)],
                                   "symbol string, trade_date date, is_st boolean, trade_status boolean, close double")
    return K.recover_amounts(raw.withColumns({k: F.lit(v) for k, v in change.items()}), states)


def test_recovery_complete(spark):
    got = recovery(spark)
    assert rows(got.amounts, "symbol", "trade_date", "amount") == [("600001", day("2024-01-02"), 5000.0)]
    assert rows(got.detail, "status", "unresolved_dates") == [("complete", 0)] and got.violations.count() == 0


@pytest.mark.parametrize("change,rule", [({"code": "sh.600002"}, "symbol_mismatch"), ({"isST": "1"}, "status_mismatch"), ({"tradestatus": "x"}, "invalid_flags"), ({"amount": "-1"}, "negative_amount"), ({"date": "2024-01-02"}, "invalid_or_duplicate_dates")])
def test_recovery_faults(spark, change, rule):
    got = recovery(spark, **change)
    assert rows(got.violations, "rule") == [(rule,)] and got.amounts.count() == 0 and got.detail.first()["status"] == "error"


def test_recovery_lists_open_days(spark):
    got = recovery(spark, amount="")
    assert rows(got.detail, "status", "unresolved_dates", "unresolved_examples") == [("incomplete", 1, "2024-01-02")]
    assert K.recovery_summary(got.detail).first()["status"] == "incomplete"


def test_content_hash(spark):
    df = spark.createDataFrame([("d", "a", 1), ("d", "b", 2), ("d", "b", 2), ("e", "a", None)], "k string, s string, n int")
    h = {r["k"]: r["content_hash"] for r in E.content_hash(df, ["k"], ["s", "n"]).collect()}
    again = {r["k"]: r["content_hash"] for r in E.content_hash(df.repartition(3).orderBy(F.desc("s")), ["k"], ["s", "n"]).collect()}
    assert h == again and h["d"] != h["e"]
    fewer = E.content_hash(df.distinct().where("k = 'd'"), ["k"], ["s", "n"]).first()["content_hash"]
    assert fewer != h["d"]
    blank = E.content_hash(spark.createDataFrame([("e", "a", "")], "k string, s string, n string"), ["k"], ["s", "n"]).first()["content_hash"]
    assert blank != h["e"]


def test_append_plan(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "k string, content_hash string")
    assert rows(E.append_plan(old, new, ["k"]), "k", "action") == [("a", "idempotent"), ("b", "conflict"), ("c", "insert")]


def test_compare_snapshots_tolerance(spark):
    a = spark.createDataFrame([("1", 1.0, "x"), ("2", 2.0, "x"), ("3", None, "x")], "s string, v double, t string")
    b = spark.createDataFrame([("1", 1.0 + 1e-13, "x"), ("2", 2.1, "y"), ("3", None, "x"), ("4", 1.0, "x")], "s string, v double, t string")
    assert rows(E.compare_snapshots(a, b, ["s"], ["v"], ["t"]), "s", "verdict") == [("2", "differs:v,t"), ("4", "missing_in_stored")]


def test_ranges_read_each_snapshot_once_for_all_levels(spark):
    """Once for the tree and once for the rows of ranges that differ."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    a = spark.range(100).selectExpr("cast(id as string) AS s", "cast(id as double) AS v", "'x' AS t")
    b = a.where("s != '7'").mapInArrow(counted, a.schema)
    assert rows(E.compare_by_ranges(a, b, ["s"], ["v"], ["t"]), "s", "verdict") == [("7", "missing_in_new")]
    assert read.value <= 2 * 99


@pytest.mark.parametrize("have,due,status", [
    ("2 3 4", "1 2 3 4 5", "complete"), ("2 4", "2 3 4", "gap"), ("2 3 6", "2 3 5", "invalid_nontrading_evidence"), ("", "2 3", "no_evidence"),
])
def test_evidence_calendar(spark, have, due, status):
    mk = lambda text, c: spark.createDataFrame([(day(f"2024-01-0{x}"),) for x in text.split()], f"{c} date")
    assert E.evidence_calendar(mk(have, "evidence_date"), mk(due, "trade_date")).first()["status"] == status


MASTER = "symbol string, name string, exchange string, board string, list_date date, industry string, total_shares double, float_shares double, is_st boolean, is_listed boolean, observed_at timestamp"


def master(spark, st=False):
    return spark.createDataFrame([("000001", "n", "SZSE", "主板", day("1991-04-03"), None, 1.0, 1.0, st, True, ts("2026-10-12T08:00"))], MASTER)


def cands(spark, source="spot", symbol="000001"):
    return spark.createDataFrame([(day("2026-10-12"), symbol, "n", "SZSE", "主板", day("1991-04-03"), False, True, 1e8, source)],
                                 "evidence_date date, symbol string, name string, exchange string, board string, list_date date, is_st boolean, is_listed boolean, amount double, screen_source string")


def test_stage_evidence(spark):
    ok = E.stage_evidence(cands(spark), master(spark))
    assert ok.violations.count() == 0 and ok.clean.first()["candidate_count"] == 1
    assert rows(E.stage_evidence(cands(spark), master(spark, st=True)).violations, "rule") == [("is_st_disagrees",)]
    assert rows(E.stage_evidence(cands(spark, symbol="000009"), master(spark)).violations, "rule") == [("symbol_absent_from_master",)]
    late = E.stage_evidence(cands(spark), master(spark), F.lit("2026-10-13 08:00:00").cast("timestamp"))
    assert rows(late.violations, "rule") == [("master_not_the_one_observed",)]


def test_each_day_meets_its_own_master(spark):
    old = spark.createDataFrame([
        ("000001", "n", "SZSE", "主板", day("1991-04-03"), None, 1.0, 1.0, False, True, ts("2026-10-01T08:00")), ("000002", "m", "SSE", "主板", day("1991-04-03"), None, 1.0, 1.0, False, True, ts("2026-10-01T08:00")),
        ("000001", "n", "SZSE", "主板", day("1991-04-03"), None, 1.0, 1.0, True, True, ts("2026-10-10T08:00")), ("000002", "m", "SSE", "主板", day("1991-04-03"), None, 1.0, 1.0, False, True, ts("2026-10-10T08:00"))], MASTER)
    at = lambda d, st, symbol="000001", exchange="SZSE": (day(d), symbol, "n", exchange, "主板", day("1991-04-03"), st, True, 1e8, "spot")
    rows_in = [at("2026-09-30", False), at("2026-10-05", False), at("2026-10-09", True), at("2026-10-10", True), at("2026-10-11", True, "000009"), at("2026-10-12", True, exchange="XXX"), at("2026-10-13", False, "000002", "SSE")]
    many = spark.createDataFrame(rows_in, cands(spark).schema)
    staged = E.stage_evidence_days(many, old)
    assert rows(staged.violations, "key", "rule") == [("2026-09-30", "no_master_observed"), ("2026-10-09", "is_st_disagrees"), ("2026-10-11", "symbol_absent_from_master"), ("2026-10-12", "exchange_disagrees")]
    good = {r["evidence_date"]: r for r in staged.clean.collect()}
    assert sorted(good) == [day("2026-10-05"), day("2026-10-10"), day("2026-10-13")]
    assert good[day("2026-10-05")]["master_state_hash"] != good[day("2026-10-10")]["master_state_hash"] == good[day("2026-10-13")]["master_state_hash"] and {r["master_rows"] for r in good.values()} == {2}
    used = spark.createDataFrame([(day("2026-10-05"), ts("2026-10-01T08:00")), (day("2026-10-10"), ts("2026-10-01T08:00"))], "evidence_date date, master_observed_at timestamp")
    assert ("2026-10-10", "master_not_the_one_observed") in rows(E.stage_evidence_days(many, old, used).violations, "key", "rule")
    states = E.master_states(old)
    assert rows(states.groupBy("exchange").count(), "exchange", "count") == [("SSE", 1), ("SZSE", 2)]


def test_ledger_day_checks_the_hash(spark):
    c = cands(spark)
    days = E.content_hash(c, ["evidence_date"], ["symbol", "amount"]).select("evidence_date", F.col("content_hash").alias("candidate_hash"))
    assert E.ledger_day(c, days, "2026-10-12", ["symbol", "amount"]).require().count() == 1
    with pytest.raises(DataQualityError):
        E.ledger_day(c.withColumn("amount", F.lit(1.0)), days, "2026-10-12", ["symbol", "amount"]).require()


def test_state_intervals(spark):
    df = spark.createDataFrame([(day(f"2024-01-0{i}"), h) for i, h in enumerate("aabba", 1)], "evidence_date date, master_state_hash string")
    assert rows(E.state_intervals(df), "master_state_hash", "valid_from", "valid_to") == [("a", day("2024-01-01"), day("2024-01-03")), ("a", day("2024-01-05"), None), ("b", day("2024-01-03"), day("2024-01-05"))]


FIX = "symbol string, expected date, new date, published date"


def test_guarded_override(spark, archive):
    life = archive[0]
    good = spark.createDataFrame([("600002", day("2024-05-10"), day("2024-05-08"), day("2024-05-01"))], FIX)
    got = E.guarded_override(life, good)
    assert got.violations.count() == 0
    assert rows(got.clean.where("corrected"), "symbol", "delist_date", "original_delist_date") == [("600002", day("2024-05-08"), day("2024-05-10"))]
    for fix, rule in ((("600002", day("2024-05-11"), day("2024-05-08"), day("2024-05-01")), "stored_value_not_expected"), (("600002", day("2024-05-10"), day("2024-05-08"), day("2024-06-01")), "evidence_out_of_order"),
                      (("999999", None, day("2024-05-08"), day("2024-05-01")), "no_such_row")):
        bad = E.guarded_override(life, spark.createDataFrame([fix], FIX))
        assert rows(bad.violations, "rule") == [(rule,)] and bad.clean.where("corrected").count() == 0


def test_walk_forward_status(spark):
    days = spark.createDataFrame([(day("2024-01-02"), False), (day("2024-01-03"), True)], "evidence_date date, degraded_mode boolean")
    audit = E.evidence_calendar(days, days.select(F.col("evidence_date").alias("trade_date")))
    names = spark.createDataFrame([("a",)], "symbol string")
    r = E.walk_forward_status(audit, names, names, days).first()
    assert (r["status"], r["remaining_dates"], r["degraded_evidence_dates"]) == ("collecting", 19, "2024-01-03")
    r = E.walk_forward_status(audit, names, names.limit(0), days, block_days=1).first()
    assert r["status"] == "history_gap"


def shard_frames(spark):
    s = spark.createDataFrame([(i, 2, 10, 10, 1.0, "a", "b") for i in (0, 1)], "shard_index int, shard_count int, symbol_count int, success_count int, success_rate double, period_start string, period_end string")
    r = spark.createDataFrame([("1", day("2024-01-02"), 1.0, 0), ("2", day("2024-01-02"), 1.0, 1)], "symbol string, trade_date date, amount double, shard_index int")
    return r, s


def test_merge_shards_gates(spark):
    r, s = shard_frames(spark)
    assert A.merge_shards(r, s, 2).require().count() == 2
    rules = lambda r, s: {x[0] for x in rows(A.merge_shards(r, s, 2).violations, "rule")}
    assert rules(r.withColumn("symbol", F.lit("1")), s) == {"symbol_in_two_shards", "duplicate_symbol_date"}
    assert rules(r, s.where("shard_index = 0")) == {"shard_set_incomplete"}
    assert rules(r, s.withColumn("success_rate", F.lit(0.9))) == {"shard_below_success_rate"}
    assert rules(r.withColumn("amount", F.lit(None).cast("double")), s) == {"null_amount"}
    assert "duplicate_shard_index" in rules(r, s.withColumn("shard_index", F.lit(0)))


def test_shard_id_value(spark):
    from tidemark.functions.symbols import hash_shard

    assert spark.range(1).select(hash_shard(F.lit("1"), 32).alias("s")).first()["s"] == 16


def test_stable_sample(spark):
    df = spark.createDataFrame([(f"{i:06d}", "ab"[i % 2]) for i in range(20)], "symbol string, cohort string")
    a = rows(A.stable_sample(df, 3, F.col("symbol")), "cohort", "symbol")
    assert a == rows(A.stable_sample(df.repartition(5), 3, F.col("symbol")), "cohort", "symbol") and len(a) == 6


def test_build_lifecycle_overlap(spark):
    cols = "symbol string, name string, exchange string, board string, list_date date, currently_listed boolean"
    cur = spark.createDataFrame([("600000", "n", "SSE", "b", day("2000-01-01"), True)], cols)
    gone = cur.withColumns({"delist_date": F.lit("2020-01-01").cast("date"), "currently_listed": F.lit(False)})
    assert rows(A.build_lifecycle(cur, gone).violations, "rule") == [("current_and_delisted",)]
    assert A.build_lifecycle(cur, gone.withColumn("symbol", F.lit("600001"))).require().count() == 2
