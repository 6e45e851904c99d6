"""Daily candidate lists from lifecycle and archives, and amount recovery."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import pad_symbol
from tidemark.operators.normalize import day, number, union_all
from tidemark.operators.universe import MAIN_EXCHANGES, check_exchanges, is_member, membership_calendar, rankable, top_k


class Reconstruction(NamedTuple):
    candidates: DataFrame
    audit: DataFrame
    failures: DataFrame


def archive_calendar(amounts: DataFrame, states: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """One row per date: which archives and which calendar know it."""
    known = amounts.select("trade_date").distinct().withColumn("in_amounts", F.lit(True)).join(
        states.select("trade_date").distinct().withColumn("in_states", F.lit(True)), "trade_date", "full_outer"
    )
    if calendar is None:
        dated = known.withColumn("in_calendar", F.lit(None).cast("boolean"))
    else:
        dated = known.join(calendar.select("trade_date").distinct().withColumn("in_calendar", F.lit(True)), "trade_date", "full_outer")
        dated = dated.withColumn("in_calendar", F.coalesce("in_calendar", F.lit(False)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    outside = ~flag("in_calendar") & F.lit(calendar is not None)
    status = (
        F.when(outside, "not_in_calendar").when(~flag("in_amounts") & ~flag("in_states"), "missing_amount_and_state")
        .when(~flag("in_amounts"), "missing_amount").when(~flag("in_states"), "missing_state").otherwise("present")
    )
    return dated.select("trade_date", flag("in_amounts").alias("in_amounts"), flag("in_states").alias("in_states"), status.alias("status"))


def member_days(lifecycle: DataFrame, amounts: DataFrame, states: DataFrame, *, min_listing_days: int, exchanges) -> DataFrame:
    """Archive rows of members on each day; equi joins on (trade_date, symbol) and symbol only."""
    both = amounts.select("trade_date", "symbol", "amount", F.lit(True).alias("has_amount")).join(
        states.select("trade_date", "symbol", "is_st", "trade_status", "close", F.lit(True).alias("has_state")), ["trade_date", "symbol"], "full_outer"
    )
    life = lifecycle.where(F.upper("exchange").isin(*check_exchanges(exchanges)))
    cols = [c for c in ("symbol", "name", "exchange", "board", "list_date", "delist_date") if c in life.columns]
    joined = both.join(life.select(*cols), "symbol").where(is_member(F.col("trade_date"), min_listing_days=min_listing_days))
    has = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select(
        "trade_date", *cols, "amount", "is_st", "trade_status", "close", has("has_amount"), has("has_state"),
        rankable(F.col("is_st"), F.col("trade_status"), F.col("close")).alias("rankable"),
    )


def reconstruct_candidates(
    lifecycle: DataFrame, amounts: DataFrame, states: DataFrame, *, calendar: DataFrame | None = None, limit: int = 60,
    min_amount: float = 50_000_000.0, min_listing_days: int = 120, exchanges=MAIN_EXCHANGES,
) -> Reconstruction:
    """Candidates, audit and failures for every day in one plan.

    Members without rows cannot appear in a join of rows, so the member count of a day comes from
    the interval ends (a running sum over changed days) and absences are counted by difference.
    """
    if limit <= 0 or min_amount < 0 or min_listing_days < 0:
        raise ValueError("limit must be positive, amounts and ages not negative")
    dates = archive_calendar(amounts, states, calendar)
    counts = membership_calendar(lifecycle, dates, min_listing_days=min_listing_days, exchanges=exchanges).select(
        "trade_date", F.col("listed_total").alias("members")
    )
    rows = member_days(lifecycle, amounts, states, min_listing_days=min_listing_days, exchanges=exchanges)
    liquid = F.col("rankable") & F.col("has_amount") & F.coalesce(F.col("amount") >= min_amount, F.lit(False))
    rows = rows.withColumn("_eligible", liquid)
    per_day = rows.groupBy("trade_date").agg(
        F.count_if("has_amount").alias("_amounts"), F.count_if("has_state").alias("_states"),
        F.count_if(F.col("rankable") & ~F.col("has_amount")).alias("missing_rankable_amount"), F.count_if("_eligible").alias("liquid_count"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = dates.join(counts, "trade_date", "left").join(per_day, "trade_date", "left").select(
        "trade_date", "status", zero("members").alias("members"), (zero("members") - zero("_amounts")).alias("missing_amount"),
        (zero("members") - zero("_states")).alias("missing_state"), zero("missing_rankable_amount").alias("missing_rankable_amount"),
        zero("liquid_count").alias("liquid_count"),
    )
    reason = (
        F.when(F.col("status") != "present", F.col("status")).when(F.col("members") == 0, "no_listed_members")
        .when(F.col("missing_state") > 0, "state_archive_incomplete").when(F.col("missing_rankable_amount") > 0, "amount_archive_incomplete")
        .when(F.col("liquid_count") < limit, "too_few_liquid_members")
    )
    judged = days.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull())
    eligible = rows.where("_eligible").join(good.select("trade_date"), "trade_date", "left_semi").drop("_eligible")
    ranked = rank_by_amount(eligible, limit)
    cutoff = ranked.where(F.col("rank_by_amount") == limit).select("trade_date", F.col("amount").alias("cutoff_amount"))
    ties = eligible.join(cutoff, "trade_date").where(F.col("amount") == F.col("cutoff_amount")).groupBy("trade_date", "cutoff_amount").agg(
        F.count(F.lit(1)).alias("cutoff_tie_count")
    )
    audit = good.join(ties, "trade_date").select(
        "trade_date", "members", (1.0 - F.col("missing_amount") / F.col("members")).alias("amount_coverage"),
        (1.0 - F.col("missing_state") / F.col("members")).alias("state_coverage"), "missing_amount", "missing_state", "missing_rankable_amount",
        "liquid_count", F.lit(limit).alias("candidate_count"), "cutoff_amount", "cutoff_tie_count",
    )
    failures = judged.where(F.col("reason").isNotNull()).select(
        "trade_date", "reason", "members", "missing_state", "missing_rankable_amount", "liquid_count"
    )
    keep = [c for c in ("trade_date", "symbol", "name", "exchange", "board", "list_date", "delist_date", "amount", "close") if c in ranked.columns]
    tagged = ranked.select(*keep, "rank_by_amount", F.lit("historical_amount_reconstruction").alias("screen_source"))
    return Reconstruction(tagged, audit, failures)


def rank_by_amount(rows: DataFrame, limit: int) -> DataFrame:
    """Dense daily order by (amount desc, symbol); a per-task group limit precedes the shuffle."""
    order = [F.col("amount").desc(), F.col("symbol").asc()]
    best = top_k(rows, limit, order, ["trade_date"])
    return best.withColumn("rank_by_amount", F.row_number().over(Window.partitionBy("trade_date").orderBy(*order)))


def missing_rankable_examples(lifecycle, amounts, states, *, min_listing_days: int = 120, exchanges=MAIN_EXCHANGES, n: int = 10) -> DataFrame:
    """K5: first n offending names per failed day, found by a group limit."""
    rows = member_days(lifecycle, amounts, states, min_listing_days=min_listing_days, exchanges=exchanges)
    bad = top_k(rows.where(F.col("rankable") & ~F.col("has_amount")), n, [F.col("symbol").asc()], ["trade_date"])
    return bad.groupBy("trade_date").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("examples"))


def calendar_summary(result: Reconstruction, *, external_calendar: bool) -> DataFrame:
    """Success rate and completeness (an external calendar, no failures, at least 21 days)."""
    ok = result.audit.agg(F.count(F.lit(1)).alias("successful_dates"), F.min("trade_date").alias("_f1"), F.max("trade_date").alias("_l1"))
    bad = result.failures.agg(F.count(F.lit(1)).alias("failed_dates"), F.min("trade_date").alias("_f2"), F.max("trade_date").alias("_l2"))
    total = F.col("successful_dates") + F.col("failed_dates")
    return ok.join(F.broadcast(bad)).select(
        "successful_dates", "failed_dates", F.try_divide(F.col("successful_dates"), total).alias("success_rate"),
        F.least("_f1", "_f2").alias("first_date"), F.greatest("_l1", "_l2").alias("last_date"),
        F.when(F.col("failed_dates") == 0, "complete").otherwise("incomplete").alias("status"),
        (F.lit(external_calendar) & (F.col("failed_dates") == 0) & (F.col("successful_dates") >= 21)).alias("candidate_calendar_complete"),
    )


class Recovery(NamedTuple):
    amounts: DataFrame
    detail: DataFrame
    violations: DataFrame


def _overlap(raw: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sent rows by day, sent and independent rows of each day with ``_mismatch``)."""
    bit = lambda c: F.when(F.col(c).cast("string") == "1", True).when(F.col(c).cast("string") == "0", False)
    code = pad_symbol(F.element_at(F.split(F.col("code"), r"\."), -1))
    rows = raw.select(
        pad_symbol(F.col("symbol")).alias("symbol"), day("date").alias("trade_date"), code.alias("_code"), number("amount").alias("amount"),
        bit("tradestatus").alias("_trade"), bit("isST").alias("_st"),
    )
    state = states.select("symbol", "trade_date", "is_st", "trade_status", "close")
    per_key = rows.groupBy("symbol", "trade_date").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("_code") != F.col("symbol")).alias("_bad_code"),
        F.bool_or(F.col("_trade").isNull() | F.col("_st").isNull()).alias("_bad_flag"), F.bool_or(F.coalesce(F.col("amount") < 0, F.lit(False))).alias("_negative"),
        F.max("amount").alias("amount"), F.bool_or("_trade").alias("_trade"), F.bool_or("_st").alias("_st"),
    )
    both = per_key.join(state, ["symbol", "trade_date"], "full_outer")
    mismatch = F.col("_n").isNotNull() & F.col("is_st").isNotNull() & (
        (F.col("_trade") != F.col("trade_status")) | (F.col("_st") != F.col("is_st"))
    )
    return per_key, both.withColumn("_mismatch", mismatch)


def status_overlap(raw: DataFrame, states: DataFrame) -> DataFrame:
    """(symbol, mismatches) of the symbols whose sent flags differ from the independent ones on days that both have."""
    return _overlap(raw, states)[1].where("_mismatch").groupBy("symbol").agg(F.count(F.lit(1)).alias("mismatches"))


def recover_amounts(raw: DataFrame, states: DataFrame) -> Recovery:
    """E8 + J13 + A25: recovered rows of symbols that pass every check, all symbols at once.

    ``raw`` has text columns symbol, date, code, amount, tradestatus, isST.  One breach rejects the
    whole symbol; unresolved days are rankable state days without a recovered amount.
    """
    per_key, both = _overlap(raw, states)
    can_rank = rankable(F.col("is_st"), F.col("trade_status"), F.col("close"))
    open_day = can_rank & F.col("amount").isNull()
    summary = both.groupBy("symbol").agg(
        F.count("_n").alias("returned_dates"), F.count_if(F.col("amount").isNotNull()).alias("recovered_rows"),
        F.count_if(F.col("is_st").isNotNull()).alias("state_dates"), F.count_if(can_rank).alias("rankable_dates"), F.count_if(open_day).alias("unresolved_dates"),
        F.bool_or((F.col("_n") > 1) | (F.col("_n").isNotNull() & F.col("trade_date").isNull())).alias("_dates"), F.bool_or("_bad_code").alias("_code"),
        F.bool_or("_bad_flag").alias("_flag"), F.bool_or("_negative").alias("_neg"), F.count_if("_mismatch").alias("mismatches"),
    ).where(F.col("returned_dates") > 0)
    reason = _first_reason([
        (F.col("state_dates") == 0, "missing_independent_state"), (F.col("_dates"), "invalid_or_duplicate_dates"), (F.col("_code"), "symbol_mismatch"),
        (F.col("_flag"), "invalid_flags"), (F.col("_neg"), "negative_amount"), (F.col("mismatches") > 0, "status_mismatch"),
    ])
    judged = summary.withColumn("rule", reason)
    status = F.when(F.col("rule").isNotNull(), "error").when(F.col("unresolved_dates") == 0, "complete").otherwise("incomplete")
    bad = judged.where(F.col("rule").isNotNull())
    recovered = per_key.where(F.col("amount").isNotNull()).select("symbol", "trade_date", "amount").join(bad.select("symbol"), "symbol", "left_anti")
    unresolved = top_k(both.where(open_day).select("symbol", "trade_date"), 10, [F.col("trade_date").asc()], ["symbol"]).groupBy("symbol").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("trade_date").cast("string"))), ",").alias("unresolved_examples")
    )
    detail = judged.withColumn("status", status).join(unresolved, "symbol", "left").select(
        "symbol", "status", F.when(F.col("rule").isNull(), F.col("returned_dates")).alias("returned_dates"),
        F.when(F.col("rule").isNull(), F.col("recovered_rows")).otherwise(0).alias("recovered_rows"), "state_dates", "rankable_dates",
        F.when(F.col("rule").isNull(), F.col("unresolved_dates")).otherwise(F.col("rankable_dates")).alias("unresolved_dates"),
        F.when(F.col("rule").isNull(), F.coalesce("unresolved_examples", F.lit(""))).otherwise("").alias("unresolved_examples"),
    )
    return Recovery(recovered, detail, bad.select("rule", F.col("symbol").alias("key"), F.col("returned_dates").alias("rows")))


def _first_reason(cases: list[tuple[Column, str]]) -> Column:
    expr = F.when(F.lit(False), F.lit(""))
    for cond, name in cases:
        expr = expr.when(F.coalesce(cond, F.lit(False)), name)
    return expr


def recovery_summary(detail: DataFrame) -> DataFrame:
    """A25 total row."""
    return detail.agg(
        F.count(F.lit(1)).alias("target_symbols"), F.count_if(F.col("status") != "error").alias("recovered_symbols"), F.sum("recovered_rows").alias("recovered_rows"),
        F.sum("unresolved_dates").alias("unresolved_symbol_days"), F.count_if(F.col("status") == "error").alias("error_symbols"),
    ).withColumn("status", F.when((F.col("unresolved_symbol_days") == 0) & (F.col("error_symbols") == 0), "complete").otherwise("incomplete"))


def amounts_with_recovery(archive: DataFrame, recovered: DataFrame) -> DataFrame:
    """The archive plus recovered rows for keys it lacks; archived rows are never replaced."""
    extra = recovered.join(archive.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")
    return union_all([archive.select("symbol", "trade_date", "amount"), extra])

