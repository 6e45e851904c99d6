"""Archive coverage, shard merging, sampling and inventories (A10-A20, A22, A25, IO14, IO15, W14, W16, U2, U5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import hash_shard
from tidemark.operators.checks import Checked
from tidemark.operators.normalize import union_all
from tidemark.operators.universe import period_overlap

MIN_SUCCESS = 0.95


def shard_lifecycle(lifecycle: DataFrame, shard_count: int, start: str, end: str) -> DataFrame:
    """TX1 + F13: members of a period with their shard number (all shards at once)."""
    return period_overlap(lifecycle, start, end).withColumn("shard", hash_shard(F.col("symbol"), shard_count))


def amount_coverage(members: DataFrame, amounts: DataFrame) -> DataFrame:
    """A10: rows, amount share, first and last bar per member; success is full coverage."""
    seen = amounts.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(F.col("amount").isNotNull().cast("double")).alias("amount_coverage"),
        F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"),
    )
    if "provider" in amounts.columns:
        seen = seen.join(amounts.groupBy("symbol").agg(F.max("provider").alias("provider")), "symbol")
    keep = [c for c in ("shard", "cohort", "exchange") if c in members.columns]
    return members.select("symbol", *keep).join(seen, "symbol", "left").withColumns({
        "row_count": F.coalesce("row_count", F.lit(0)), "amount_coverage": F.coalesce("amount_coverage", F.lit(0.0)),
    }).withColumn("success", (F.col("row_count") > 0) & (F.col("amount_coverage") == 1.0))


def archive_summary(coverage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Success per shard (or overall) against the 0.95 gate, with failed symbols counted."""
    keys = keys or ["shard"]
    return coverage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("symbol_count"), F.count_if("success").alias("success_count"), F.sum("row_count").alias("amount_row_count"),
        F.count_if(~F.col("success")).alias("failed_count"),
    ).withColumn("success_rate", F.col("success_count") / F.col("symbol_count")).withColumn("passed", F.col("success_rate") >= MIN_SUCCESS)


def provider_counts(coverage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Successful symbols per provider (``unknown`` where none is named) and shard."""
    keys = ["shard"] if keys is None else keys
    return coverage.where("success").groupBy(*keys, F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count(F.lit(1)).alias("symbols"))


def failed_symbols(coverage: DataFrame) -> DataFrame:
    """The failed names as rows, so that their number is not limited by one cell."""
    return coverage.where(~F.col("success")).select("symbol")


def state_coverage(members: DataFrame, states: DataFrame) -> DataFrame:
    """Rows, span, ST and suspended days per member."""
    seen = states.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("trade_date").alias("first_state_date"), F.max("trade_date").alias("last_state_date"),
        F.count_if("is_st").alias("st_day_count"), F.count_if(~F.col("trade_status")).alias("suspended_day_count"),
    )
    out = members.select("symbol").join(seen, "symbol", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("row_count", "st_day_count", "suspended_day_count")}).withColumn(
        "success", F.col("row_count") > 0
    )


def state_transitions(states: DataFrame) -> DataFrame:
    """ST flag flips per symbol (states are unique per symbol and day)."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    flips = states.withColumn("_flip", F.lag("is_st").over(w) != F.col("is_st"))
    return flips.groupBy("symbol").agg(F.count_if("_flip").alias("st_transition_count"))


def stable_sample(df: DataFrame, n: int, key: Column, cohort: str = "cohort") -> DataFrame:
    """The n rows of each cohort with the smallest sha256 of the key."""
    w = Window.partitionBy(cohort).orderBy(F.sha2(key, 256), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def lifecycle_cohorts(lifecycle: DataFrame, start: str, end: str) -> DataFrame:
    """W14 cohorts: exchange x current / delisted inside the period."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    current = F.col("currently_listed") & (F.col("list_date") <= e)
    gone = ~F.col("currently_listed") & (F.col("delist_date") >= s) & (F.col("list_date") <= e)
    kind = F.when(current, "_current").when(gone, "_delisted_in_period")
    return lifecycle.withColumn("cohort", F.concat(F.lower("exchange"), kind)).where(F.col("cohort").isNotNull())


def announcement_cohorts(announcements: DataFrame) -> DataFrame:
    """W14 cohorts: exchange x apply / remove, documents with a link only."""
    exchange = F.when(F.col("symbol").startswith("6"), "SSE").otherwise("SZSE")
    direction = F.when(F.col("event_candidate") == "risk_warning_apply_candidate", "_apply").when(
        F.col("event_candidate") == "risk_warning_remove_candidate", "_remove"
    )
    return announcements.withColumn("cohort", F.concat(exchange, direction)).where(
        F.col("cohort").isNotNull() & F.col("pdf_url").startswith("http")
    )


def announcement_key() -> Column:
    whole = F.concat_ws("|", "symbol", F.col("announcement_time").cast("string"), "announcement_title")
    return F.when(F.coalesce("announcement_id", F.lit("")) != "", F.col("announcement_id")).otherwise(whole)


def cohort_rates(coverage: DataFrame) -> DataFrame:
    """Success and mean amount coverage per cohort."""
    return coverage.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if("success").alias("success_count"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("amount_coverage"))), F.lit(0.0)).alias("mean_amount_coverage"),
    )


def scale_recommendation(coverage: DataFrame) -> DataFrame:
    """One row: archive at scale when delisted >= 0.80 and current >= 0.90 succeed."""
    rate = lambda word: F.coalesce(F.avg(F.when(F.contains(F.col("cohort"), F.lit(word)), F.col("success").cast("double"))), F.lit(0.0))
    return coverage.agg(rate("current").alias("current_success_rate"), rate("delisted").alias("delisted_success_rate")).withColumn(
        "recommendation",
        F.when((F.col("delisted_success_rate") >= 0.80) & (F.col("current_success_rate") >= 0.90), "proceed_to_sharded_archive").otherwise("do_not_scale_yet"),
    )


def parser_rates(extracted: DataFrame) -> DataFrame:
    """Verified share per announcement cohort."""
    hit = F.col("parse_status") == "verified"
    return extracted.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(hit).alias("verified_count"), F.avg(hit.cast("double")).alias("verified_rate")
    )


def state_probe_summary(detail: DataFrame, membership: DataFrame) -> DataFrame:
    """Coverage means over successes, the largest membership gap and a recommendation."""
    ok = F.col("success")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    gap = membership.agg(F.max(F.abs("relative_difference")).alias("max_membership_gap"), F.count(F.lit(1)).alias("membership_dates"))
    return detail.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(ok).alias("success_count"), F.avg(ok.cast("double")).alias("success_rate"),
        mean("is_st_coverage").alias("mean_is_st_coverage"), mean("amount_coverage").alias("mean_amount_coverage"),
        mean("trade_status_coverage").alias("mean_trade_status_coverage"),
    ).join(F.broadcast(gap)).withColumn(
        "recommendation",
        F.when((F.col("success_rate") >= 0.95) & (F.col("mean_is_st_coverage") >= 0.99) & (F.col("max_membership_gap") <= 0.05),
               "promising_independent_state_source").otherwise("needs_more_validation"),
    )


def probe_detail(sample: DataFrame, history: DataFrame) -> DataFrame:
    """Per sampled symbol: rows and the filled share of amount, ST flag and trading flag."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    seen = history.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"), share("amount").alias("amount_coverage"), share("is_st").alias("is_st_coverage"),
        share("trade_status").alias("trade_status_coverage"),
    )
    out = sample.select("symbol", "cohort").join(seen, "symbol", "left").withColumn("success", F.col("row_count").isNotNull())
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("amount_coverage", "is_st_coverage", "trade_status_coverage")}).withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))
    )


def fundamental_summary(snapshot: DataFrame, failures: DataFrame) -> DataFrame:
    """A15."""
    good = snapshot.agg(F.count(F.lit(1)).alias("success_count"), F.avg("fundamental_coverage").alias("average_coverage"))
    bad = failures.agg(F.count(F.lit(1)).alias("failure_count"))
    return good.join(F.broadcast(bad)).withColumn("requested_count", F.col("success_count") + F.col("failure_count"))


def source_counts(requested: DataFrame, facts: DataFrame) -> DataFrame:
    """Requested symbols per source of their newest fact; ``none`` counts those without facts."""
    newest = facts.groupBy("symbol").agg(F.max(F.struct("available_at", "source")).alias("_r")).select("symbol", F.col("_r.source").alias("source"))
    return requested.select("symbol").distinct().join(newest, "symbol", "left").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("symbols"))


def selection_summary(ranking: DataFrame, exclusions: DataFrame, failures: DataFrame, top_n: int) -> DataFrame:
    """Counts of ranked, selected, excluded and failed names."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        ranking.agg(F.count("rank").alias("ranked_count")).withColumn("selected_count", F.least("ranked_count", F.lit(top_n)))
        .join(F.broadcast(one(exclusions, "excluded_count"))).join(F.broadcast(one(failures, "fetch_failure_count")))
    )


def lifecycle_inventory(lifecycle: DataFrame) -> DataFrame:
    """Counts by exchange and status with date coverage."""
    return lifecycle.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("symbol_count"), F.count_if("currently_listed").alias("current_count"), F.count_if(~F.col("currently_listed")).alias("delisted_count"),
        F.avg(F.col("list_date").isNotNull().cast("double")).alias("list_date_coverage"),
        F.coalesce(F.avg(F.when(~F.col("currently_listed"), F.col("delist_date").isNotNull().cast("double"))), F.lit(1.0)).alias("delist_date_coverage"),
    )


def transition_counts(changes: DataFrame) -> DataFrame:
    """Name changes, ST transitions among them and their symbols per source."""
    return changes.groupBy("source").agg(
        F.count(F.lit(1)).alias("name_change_rows"), F.count_if("st_transition").alias("st_transition_rows"),
        F.count_distinct(F.when(F.col("st_transition"), F.col("symbol"))).alias("st_transition_symbols"),
    )


def event_counts(announcements: DataFrame) -> DataFrame:
    """Announcements per event class with the exchange guessed from the code."""
    head = F.substring("symbol", 1, 1)
    return announcements.groupBy("event_candidate").agg(
        F.count(F.lit(1)).alias("announcements"), F.count_if(head == "6").alias("sse_guess"), F.count_if(head.isin("0", "3")).alias("szse_guess")
    )


def verdict_counts(detail: DataFrame) -> DataFrame:
    """A19."""
    return detail.groupBy("verdict").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("symbol").alias("symbols"))


def crosscheck_gate(detail: DataFrame) -> DataFrame:
    """Pass when at least 10 events and 90% of them match."""
    return detail.agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if("match").alias("matched_count"), F.coalesce(F.avg(F.col("match").cast("double")), F.lit(0.0)).alias("match_rate"),
        F.count_if(~F.col("status").startswith("error:")).alias("comparable_count"),
    ).withColumn("gate", F.when((F.col("event_count") >= 10) & (F.col("match_rate") >= 0.90), "pass").otherwise("fail"))


def master_counts(master: DataFrame) -> DataFrame:
    """A22."""
    return master.groupBy("exchange").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_st").alias("st_count"), F.count_if("is_listed").alias("listed_count"))


def shard_overlap(rows: DataFrame, shard: str = "shard_index") -> DataFrame:
    """Symbols seen in more than one shard."""
    return rows.groupBy("symbol").agg(F.count_distinct(shard).alias("shards")).where(F.col("shards") > 1)


def merge_shards(
    rows: DataFrame, summaries: DataFrame, expected_shards: int, *, min_success_rate: float = MIN_SUCCESS, value: str = "amount",
) -> Checked:
    """IO14/IO15: all shards' rows, and every gate that fails.

    ``rows`` carries shard_index (from the file path or a column); ``summaries`` has one row per
    shard.  The merge itself moves nothing: it is the union already read; gates are aggregates.
    """
    s = summaries
    flag = lambda rule, df, key, n: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), n.cast("long").alias("rows"))
    per_index = s.groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"))
    shape = s.agg(
        F.count_distinct(F.when(F.col("shard_index").between(0, expected_shards - 1), F.col("shard_index"))).alias("have"),
        F.count_distinct("period_start", "period_end").alias("periods"), F.sum("symbol_count").alias("symbols"), F.sum("success_count").alias("ok"),
    )
    dup_rows = rows.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    gates = [
        flag("duplicate_shard_index", per_index.where(F.col("n") > 1), F.col("shard_index"), F.col("n")),
        flag("unexpected_shard_index", s.where(~F.col("shard_index").between(0, expected_shards - 1)), F.col("shard_index"), F.lit(1)),
        flag("wrong_shard_count", s.where(F.col("shard_count") != expected_shards), F.col("shard_index"), F.col("shard_count")),
        flag("shard_below_success_rate", s.where(F.col("success_rate") < min_success_rate), F.col("shard_index"), F.col("symbol_count")),
        flag("shard_set_incomplete", shape.where(F.col("have") != expected_shards), F.lit("all"), F.col("have")),
        flag("periods_inconsistent", shape.where(F.col("periods") > 1), F.lit("all"), F.col("periods")),
        flag("total_below_success_rate", shape.where(F.coalesce(F.col("ok") / F.nullif(F.col("symbols"), F.lit(0)), F.lit(0.0)) < min_success_rate), F.lit("all"), F.col("ok")),
        flag("symbol_in_two_shards", shard_overlap(rows), F.col("symbol"), F.col("shards")),
        flag("duplicate_symbol_date", dup_rows, F.concat_ws("|", "symbol", F.col("trade_date").cast("string")), F.col("n")),
    ]
    if value in rows.columns:
        nulls = rows.where(F.col(value).isNull()).groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"))
        gates.append(flag(f"null_{value}", nulls, F.col("shard_index"), F.col("n")))
    return Checked(rows.drop("shard_index"), union_all(gates))


def build_lifecycle(current: DataFrame, delisted: DataFrame) -> Checked:
    """Union of current and delisted lists; a symbol on both, or twice on one, is a violation."""
    names = ["symbol", "name", "exchange", "board", "list_date", "delist_date", "currently_listed"]
    both = current.withColumn("delist_date", F.lit(None).cast("date")).select(*names).unionByName(delisted.select(*names)).withColumns({
        "membership_source": F.lit("official_exchange_current_plus_delisted"), "reconstruction_grade": F.lit("official_reconstructed_membership"),
    })
    shape = both.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("currently_listed").alias("_lists")).where(F.col("rows") > 1)
    bad = shape.select(F.when(F.col("_lists") > 1, "current_and_delisted").otherwise("duplicate_symbol").alias("rule"), F.col("symbol").alias("key"), "rows")
    return Checked(both, bad)
