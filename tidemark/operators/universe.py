"""Universe screens, membership and layered source selection (F*, K*, J2, J5, J21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import contains_st, infer_board, infer_exchange, pad_symbol
from tidemark.operators.checks import DataQualityError, failed_rules
from tidemark.operators.factors import MIN_BARS
from tidemark.schema import REQUIRED_EXCHANGES

MAIN_EXCHANGES = ("SSE", "SZSE")

def liquid_order() -> list[Column]:
    return [F.col("amount").desc_nulls_last(), F.col("float_market_cap").desc_nulls_last(), F.col("symbol").asc()]


def top_k(df: DataFrame, k: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """K1-K3: first k rows, overall or per key.

    Overall: a top-k per task and one merge of k rows.  Per key: the rank filter is pushed into
    a per-task group limit, so at most k rows per key and task are shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not keys:
        return df.orderBy(*order).limit(k)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def check_exchanges(allowed: tuple[str, ...] | list[str]) -> list[str]:
    names = sorted({a.upper() for a in allowed})
    if not names or set(names) - set(REQUIRED_EXCHANGES):
        raise ValueError(f"unsupported exchanges: {names}")
    return names


def market_eligibility(
    bars: DataFrame, *, min_history: int = MIN_BARS, min_average_amount: float = 20_000_000.0
) -> DataFrame:
    """one row per symbol with a reason code and the mean of its last 20 amounts."""
    ok = {
        "close": F.col("close").isNotNull(),
        "prices": (F.coalesce("open", F.lit(1.0)) > 0) & (F.coalesce("high", F.lit(1.0)) > 0)
        & (F.coalesce("low", F.lit(1.0)) > 0) & (F.coalesce("close", F.lit(1.0)) > 0),
    }
    # Copies of one (symbol, day) collapse before any ordering by day.
    per_day = (
        bars.withColumn("_bad", F.size(failed_rules(ok)) > 0)
        .groupBy("symbol", "trade_date")
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_bad").alias("_bad"), F.max("amount").alias("amount"))
    )
    newest = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    summary = (
        per_day.withColumn("_rn", F.row_number().over(newest)).groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("bars"), F.bool_or(F.col("_bad") | (F.col("_n") > 1)).alias("_invalid"),
            F.avg(F.when(F.col("_rn") <= 20, F.col("amount"))).alias("_avg"),
        )
    )
    short = F.col("bars") < min_history
    reason = (
        F.when(F.col("_invalid"), "invalid_bars")
        .when(short, F.concat(F.lit("insufficient_history:"), F.col("bars").cast("string"), F.lit(f"<{min_history}")))
        .when(F.col("_avg").isNull(), "invalid_average_amount_20")
        .when(F.col("_avg") < min_average_amount, "below_min_average_amount_20")
        .otherwise("eligible")
    )
    shown = F.when(~F.col("_invalid") & ~short, F.col("_avg"))
    return summary.select("symbol", "bars", reason.alias("reason"), shown.alias("average_amount_20"))


def screen_master(
    master: DataFrame, as_of: Column | str, *, exchanges=MAIN_EXCHANGES, min_listing_days: int = 120
) -> DataFrame:
    """Listed, not ST, old enough, on an allowed exchange."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    cond = F.col("is_listed") & ~F.col("is_st") & (F.col("list_date") <= F.date_sub(day, min_listing_days))
    if exchanges is not None:
        cond = cond & F.col("exchange").isin(*check_exchanges(exchanges))
    return master.where(cond)


def select_liquid(
    master: DataFrame, spot: DataFrame, as_of: str, *, limit: int = 30, min_amount: float = 50_000_000.0,
    min_listing_days: int = 120, exchanges=MAIN_EXCHANGES, screen_source: str = "spot_amount",
) -> DataFrame:
    """F2 + J2: screened master joined to the snapshot, top by amount."""
    eligible = screen_master(master, as_of, exchanges=exchanges, min_listing_days=min_listing_days)
    market = spot.where((F.col("amount") >= min_amount) & (F.col("last") > 0)).drop("name")
    return top_k(eligible.join(market, "symbol"), limit, liquid_order()).withColumn(
        "screen_source", F.lit(screen_source)
    )


def select_liquid_spot_only(
    spot: DataFrame, *, limit: int = 30, min_amount: float = 50_000_000.0, exchanges=MAIN_EXCHANGES,
    screen_source: str = "bootstrap_spot_amount",
) -> DataFrame:
    """the same screen from codes and names alone; listing age stays unverified."""
    coded = spot.withColumn("symbol", pad_symbol(F.col("symbol"))).withColumn("exchange", infer_exchange(F.col("symbol")))
    kept = coded.where(
        F.col("exchange").isin(*check_exchanges(exchanges)) & ~contains_st(F.col("name")) & (F.col("amount") >= min_amount)
    )
    return top_k(kept, limit, liquid_order()).select(
        "symbol", "name", "exchange", infer_board(F.col("symbol"), F.col("exchange")).alias("board"),
        F.lit(False).alias("is_st"), F.lit(screen_source).alias("screen_source"),
        F.lit(False).alias("listing_age_verified"), "amount", "float_market_cap",
    )


def select_liquid_from_history(
    master: DataFrame, bars: DataFrame, as_of: str, *, limit: int = 30, min_amount: float = 50_000_000.0,
    exchanges=MAIN_EXCHANGES, min_listing_days: int = 120, prefilter: int = 60, min_rows: int = 10,
    lookback_days: int | None = 65,
) -> DataFrame:
    """largest names first, then ranked by the mean of their last 20 amounts."""
    sized = (
        screen_master(master, as_of, exchanges=exchanges, min_listing_days=min_listing_days)
        .withColumn("size_proxy", F.coalesce("float_shares", "total_shares")).where(F.col("size_proxy") > 0)
    )
    largest = top_k(sized, prefilter, [F.col("size_proxy").desc(), F.col("symbol").asc()])
    recent = bars.where(F.col("amount").isNotNull() & (F.col("trade_date") <= F.lit(as_of).cast("date")))
    if lookback_days is not None:
        recent = recent.where(F.col("trade_date") >= F.date_sub(F.lit(as_of).cast("date"), lookback_days))
    newest = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    measured = (
        recent.select("symbol", "trade_date", "amount").join(largest.select("symbol"), "symbol", "left_semi")
        .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 20)
        .groupBy("symbol").agg(F.avg("amount").alias("amount"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") >= min_rows) & (F.col("amount") >= min_amount)).drop("_n")
    )
    picked = top_k(largest.join(measured, "symbol"), limit, [F.col("amount").desc(), F.col("symbol").asc()])
    return picked.select(
        "symbol", "name", "exchange", "board", "is_st", F.lit("history_liquidity_fallback").alias("screen_source"),
        F.lit(True).alias("listing_age_verified"), "amount", F.lit(None).cast("double").alias("float_market_cap"),
    )


def revalidate_candidates(
    candidates: DataFrame, master: DataFrame, as_of: str, *, limit: int = 30, min_amount: float = 50_000_000.0,
    min_listing_days: int = 120, exchanges=MAIN_EXCHANGES,
) -> DataFrame:
    """an older list screened again by the current master; ``universe_gate`` tells if it is full."""
    eligible = screen_master(master, as_of, exchanges=exchanges, min_listing_days=min_listing_days)
    cached = candidates.where(F.col("amount") >= min_amount).select("symbol", "amount", "float_market_cap")
    return top_k(eligible.join(cached, "symbol"), limit, liquid_order()).withColumns(
        {"screen_source": F.lit("candidate_cache_fallback"), "listing_age_verified": F.lit(True)}
    )


def min_universe_gate(df: DataFrame, needed: int, label: str = "universe") -> DataFrame:
    """one row: usable symbols against the minimum."""
    return df.agg(F.count_distinct("symbol").alias("usable")).select(
        F.lit(label).alias("gate"), "usable", F.lit(needed).cast("long").alias("needed"),
        (F.col("usable") >= needed).alias("passed"),
    )


def spot_coverage(
    master: DataFrame, spot: DataFrame, *, exchanges=MAIN_EXCHANGES, minimum: float = 0.80
) -> DataFrame:
    """share of listed symbols that a snapshot covers, against a gate."""
    listed = master.where(F.col("is_listed") & F.col("exchange").isin(*check_exchanges(exchanges))).select("symbol")
    seen = spot.select("symbol").distinct().withColumn("_hit", F.lit(1))
    return (
        listed.join(seen, "symbol", "left")
        .agg(F.count(F.lit(1)).alias("listed"), F.count("_hit").alias("covered"))
        .withColumn("coverage", F.try_divide(F.col("covered"), F.col("listed")))
        .withColumn("passed", F.coalesce(F.col("coverage") >= minimum, F.lit(False)))
    )


def layered_universe(layers: list[tuple[str, DataFrame]], needed: int, extra_gates: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows of the first layer that fills ``needed`` names and passes its own gate.

    Layers are unioned with a layer number; the passing layer is found by one aggregate of at
    most one row per layer and matched back by an equi join on that number.
    """
    if not layers:
        raise DataQualityError("no universe layers given")
    shared = [c for c in layers[0][1].columns if all(c in df.columns for _, df in layers)]
    tagged, gates = None, None
    for number, (name, df) in enumerate(layers, start=1):
        rows = df.select(*shared).withColumns({"layer": F.lit(number), "layer_name": F.lit(name)})
        gate = rows.groupBy("layer").agg(F.count_distinct("symbol").alias("_n"))
        if extra_gates and name in extra_gates:
            flag = extra_gates[name].agg(F.bool_and("passed").alias("_ok"))
            gate = gate.join(F.broadcast(flag)).where(F.col("_ok")).drop("_ok")
        tagged = rows if tagged is None else tagged.unionByName(rows)
        gates = gate if gates is None else gates.unionByName(gate)
    first = gates.where(F.col("_n") >= needed).agg(F.min("layer").alias("layer"))
    return tagged.join(F.broadcast(first), "layer")


def is_member(day: Column, *, min_listing_days: int = 0) -> Column:
    """F8/F9 predicate: list_date + n <= day < delist_date, open when NULL."""
    listed = F.col("list_date") <= F.date_sub(day, min_listing_days)
    return listed & (F.col("delist_date").isNull() | (F.col("delist_date") > day))


def membership_as_of(lifecycle: DataFrame, as_of: str, *, min_listing_days: int = 0, exchanges=None) -> DataFrame:
    """F8, and F9 when an age or an exchange set is given."""
    cond = is_member(F.lit(as_of).cast("date"), min_listing_days=min_listing_days)
    if exchanges is not None:
        cond = cond & F.upper("exchange").isin(*check_exchanges(exchanges))
    return lifecycle.where(cond)


def membership_changes(lifecycle: DataFrame, *, min_listing_days: int = 0) -> DataFrame:
    """+1 on the first member day and -1 on the first day out, summed per exchange and day."""
    start = F.date_add("list_date", min_listing_days)
    real = lifecycle.where(F.col("list_date").isNotNull() & (F.col("delist_date").isNull() | (F.col("delist_date") > start)))
    both = F.array(
        F.struct(start.alias("day"), F.lit(1).alias("delta")),
        F.struct(F.col("delist_date").alias("day"), F.lit(-1).alias("delta")),
    )
    return (
        real.select(F.upper("exchange").alias("exchange"), F.inline(both)).where(F.col("day").isNotNull())
        .groupBy("exchange", "day").agg(F.sum("delta").alias("delta"))
    )


def membership_calendar(lifecycle: DataFrame, calendar: DataFrame, *, min_listing_days: int = 0, exchanges=MAIN_EXCHANGES) -> DataFrame:
    """Listed counts per trading day from interval ends; linear, no date-by-interval join.

    The running sums see one row per exchange and changed day, however many securities there are.
    """
    changes = membership_changes(lifecycle, min_listing_days=min_listing_days)
    names = check_exchanges(exchanges)
    daily = changes.where(F.col("exchange").isin(*names)).groupBy("day").pivot("exchange", names).agg(F.sum("delta"))
    asked = calendar.select(F.col("trade_date").alias("day")).distinct().withColumn("_ask", F.lit(True))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    merged = daily.join(asked, "day", "full_outer")
    counted = merged.select("day", "_ask", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n.lower()}_listed") for n in names])
    total = sum((F.col(f"{n.lower()}_listed") for n in names), F.lit(0))
    return counted.where("_ask").select(
        F.col("day").alias("trade_date"), total.alias("listed_total"), *[f"{n.lower()}_listed" for n in names]
    )


def membership_crosscheck(counts: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """An independent count per day against the reconstructed one."""
    return counts.join(reconstructed, "trade_date").select(
        "trade_date", "observed_count", "listed_total",
        (F.col("observed_count") - F.col("listed_total")).alias("count_difference"),
        F.try_divide(F.col("observed_count") - F.col("listed_total"), F.col("listed_total")).alias("relative_difference"),
    )


def drop_stale(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of symbols that reach the market's last date, failures of the others)."""
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("latest"))
    market = last.agg(F.max("latest").alias("market_as_of"))
    flagged = last.join(F.broadcast(market))
    stale = flagged.where(F.col("latest") < F.col("market_as_of")).select(
        "symbol",
        F.concat(F.lit("stale_latest_bar:"), F.col("latest").cast("string"), F.lit(" != "), F.col("market_as_of").cast("string")).alias("error"),
    )
    return bars.join(stale.select("symbol"), "symbol", "left_anti"), stale


def window_trim(df: DataFrame, start: str, end: str, column: str = "trade_date") -> DataFrame:
    """a plain range filter, so it reaches the Parquet scan."""
    return df.where((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) <= F.lit(end).cast("date")))


def period_overlap(lifecycle: DataFrame, start: str, end: str) -> DataFrame:
    """F13 + F14: rows alive in a period with the period clipped to the listing life."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    alive = lifecycle.where((F.col("list_date") <= e) & (F.col("delist_date").isNull() | (F.col("delist_date") >= s)))
    return alive.withColumns(
        {"effective_start": F.greatest(s, F.col("list_date")), "effective_end": F.least(e, F.col("delist_date"))}
    ).withColumn("empty_period", F.col("effective_end") < F.col("effective_start"))


def rankable(is_st: Column, trade_status: Column, close: Column) -> Column:
    """F17."""
    return F.coalesce(~is_st & trade_status & (close > 0), F.lit(False))
