"""As-of matches between events, states, signals and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import limit_blocked, price_limit_pct
from tidemark.operators.factors import by_symbol


def last_before(
    asks: DataFrame, facts: DataFrame, on: list[str], ask_time: str, fact_time: str, payload: list[str],
    *, inclusive: bool, out: str,
) -> DataFrame:
    """For each (on, ask_time) the payload of the last fact before it, as struct ``out``.

    Union plus one ordered pass: never all pairs.  Asks are reduced to distinct keys first and
    joined back by equality, so repeated asks of a hot key do not gather in one window.  The
    pass holds one key's distinct times; facts must be unique per (on, fact_time).
    """
    order = F.lit(1 if inclusive else -1)
    row = F.struct(F.col(fact_time).alias(fact_time), *payload)
    wanted = facts.join(asks.select(*on).distinct(), on, "left_semi")
    left = wanted.select(*on, F.col(fact_time).alias("_t"), F.lit(0).alias("_k"), row.alias(out))
    kind = left.schema[out].dataType
    right = asks.select(*on, F.col(ask_time).alias("_t")).distinct().select(
        *on, "_t", order.alias("_k"), F.lit(None).cast(kind).alias(out)
    )
    w = Window.partitionBy(*on).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        left.unionByName(right).withColumn(out, F.last(out, ignorenulls=True).over(w))
        .where(F.col("_k") == order).select(*on, F.col("_t").alias(ask_time), out)
    )
    return asks.join(found, [*on, ask_time], "left")


def state_around(
    events: DataFrame, states: DataFrame, event_day: str, *, max_age_days: int | None = None
) -> DataFrame:
    """J6 + J7: the last state strictly before the event day and the state on that day.

    Adds prior_date, prior_is_st, prior_age_days, day_is_st, day_trade_status.  States older than
    ``max_age_days`` are kept (a verdict needs their age) unless a bound is asked for.
    """
    mine = states.select("symbol", "trade_date", "is_st", "trade_status")
    prior = last_before(events, mine, ["symbol"], event_day, "trade_date", ["is_st"], inclusive=False, out="_prior")
    exact = mine.join(events.select("symbol").distinct(), "symbol", "left_semi").select(
        "symbol", F.col("trade_date").alias(event_day), F.col("is_st").alias("day_is_st"),
        F.col("trade_status").alias("day_trade_status"),
    )
    out = prior.join(exact, ["symbol", event_day], "left").withColumns({
        "prior_date": F.col("_prior.trade_date"), "prior_is_st": F.col("_prior.is_st"),
        "prior_age_days": F.datediff(F.col(event_day), F.col("_prior.trade_date")),
    }).drop("_prior")
    if max_age_days is None:
        return out
    fresh = F.col("prior_age_days") <= max_age_days
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in ("prior_date", "prior_is_st", "prior_age_days")})


def next_tradable_bar(
    signals: DataFrame, bars: DataFrame, *, max_wait_days: int | None = None, keys: list[str] | None = None
) -> DataFrame:
    """The first bar after each signal that trades and is not limit-blocked for its side.

    ``signals`` has symbol, trade_date, side, board, is_st (+ keys such as portfolio_id).  Whether
    a bar takes an order depends only on (symbol, board, is_st, side), so bars are tested once per
    such combination and the next accepting bar is read in one backward pass.  A signal is
    superseded by a later one of the same key and symbol: it may still fill on that later date's
    open, not after it.
    """
    keys = keys or []
    kind = ["symbol", "board", "is_st", "side"]
    combos = signals.select(*kind).distinct()
    w = by_symbol()
    traded = bars.join(signals.select("symbol").distinct(), "symbol", "left_semi")
    seen = traded.select("symbol", "trade_date", "open", "close", "volume").withColumn(
        "previous_close", F.lag("close").over(w)
    )
    tested = seen.join(combos, "symbol").withColumn(
        "_pct", price_limit_pct(F.col("board"), F.col("is_st"), F.col("trade_date"))
    )
    takes = (
        (F.col("volume") > 0) & F.col("previous_close").isNotNull()
        & ~limit_blocked(F.col("side"), F.col("open"), F.col("previous_close"), F.col("_pct"))
    )
    bar = F.struct(
        F.col("trade_date").alias("fill_date"), F.col("open").alias("raw_open"), F.col("previous_close").alias("previous_close")
    )
    offers = tested.where(takes).select(*kind, F.col("trade_date").alias("_t"), F.lit(1).alias("_k"), bar.alias("_fill"))
    asks = signals.select(*kind, F.col("trade_date").alias("_t")).distinct().select(
        *kind, "_t", F.lit(0).alias("_k"), F.lit(None).cast(offers.schema["_fill"].dataType).alias("_fill")
    )
    # Backward in time; on one date the ask is read before that date's own bar.
    back = Window.partitionBy(*kind).orderBy(F.col("_t").desc(), F.col("_k").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        offers.unionByName(asks).withColumn("_fill", F.last("_fill", ignorenulls=True).over(back))
        .where(F.col("_k") == 0).select(*kind, F.col("_t").alias("trade_date"), "_fill.*")
    )
    dated = signals.select(*keys, "symbol", "trade_date").distinct().withColumn(
        "superseded_on", F.lead("trade_date").over(Window.partitionBy(*keys, "symbol").orderBy("trade_date"))
    )
    out = signals.join(dated, [*keys, "symbol", "trade_date"]).join(found, [*kind, "trade_date"], "left")
    keep = F.col("superseded_on").isNull() | (F.col("fill_date") <= F.col("superseded_on"))
    if max_wait_days is not None:
        keep = keep & (F.datediff("fill_date", "trade_date") <= max_wait_days)
    fill = ("fill_date", "raw_open", "previous_close")
    return out.withColumns({c: F.when(keep, F.col(c)) for c in fill}).drop("superseded_on")


def mark_to_market(
    positions: DataFrame, bars: DataFrame, *, field: str = "close", keys: list[str] | None = None
) -> DataFrame:
    """Value of (keys, trade_date, symbol, shares) by that day's price, else the last close."""
    keys = keys or ["portfolio_id"]
    price = F.coalesce(F.when(F.col("_bar.trade_date") == F.col("trade_date"), F.col("_bar._field")), F.col("_bar.close"))
    quotes = bars.select("symbol", F.col("trade_date"), F.col(field).alias("_field"), "close")
    held = last_before(
        positions.where(F.col("shares") > 0), quotes, ["symbol"], "trade_date", "trade_date", ["_field", "close"],
        inclusive=True, out="_bar",
    )
    return held.groupBy(*keys, "trade_date").agg(F.coalesce(F.sum(F.col("shares") * price), F.lit(0.0)).alias("market_value"))


def panel_as_of(panel: DataFrame, dates: DataFrame, payload: list[str]) -> DataFrame:
    """Last panel row of every symbol on or before each date, without a dates-by-symbols join.

    Each panel row owns the dates up to the symbol's next row; those are generated from the position of dates in
    the sorted date list.  That list, and the days it covers, are bounded by the calendar and go to every task, so
    panel rows are only dealt by symbol; bars before the first date are read as of that date.
    """
    numbered = dates.select(F.col("trade_date").alias("as_of")).distinct().withColumn("_no", F.row_number().over(Window.orderBy("as_of")))
    ends = numbered.agg(F.min("as_of").alias("_least"), F.max("as_of").alias("_most"), F.count(F.lit(1)).cast("int").alias("_total"))
    # a day belongs to the first asked date at or after it
    start = F.coalesce(F.date_add(F.lag("as_of").over(Window.orderBy("as_of")), 1), F.col("as_of"))
    first_no = numbered.withColumn("_start", start).select(F.explode(F.sequence("_start", "as_of")).alias("_day"), F.col("_no").alias("_first"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    placed = (
        panel.select("symbol", "trade_date", *payload).join(F.broadcast(ends)).where(F.col("trade_date") <= F.col("_most"))
        .withColumn("_day", F.greatest("trade_date", "_least")).join(F.broadcast(first_no), "_day")
        .withColumn("_until", F.coalesce(F.lead("_first").over(w) - 1, F.col("_total")))
    )
    return (
        placed.where(F.col("_first") <= F.col("_until")).withColumn("_no", F.explode(F.sequence("_first", "_until"))).join(F.broadcast(numbered), "_no")
        .select("as_of", "symbol", F.col("trade_date").alias("bar_date"), *payload)
    )
