"""Rankings to target weights, fills and costs (P*, W17, U1, U3, K2, K4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import TradingRules, affordable_lot, fill_price, round_lot, trade_cost
from tidemark.functions.symbols import etf_board
from tidemark.operators.asof import next_tradable_bar, panel_as_of
from tidemark.operators.factors import by_symbol, momentum, moving_average
from tidemark.operators.normalize import validate_rankings
from tidemark.sources.scratch import settled

WEIGHT_SLACK = 1e-7
ENTRY_SALTS = 64
SIGNAL_COLUMNS = ["trade_date", "symbol", "target_weight", "board", "is_st", "instrument_type", "source_rank"]


@dataclass(frozen=True)
class PortfolioRules:
    """P5: one parameter set; ``config_table`` turns many into a table."""

    config_id: str = "v2"
    initial_cash: float = 20_000.0
    max_stock_positions: int = 3
    stock_weight_per_position: float = 0.25
    max_total_stock_weight: float = 0.75
    min_cash_weight: float = 0.10
    entry_rank_max: int = 5
    keep_rank_max: int = 10
    rebalance_every: int = 5
    minimum_holding: int = 5
    affordability_buffer: float = 0.002
    entry_needs_momentum: bool = True
    entry_needs_trend: bool = True
    keep_needs_trend: bool = True
    etf_enabled: bool = True
    etf_target_weight: float = 0.15
    etf_max_weight: float = 0.40

    def __post_init__(self):
        if self.initial_cash <= 0 or self.max_stock_positions <= 0 or self.rebalance_every <= 0 or self.minimum_holding < 0:
            raise ValueError("cash, positions and cadence must be positive")
        if not 0 < self.stock_weight_per_position <= self.max_total_stock_weight <= 1:
            raise ValueError("bad stock weights")
        if self.max_stock_positions * self.stock_weight_per_position > self.max_total_stock_weight + 1e-12:
            raise ValueError("the stock slots together exceed the total stock weight")
        if not 0 <= self.min_cash_weight < 1 or not 0 < self.entry_rank_max <= self.keep_rank_max:
            raise ValueError("bad cash weight or rank bounds")
        if not 0 <= self.etf_target_weight <= self.etf_max_weight <= 1 or self.affordability_buffer < 0:
            raise ValueError("bad fund weights or buffer")

    @property
    def ticket(self) -> float:
        return self.initial_cash * self.stock_weight_per_position


def config_table(spark: SparkSession, configs: list[PortfolioRules]) -> DataFrame:
    """One row per parameter set; its size is the length of the list the caller wrote."""
    rows = [{**asdict(c), "ticket": c.ticket} for c in configs]
    names = list(rows[0])
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    schema = ", ".join(f"{n} {kinds[type(rows[0][n])]}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def number_dates(df: DataFrame, date: str, keys: list[str]) -> DataFrame:
    """Distinct dates per key with their position from 0 (bounded by the calendar)."""
    w = Window.partitionBy(*keys).orderBy(date) if keys else Window.orderBy(date)
    return df.select(*keys, date).distinct().withColumn("date_no", F.row_number().over(w) - 1)


def rebalance_calendar(rankings: DataFrame, every: int = 5, date: str = "as_of", keys: list[str] | None = None) -> DataFrame:
    """Every N-th ranking date."""
    return number_dates(rankings, date, keys or []).where(F.col("date_no") % every == 0)


def rebalance_days(rankings: DataFrame, configs: DataFrame) -> DataFrame:
    """W17 per config: (config_id, as_of, date_no). Due positions are generated from the number
    of dates and matched by equality; calendar- and config-sized on both sides."""
    dates = number_dates(rankings, "as_of", [])
    last = dates.agg(F.max("date_no")).scalar()
    due = configs.select("config_id", F.explode(F.sequence(F.lit(0), last, F.col("rebalance_every"))).alias("date_no"))
    return dates.join(due, "date_no").select("config_id", "as_of", "date_no")


def top_n_per_date(rankings: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """K2: n best by (rank, symbol) per date; a group limit trims rows before the shuffle."""
    w = Window.partitionBy(*(keys or []), "as_of").orderBy("rank", "symbol")
    return rankings.where(F.col("rank").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dropped_holdings(selected: DataFrame, all_dates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Names selected on a date and absent on the next one, dated by that next date."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("as_of") if keys else Window.orderBy("as_of")
    following = all_dates.select(*keys, "as_of").distinct().withColumn("_next", F.lead("as_of").over(w))
    shifted = (
        selected.join(following, [*keys, "as_of"]).where(F.col("_next").isNotNull())
        .drop("as_of").withColumnRenamed("_next", "as_of")
    )
    return shifted.join(selected.select(*keys, "as_of", "symbol"), [*keys, "as_of", "symbol"], "left_anti")


def equal_weight_signals(rankings: DataFrame, top_n: int = 20, max_weight: float | None = None) -> DataFrame:
    """Top-n at min(1/n, cap) per date, explicit zeros for names just dropped."""
    if top_n <= 0 or (max_weight is not None and not 0 < max_weight <= 1):
        raise ValueError("top_n must be positive and max_weight in (0, 1]")
    chosen = top_n_per_date(rankings, top_n).select("as_of", "symbol", "board", "is_st")
    share = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("as_of"))
    weight = share if max_weight is None else F.least(share, F.lit(float(max_weight)))
    active = chosen.withColumn("target_weight", weight)
    zeros = dropped_holdings(chosen, rankings).withColumn("target_weight", F.lit(0.0))
    return active.unionByName(zeros).select(
        F.col("as_of").alias("trade_date"), "symbol", "target_weight", "board", "is_st"
    )


def equal_weight_snapshot(selected: DataFrame, observed_at: Column, strategy_version: str) -> tuple[DataFrame, DataFrame]:
    """(one day's equal-weight signal rows, violations when the day is not single)."""
    facts = selected.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("as_of").alias("_dates"))
    optional = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in selected.columns else F.lit(v)
    rows = selected.join(F.broadcast(facts)).select(
        F.col("as_of").alias("signal_date"), "symbol", optional("name", "").alias("name"), "board", "is_st", "rank",
        "composite_score", (1.0 / F.col("_n")).alias("target_weight"), optional("screen_source", "unknown").alias("screen_source"),
        F.lit(strategy_version).alias("strategy_version"), observed_at.cast("timestamp").alias("observed_at"),
    )
    bad = facts.where(F.col("_dates") != 1).select(
        F.lit("not_exactly_one_signal_date").alias("rule"), F.col("_dates").cast("string").alias("key"), F.col("_n").alias("rows")
    )
    return rows, bad


def weight_cap_check(signals: DataFrame, cap: float = 1.0, slack: float = WEIGHT_SLACK, keys: list[str] | None = None) -> DataFrame:
    """Dates whose active weights pass the cap."""
    keys = keys or ["trade_date"]
    return signals.groupBy(*keys).agg(F.sum("target_weight").alias("total_weight")).where(F.col("total_weight") > cap + slack)


def hold_buffer_signals(rankings: DataFrame, configs: DataFrame) -> DataFrame:
    """Low-turnover selection per config: keep inside the buffer, fill free slots in rank order.

    What a date's holdings depend on are the first 2 x max positions names that may enter (at most
    half of them can be held already), and the keep test of names that are held.  Those facts are rows in
    order of date; one pass per config reads them, keeps the current holdings and nothing else, and gives
    a date's signals out as soon as the date ends.  Ties at a rank bound make more rows to pass over, not
    more to hold.  Ranks of the output rows are joined back afterwards.
    """
    base = validate_rankings(rankings).select("as_of", "symbol", "rank", "board", "is_st", "close", "momentum_20", "trend_close_ma20")
    cfg = configs
    rebalance = settled(rebalance_days(rankings, configs))
    wanted = F.col("rank") <= F.greatest("entry_rank_max", "keep_rank_max")
    due = settled(base.join(rebalance, "as_of").join(cfg, "config_id").where(wanted))
    may_enter = (
        (F.col("rank") <= F.col("entry_rank_max"))
        & (~F.col("entry_needs_momentum") | (F.col("momentum_20") > 0))
        & (~F.col("entry_needs_trend") | (F.col("trend_close_ma20") > 0))
        & affordable_lot(F.col("close"), F.col("ticket"), F.col("affordability_buffer"))
    )
    # First cut inside salted parts, so a date on which most names tie is not sorted in one task;
    # the first 2 x max of a date are among the first 2 x max of each part.
    part = Window.partitionBy("config_id", "as_of", "_salt").orderBy("rank", "symbol")
    order = Window.partitionBy("config_id", "as_of").orderBy("rank", "symbol")
    room = 2 * F.col("max_stock_positions")
    entries = (
        due.where(may_enter).withColumn("_salt", F.pmod(F.xxhash64("symbol"), F.lit(ENTRY_SALTS)))
        .withColumn("_pos", F.row_number().over(part)).where(F.col("_pos") <= room)
        .withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") <= room)
        .select("config_id", "as_of", "date_no", "symbol", "_pos", "board", "is_st")
    )
    ever = entries.select("config_id", "symbol").distinct()
    keepers = (
        due.where(F.col("rank") <= F.col("keep_rank_max")).join(ever, ["config_id", "symbol"], "left_semi")
        .select("config_id", "as_of", "date_no", "symbol", (~F.col("keep_needs_trend") | (F.col("trend_close_ma20") > 0)).alias("_ok"))
        .where("_ok")
    )
    limits = cfg.select("config_id", "max_stock_positions", "minimum_holding", "stock_weight_per_position")
    day, nothing = ["config_id", "as_of", "date_no"], F.lit(None)
    facts = (
        rebalance.select(*day, F.lit(_DAY).alias("kind"), F.lit(0).alias("_pos"), F.lit("").alias("symbol"), nothing.cast("string").alias("board"), nothing.cast("boolean").alias("is_st"))
        .unionByName(keepers.select(*day, F.lit(_KEEPER).alias("kind"), F.lit(0).alias("_pos"), "symbol", nothing.cast("string").alias("board"), nothing.cast("boolean").alias("is_st")))
        .unionByName(entries.select(*day, F.lit(_ENTRY).alias("kind"), "_pos", "symbol", "board", "is_st"))
        .join(F.broadcast(limits), "config_id").select(*_FACTS)
    )
    folded = facts.repartition("config_id").sortWithinPartitions("config_id", "date_no", "kind", "_pos", "symbol").mapInArrow(_fold_holdings, _FOLDED).select(
        "config_id", "trade_date", "symbol", "target_weight", "board", "is_st", F.lit("stock").alias("instrument_type"), (F.col("target_weight") > 0).alias("_active"))
    ranks = base.select(F.col("as_of").alias("trade_date"), "symbol", F.col("rank").cast("int").alias("_rank"))
    return folded.join(ranks, ["trade_date", "symbol"], "left").select(
        "config_id", *SIGNAL_COLUMNS[:-1], F.when(F.col("_active"), F.col("_rank")).alias("source_rank")
    )


_DAY, _KEEPER, _ENTRY = 0, 1, 2
_FACTS = ["config_id", "as_of", "date_no", "kind", "symbol", "board", "is_st", "max_stock_positions", "minimum_holding", "stock_weight_per_position"]
_FOLDED = "config_id string, trade_date date, symbol string, target_weight double, board string, is_st boolean"


def _fold_holdings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_FACTS`` in order of config, date and kind; state: the config's holdings, symbol -> (board, is_st, entry date_no).

    Kept names come in symbol order and are cut to the limit; entries then follow in rank order.  A name
    that fails the keep test but enters again on the same date keeps its entry date.
    """
    schema = pa.schema([("config_id", pa.string()), ("trade_date", pa.date32()), ("symbol", pa.string()), ("target_weight", pa.float64()), ("board", pa.string()), ("is_st", pa.bool_())])
    config, held, day, kept, picked = None, {}, None, set(), None

    def start_entries() -> dict:
        """What stays of the holdings, once all keep tests of the date are read."""
        stay = sorted(s for s, h in held.items() if day["date_no"] - h[2] < day["minimum_holding"] or s in kept)
        return {s: held[s] for s in stay[: day["max_stock_positions"]]}

    def close_day(out: list) -> dict:
        chosen = start_entries() if picked is None else picked
        out += [(config, day["as_of"], s, 0.0, *held[s][:2]) for s in held if s not in chosen]
        out += [(config, day["as_of"], s, day["stock_weight_per_position"], *h[:2]) for s, h in sorted(chosen.items())]
        return chosen

    def as_batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        out: list = []
        for row in batch.to_pylist():
            if row["kind"] == _DAY:
                if day is not None:
                    held = close_day(out)
                if row["config_id"] != config:
                    config, held = row["config_id"], {}
                day, kept, picked = row, set(), None
            elif row["kind"] == _KEEPER:
                if row["symbol"] in held:
                    kept.add(row["symbol"])
            else:
                picked = start_entries() if picked is None else picked
                if row["symbol"] not in picked and len(picked) < day["max_stock_positions"]:
                    picked[row["symbol"]] = held.get(row["symbol"]) or (row["board"], row["is_st"], day["date_no"])
        if out:
            yield as_batch(out)
    out = []
    if day is not None:
        close_day(out)
    if out:
        yield as_batch(out)


def etf_snapshot(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Funds that qualify on each date: momentum_20 > 0 and close above MA60, 61 closes."""
    w = by_symbol()
    closes = bars.where(F.col("close").isNotNull()).select("symbol", "trade_date", "close")
    panel = closes.select(
        "symbol", "trade_date", "close", momentum(w, 20).alias("momentum_20"), moving_average(w, 60).alias("ma60"),
        F.row_number().over(w).alias("bar_no"),
    )
    known = panel_as_of(panel, dates, ["close", "momentum_20", "ma60", "bar_no"])
    return known.where((F.col("bar_no") >= 61) & (F.col("momentum_20") > 0) & (F.col("close") > F.col("ma60"))).select(
        "as_of", "symbol", "momentum_20", "close"
    )


def best_per_date(snapshot: DataFrame) -> DataFrame:
    """K4: highest momentum, ties by symbol."""
    return snapshot.groupBy("as_of").agg(
        F.min_by("symbol", F.struct(-F.col("momentum_20"), F.col("symbol"))).alias("chosen")
    )


def etf_rotation(bars: DataFrame, rebalance: DataFrame, stock_signals: DataFrame, configs: DataFrame) -> DataFrame:
    """The fund sleeve per config: weight from unused stock budget, zero row when the choice changes.

    ``rebalance`` has (config_id, as_of); ``stock_signals`` carries config_id.
    """
    best = best_per_date(etf_snapshot(bars, rebalance.select(F.col("as_of").alias("trade_date"))))
    used = stock_signals.where(F.col("target_weight") > 0).groupBy("config_id", F.col("trade_date").alias("as_of")).agg(
        F.sum("target_weight").alias("_used")
    )
    days = (
        rebalance.select("config_id", "as_of").distinct().join(best, "as_of", "left")
        .join(used, ["config_id", "as_of"], "left").join(configs, "config_id").where("etf_enabled")
        .withColumn("_used", F.coalesce("_used", F.lit(0.0)))
    )
    unused = F.greatest(F.lit(0.0), F.col("max_total_stock_weight") - F.col("_used"))
    room = F.greatest(F.lit(0.0), 1.0 - F.col("min_cash_weight") - F.col("_used"))
    desired = F.least(F.col("etf_max_weight"), F.col("etf_target_weight") + unused, room)
    w = Window.partitionBy("config_id").orderBy("as_of")
    held = days.withColumn("_weight", F.when(F.col("chosen").isNotNull(), desired).otherwise(0.0)).withColumn(
        "_held", F.when(F.col("_weight") > 0, F.col("chosen"))
    ).withColumn("_previous", F.lag("_held").over(w))
    exits = F.when(
        F.col("_previous").isNotNull() & ~F.col("_previous").eqNullSafe(F.col("chosen")),
        F.struct(F.col("_previous").alias("symbol"), F.lit(0.0).alias("target_weight"), F.lit(None).cast("int").alias("source_rank")),
    )
    entry = F.when(
        F.col("_held").isNotNull(),
        F.struct(F.col("chosen").alias("symbol"), F.col("_weight").alias("target_weight"), F.lit(1).alias("source_rank")),
    )
    rows = held.select("config_id", F.col("as_of").alias("trade_date"), F.inline(F.array_compact(F.array(exits, entry))))
    return rows.select(
        "config_id", "trade_date", "symbol", "target_weight", etf_board(F.col("symbol")).alias("board"),
        F.lit(False).alias("is_st"), F.lit("etf").alias("instrument_type"), "source_rank",
    )


def combine_signals(stock: DataFrame, etf: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(both sleeves, dates above 100%)."""
    both = stock.unionByName(etf)
    return both, weight_cap_check(both, keys=keys or ["config_id", "trade_date"])


def portfolio_sweep(rankings: DataFrame, etf_bars: DataFrame, configs: DataFrame) -> DataFrame:
    """P5: P3 + P4 + U1 for every config in one plan."""
    stock = settled(hold_buffer_signals(rankings, configs))
    return combine_signals(stock, etf_rotation(etf_bars, rebalance_days(rankings, configs), stock, configs))[0]


def signal_sides(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Buy when the target rises against the previous signal of the same name, else sell."""
    w = Window.partitionBy(*(keys or []), "symbol").orderBy("trade_date")
    before = F.coalesce(F.lag("target_weight").over(w), F.lit(0.0))
    return signals.withColumn("previous_weight", before).withColumn(
        "side", F.when(F.col("target_weight") > F.col("previous_weight"), "buy").otherwise("sell")
    )


def signal_fills(
    signals: DataFrame, bars: DataFrame, capital: float, rules: TradingRules = TradingRules(), *,
    scenarios: dict[str, float] | None = None, max_wait_days: int | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """One fill per signal that changes a weight, sized from a fixed capital.

    Lots, slippage and fees apply; there is no cash path.  ``scenarios`` maps a scenario id to
    its slippage in bps and adds ``scenario_id`` to the key; matching bars is done once for all.
    """
    keys = keys or []
    sided = signal_sides(signals, keys).where(F.col("target_weight") != F.col("previous_weight"))
    filled = next_tradable_bar(sided, bars, max_wait_days=max_wait_days, keys=keys).where(F.col("fill_date").isNotNull())
    plan = scenarios or {"base": rules.slippage_bps}
    grid = F.array(*[F.struct(F.lit(s).alias("scenario_id"), F.lit(float(b)).alias("bps")) for s, b in sorted(plan.items())])
    priced = filled.select("*", F.inline(grid)).withColumn("price", fill_price(F.col("raw_open"), F.col("side"), F.col("bps")))
    change = F.abs(F.col("target_weight") - F.col("previous_weight")) * F.lit(float(capital))
    sized = priced.withColumn("shares", round_lot(change / F.col("price"), rules.board_lot)).where(F.col("shares") > 0)
    sized = sized.withColumn("notional", F.col("shares") * F.col("price"))
    kind = F.coalesce("instrument_type", F.lit("stock")) if "instrument_type" in signals.columns else F.lit("stock")
    costs = trade_cost(F.col("notional"), F.col("side"), F.col("fill_date"), kind, rules)
    return sized.select(
        *keys, "scenario_id", F.col("fill_date").alias("trade_date"), "symbol", "side", "shares", "price", "raw_open", "notional",
        (F.abs(F.col("price") - F.col("raw_open")) * F.col("shares")).alias("slippage_cost"),
        *[costs[c].alias(c) for c in ("commission", "stamp_duty", "transfer_fee", "cost_violation")],
        kind.alias("instrument_type"), F.col("trade_date").alias("signal_date"),
        F.datediff("fill_date", "trade_date").alias("days_waited"),
    )


def target_weight_equity(
    signals: DataFrame, bars: DataFrame, *, initial: float = 1.0, cost_bps: float = 0.0, keys: list[str] | None = None,
) -> DataFrame:
    """Equity of rebalanced target weights with fractional shares, valued at closes.

    A holding period runs from the first market day after a signal date to the next signal date's
    own following day.  Inside it the growth is 1 - sum(w) + sum(w * close / entry close), where
    the entry is the close of the signal date (or the last one before); periods are chained by
    products.  Optional cost is turnover x bps at each signal.  Bars, days and daily growth are read
    several times and settled once each.
    """
    keys = keys or ["portfolio_id"]
    bars = settled(bars.select("symbol", "trade_date", "close"))
    active = signals.select(*keys, "trade_date", "symbol", "target_weight").where(F.col("target_weight") > 0)
    marks = signals.select(*keys, "trade_date").distinct().withColumn(
        "_next", F.lead("trade_date").over(Window.partitionBy(*keys).orderBy("trade_date"))
    )
    market = bars.select("trade_date").distinct()
    days = settled(_days_of_periods(marks, settled(market), keys))
    held = active.withColumnRenamed("trade_date", "signal_date").join(days, [*keys, "signal_date"])
    from tidemark.operators.asof import last_before

    quotes = bars.select("symbol", "trade_date", "close").where(F.col("close").isNotNull())
    entry = last_before(
        active.withColumnRenamed("trade_date", "signal_date").select("symbol", "signal_date").distinct(),
        quotes, ["symbol"], "signal_date", "trade_date", ["close"], inclusive=True, out="_entry",
    ).select("symbol", "signal_date", F.col("_entry.close").alias("_entry"))
    marked = last_before(
        held, quotes, ["symbol"], "trade_date", "trade_date", ["close"], inclusive=True, out="_mark"
    ).join(entry, ["symbol", "signal_date"], "left")
    ratio = F.coalesce(F.try_divide(F.col("_mark.close"), F.col("_entry")), F.lit(1.0))
    inside = marked.groupBy(*keys, "signal_date", "trade_date").agg(
        F.round(F.sum(F.col("target_weight") * (ratio - 1.0)), 14).alias("_gain")  # a sum's order must not make a return
    )
    daily = settled(days.join(inside, [*keys, "signal_date", "trade_date"], "left").withColumn(
        "_growth", 1.0 + F.coalesce("_gain", F.lit(0.0))
    ))
    period = daily.groupBy(*keys, "signal_date").agg(F.max_by("_growth", "trade_date").alias("_whole"))
    if cost_bps:
        turnover = weight_turnover(signals, keys)
        period = period.join(turnover, [*keys, "signal_date"], "left")
        fee = 1.0 - F.coalesce("turnover", F.lit(0.0)) * (cost_bps / 10_000.0)
    else:
        fee = F.lit(1.0)
    # Plain products in date order: a period starts exactly where the one before it ended.
    past = Window.partitionBy(*keys).orderBy("signal_date").rowsBetween(Window.unboundedPreceding, -1)
    chained = period.withColumn("_fee", fee).withColumn(
        "_base", F.coalesce(F.product(F.col("_fee") * F.col("_whole")).over(past), F.lit(1.0)) * F.col("_fee")
    ).select(*keys, "signal_date", "_base")
    return daily.join(chained, [*keys, "signal_date"]).select(
        *keys, "trade_date", (F.lit(float(initial)) * (F.col("_base") * F.col("_growth"))).alias("equity")
    )


def _days_of_periods(marks: DataFrame, market: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal_date, trade_date): market days after a signal up to the next signal date.

    Days are numbered once; each period lists its day numbers, so nothing is range-joined.
    """
    numbered = market.withColumn("_no", F.row_number().over(Window.orderBy("trade_date")))
    top = numbered.agg(F.max("_no").alias("_top"))
    stops = marks.select(F.col("trade_date").alias("_d")).distinct()
    both = numbered.select(F.col("trade_date").alias("_d"), "_no").unionByName(
        stops.withColumn("_no", F.lit(None).cast("int"))
    )
    w = Window.orderBy("_d", F.col("_no").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("_at", F.coalesce(F.last("_no", ignorenulls=True).over(w), F.lit(0))).groupBy("_d").agg(F.max("_at").alias("_at"))
    spans = (
        marks.join(at.select(F.col("_d").alias("trade_date"), F.col("_at").alias("_from")), "trade_date")
        .join(at.select(F.col("_d").alias("_next"), F.col("_at").alias("_to")), "_next", "left")
        .join(F.broadcast(top)).withColumn("_to", F.coalesce("_to", "_top")).where(F.col("_from") < F.col("_to"))
    )
    return (
        spans.withColumn("_no", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))))
        .select(*keys, F.col("trade_date").alias("signal_date"), "_no").join(numbered, "_no")
        .select(*keys, "signal_date", "trade_date")
    )


def weight_turnover(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of absolute weight changes at each signal date (an absent name goes to zero)."""
    from_to = dated_weights(signals, keys)
    return from_to.groupBy(*keys, "signal_date").agg(F.sum(F.abs(F.col("_new") - F.col("_old"))).alias("turnover"))


def dated_weights(signals: DataFrame, keys: list[str]) -> DataFrame:
    marks = signals.select(*keys, "trade_date").distinct().withColumn(
        "_next", F.lead("trade_date").over(Window.partitionBy(*keys).orderBy("trade_date"))
    )
    now = signals.where(F.col("target_weight") > 0).select(*keys, "trade_date", "symbol", "target_weight")
    old = now.join(marks, [*keys, "trade_date"]).where(F.col("_next").isNotNull()).select(
        *keys, F.col("_next").alias("trade_date"), "symbol", F.col("target_weight").alias("_old")
    )
    return now.withColumnRenamed("target_weight", "_new").join(old, [*keys, "trade_date", "symbol"], "full_outer").select(
        *keys, F.col("trade_date").alias("signal_date"), "symbol",
        F.coalesce("_new", F.lit(0.0)).alias("_new"), F.coalesce("_old", F.lit(0.0)).alias("_old"),
    )
