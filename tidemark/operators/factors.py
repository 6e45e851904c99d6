"""Windowed market factors over the long bars table and cross-sectional scoring (W*, S*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.checks import Checked, check_rows
from tidemark.operators.crosssection import carried_stats, rank_min, winsorized_zscores
from tidemark.schema import BAR_NUMERIC
from tidemark.sources.scratch import settled

MIN_BARS = 61
TRADING_DAYS = 252.0
FACTORS = [
    "momentum_20", "momentum_60", "trend_ma20_ma60", "trend_close_ma20", "volatility_20",
    "max_drawdown_60", "log_amount_20",
]


@dataclass(frozen=True)
class FactorSpec:
    name: str
    weight: float
    direction: str = "higher"

    @property
    def sign(self) -> float:
        if self.direction not in ("higher", "lower"):
            raise ValueError(f"unsupported direction for {self.name}: {self.direction}")
        return 1.0 if self.direction == "higher" else -1.0


@dataclass(frozen=True)
class ScoreConfig:
    specs: tuple[FactorSpec, ...]
    lower: float = 0.05
    upper: float = 0.95
    min_coverage: float = 1.0
    # With a number, scores equal to this many digits tie; ranks are of full scores by default.
    score_digits: int | None = None

    def __post_init__(self):
        if not self.specs or any(s.weight <= 0 for s in self.specs):
            raise ValueError("factor weights must be positive and the set non-empty")
        [s.sign for s in self.specs]
        if not 0.0 <= self.lower < self.upper <= 1.0 or not 0.0 < self.min_coverage <= 1.0:
            raise ValueError("bad winsor bounds or coverage")


def _composite(add: Column, have: Column, digits: int | None) -> Column:
    score = add / F.nullif(have, F.lit(0.0))
    return score if digits is None else F.round(score, digits)


def _config(weights: dict[str, tuple[float, str]]) -> ScoreConfig:
    return ScoreConfig(tuple(FactorSpec(n, w, d) for n, (w, d) in weights.items()))


# The two shipped weight sets.
CONFIG_V1 = _config({
    "momentum_20": (0.20, "higher"), "momentum_60": (0.20, "higher"),
    "trend_ma20_ma60": (0.15, "higher"), "volatility_20": (0.15, "lower"),
    "max_drawdown_60": (0.15, "lower"), "log_amount_20": (0.15, "higher"),
})
CONFIG_V2 = _config({
    "momentum_20": (0.15, "higher"), "momentum_60": (0.10, "higher"),
    "trend_ma20_ma60": (0.15, "higher"), "volatility_20": (0.25, "lower"),
    "max_drawdown_60": (0.25, "lower"), "log_amount_20": (0.10, "higher"),
})


def by_symbol() -> WindowSpec:
    """Bars are unique per (symbol, day), so one partition holds at most the calendar's days."""
    return Window.partitionBy("symbol").orderBy("trade_date")


# --- factor registry: a factor is a column expression under a name ---------------------------

_REGISTRY: dict[str, Callable[[WindowSpec], Column]] = {}


def register_factor(name: str, build: Callable[[WindowSpec], Column]) -> None:
    """Make ``build(window)`` available to ``factor_panel`` by name."""
    _REGISTRY[name] = build


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full_frame(agg: Column, w: WindowSpec, n: int) -> Column:
    """Value of a trailing aggregate, NULL until the frame holds n rows."""
    return F.when(F.row_number().over(w) >= n, agg)


def momentum(w: WindowSpec, n: int) -> Column:
    """W1."""
    return F.col("close") / F.lag("close", n).over(w) - 1.0


def moving_average(w: WindowSpec, n: int) -> Column:
    """W2 building block."""
    return full_frame(F.avg("close").over(trailing(w, n)), w, n)


register_factor("momentum_20", lambda w: momentum(w, 20))
register_factor("momentum_60", lambda w: momentum(w, 60))
register_factor("trend_ma20_ma60", lambda w: moving_average(w, 20) / moving_average(w, 60) - 1.0)
register_factor("trend_close_ma20", lambda w: F.col("close") / moving_average(w, 20) - 1.0)
register_factor(
    "volatility_20",
    lambda w: F.when(
        F.count("daily_return").over(trailing(w, 20)) == 20,
        F.stddev_pop("daily_return").over(trailing(w, 20)) * F.sqrt(F.lit(TRADING_DAYS)),
    ),
)
register_factor(
    "log_amount_20",
    lambda w: F.when(F.avg("amount").over(trailing(w, 20)) > 0,
                     F.log1p(F.avg("amount").over(trailing(w, 20)))),
)


_SHIPPED = dict(_REGISTRY)


def daily_returns(bars: DataFrame) -> DataFrame:
    """W18 + W3 input: previous close and one-day return per bar."""
    w = by_symbol()
    return bars.withColumn("previous_close", F.lag("close").over(w)).withColumn(
        "daily_return", F.col("close") / F.col("previous_close") - 1.0
    )


def rolling_drawdown(bars: DataFrame, n: int = 60, out: str = "max_drawdown_60") -> DataFrame:
    """Worst close against the running peak inside the trailing n bars, as a positive number.

    Two adjacent spans combine exactly: peak = max, trough = min, and the drawdown of the whole
    is the least of both drawdowns and trough(right) / peak(left).  Doubling span lengths by
    ``lag`` covers n bars in O(log n) steps with three numbers per row, no arrays.
    """
    w = by_symbol()
    one = F.struct(F.col("close").alias("hi"), F.col("close").alias("lo"), F.lit(1.0).alias("dd"))

    def glue(left: Column, right: Column) -> Column:
        both = F.struct(
            F.greatest(left["hi"], right["hi"]).alias("hi"),
            F.least(left["lo"], right["lo"]).alias("lo"),
            F.least(left["dd"], right["dd"], right["lo"] / left["hi"]).alias("dd"),
        )
        return F.when(left.isNotNull(), both).otherwise(right)

    df = bars.withColumn("_span1", one)
    size = 1
    while size * 2 <= n:
        left = F.lag(f"_span{size}", size).over(w)
        df = df.withColumn("_left", left).withColumn(
            f"_span{size * 2}", glue(F.col("_left"), F.col(f"_span{size}"))
        )
        size *= 2
    covered, total = size, F.col(f"_span{size}")
    df = df.withColumn("_total", total)
    for part in [1 << b for b in range(size.bit_length() - 2, -1, -1)]:
        if n & part:
            df = df.withColumn("_left", F.lag(f"_span{part}", covered).over(w)).withColumn(
                "_total", glue(F.col("_left"), F.col("_total"))
            )
            covered += part
    return df.withColumn(out, 1.0 - F.col("_total.dd")).select(*bars.columns, out)


def validate_bars(raw: DataFrame) -> Checked:
    """Pad, cast, positive prices, one row per (symbol, trade_date)."""
    from tidemark.functions.symbols import pad_symbol

    cast = raw.select(
        pad_symbol(F.col("symbol")).alias("symbol"),
        F.expr("try_cast(trade_date AS date)").alias("trade_date"),
        *[F.nanvl(F.expr(f"try_cast({c} AS double)"), F.lit(None)).alias(c) for c in BAR_NUMERIC],
    )
    positive = F.lit(True)
    for c in ("open", "high", "low", "close"):
        positive = positive & (F.coalesce(F.col(c), F.lit(1.0)) > 0)
    rules = {
        "trade_date_invalid": F.col("trade_date").isNotNull(),
        "close_missing": F.col("close").isNotNull(),
        "price_not_positive": positive,
    }
    return check_rows(cast, ["symbol", "trade_date"], rules, unique=["symbol", "trade_date"])


# --- what a bar's factors read of the bars before it ------------------------------------------------

REACH = 60


def _from_trailing(name: str, w: WindowSpec) -> Column:
    """A shipped factor over ``trailing_columns``, equal to its registered window expression; any other by its own expression."""
    if _REGISTRY[name] is not _SHIPPED.get(name):
        return _REGISTRY[name](w)
    c = F.col
    return {
        "momentum_20": lambda: c("close") / c("_close_20") - 1.0,
        "momentum_60": lambda: c("close") / c("_close_60") - 1.0,
        "trend_ma20_ma60": lambda: c("_ma_20") / c("_ma_60") - 1.0,
        "trend_close_ma20": lambda: c("close") / c("_ma_20") - 1.0,
        "volatility_20": lambda: c("_deviation_20") * F.sqrt(F.lit(TRADING_DAYS)),
        "log_amount_20": lambda: F.when(c("average_amount_20") > 0, F.log1p("average_amount_20")),
    }[name]()


TRAILING = ["average_amount_20", "_ma_20", "_ma_60", "_deviation_20", "max_drawdown_60"]


def trailing_columns(bars: DataFrame) -> DataFrame:
    """W1-W5 input per bar: earlier closes, trailing averages, deviation of returns and drawdown.

    Bars are dealt by symbol and sorted once, for their row number; a batch of them is read with the REACH
    rows before it, all its rows at a time and from the oldest row of a frame to the newest, which is the
    order in which a window adds.  A sliding window of the engine would add up every frame row by row.
    """
    close = bars.schema["close"].dataType
    fields = [*bars.schema, *[StructField(c, close) for c in ("previous_close", "_close_20", "_close_60")], *[StructField(c, DoubleType()) for c in TRAILING]]
    # the window asks for bars by symbol and in order, which no later step of the engine may undo
    ordered = bars.withColumn("_place", F.row_number().over(by_symbol()) - 1)
    return ordered.mapInArrow(_trailing_batches, StructType([StructField(f.name, f.dataType) for f in fields]))


def _trailing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bars in order of symbol and place, each with its trailing columns; state: the last REACH rows."""
    before = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rows = (table if before is None else pa.concat_tables([before, table])).combine_chunks()
        skip, place = rows.num_rows - table.num_rows, rows.column("_place").to_numpy().astype(np.int64)
        if not np.all((place[1:] == place[:-1] + 1) | (place[1:] == 0)):
            raise ValueError("bars are not in order")
        index = np.arange(len(place))
        made = _trailing(_doubles(rows.column("close")), _doubles(rows.column("amount")), place)
        out = {c: table.column(c) for c in table.column_names if c != "_place"}
        for name, lag in (("previous_close", 1), ("_close_20", 20), ("_close_60", 60)):
            out[name] = rows.column("close").take(pa.array(index[skip:] - lag, mask=place[skip:] < lag))
        out |= {c: pa.array(value[skip:], mask=~known[skip:]) for c, (value, known) in zip(TRAILING, made, strict=True)}
        yield from pa.table(out).combine_chunks().to_batches()
        before = rows.slice(max(0, len(place) - REACH))


def _doubles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are known); what is not known is 0."""
    known = column.is_valid().to_numpy()
    return column.cast(pa.float64(), safe=False).fill_null(0.0).to_numpy(), known


def _trailing(close: tuple[np.ndarray, np.ndarray], amount: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(value, known) of the TRAILING columns of rows that stand at ``place`` in their symbol's bars."""
    n, zero = len(place), lambda kind=float: np.zeros(len(place), kind)

    def back(x: np.ndarray, lag: int) -> np.ndarray:
        return np.concatenate([np.zeros(min(lag, n), x.dtype), x[: max(0, n - lag)]])

    with np.errstate(all="ignore"):
        earlier = back(close[0], 1)
        returned = close[1] & back(close[1], 1) & (place >= 1) & (earlier != 0)
        gain = np.where(returned, close[0] / earlier - 1.0, 0.0)
        sums, counts = {c: zero() for c in ("amount", 20, 60)}, {c: zero(int) for c in ("amount", 20, 60, "gain")}
        mean, squares, peak, drawdown = zero(), zero(), np.full(n, -np.inf), np.ones(n)
        for lag in range(REACH - 1, -1, -1):
            here = place >= lag
            have, x = here & back(close[1], lag), back(close[0], lag)
            peak = np.where(have, np.maximum(peak, x), peak)
            drawdown = np.where(have & (peak != 0), np.fmin(drawdown, x / peak), drawdown)
            for size in (20, 60) if lag < 20 else (60,):
                sums[size] += np.where(have, x, 0.0)
                counts[size] += have
            if lag < 20:
                have = here & back(amount[1], lag)
                sums["amount"] += np.where(have, back(amount[0], lag), 0.0)
                counts["amount"] += have
                # counted rows only matter where all 20 are there, so the number of rows so far is that of the frame
                counts["gain"] += here & back(returned, lag)
                delta = back(gain, lag) - mean
                step = delta / (20 - lag)
                mean, squares = mean + step, squares + delta * (delta - step)
        average = {c: (sums[c] / counts[c], counts[c] > 0) for c in sums}
        full = lambda size: (average[size][0], average[size][1] & (place >= size - 1))
        return [average["amount"], full(20), full(60), (np.sqrt(squares / 20.0), counts["gain"] == 20), (1.0 - drawdown, np.ones(n, bool))]


def factor_panel(
    bars: DataFrame, *, min_history: int = MIN_BARS, min_average_amount: float = 20_000_000.0,
    extra: list[str] | None = None, carried: list[str] | None = None,
) -> DataFrame:
    """W1-W6 for every (symbol, trade_date) in one pass, with the F1 reason per row.

    The bars are shuffled and sorted once.  Bars that are a part of a longer history carry their number in
    it as ``bar_no``.  ``carried`` columns of the bars are handed through.
    """
    w = by_symbol()
    names = [f for f in FACTORS if f != "max_drawdown_60"] + list(extra or [])
    numbered = bars if "bar_no" in bars.columns else bars.withColumn("bar_no", F.row_number().over(w))
    df = trailing_columns(numbered.select("symbol", "trade_date", "close", "amount", "bar_no", *(carried or [])))
    df = df.withColumn("daily_return", F.col("close") / F.col("previous_close") - 1.0).select(
        "symbol", "trade_date", "close", "previous_close", "max_drawdown_60", "bar_no", "average_amount_20",
        *[_from_trailing(name, w).alias(name) for name in names], *(carried or []),
    )
    reason = (
        F.when(
            F.col("bar_no") < min_history,
            F.concat(F.lit("insufficient_history:"), F.col("bar_no").cast("string"), F.lit(f"<{min_history}")),
        )
        .when(F.col("average_amount_20").isNull(), "invalid_average_amount_20")
        .when(F.col("average_amount_20") < min_average_amount, "below_min_average_amount_20")
    )
    missing = F.lit(False)
    for name in FACTORS:
        missing = missing | F.col(name).isNull() | F.isnan(name)
    reason = F.coalesce(
        reason,
        F.when(F.col("bar_no") < MIN_BARS, f"factor_error:need {MIN_BARS} bars").when(
            missing, "factor_error:non-finite factor"
        ),
        F.lit("eligible"),
    )
    return df.withColumn("reason", reason)


# --- the panel kept up day by day: 61 bars a symbol are all that a new row looks at ------------------

TAIL = ["symbol", "trade_date", "close", "amount", "bar_no"]


def panel_tail(bars: DataFrame) -> DataFrame:
    """The last MIN_BARS bars of each symbol, numbered as in its whole history; ``bars`` may be numbered already."""
    w = by_symbol()
    numbered = bars if "bar_no" in bars.columns else bars.withColumn("bar_no", F.row_number().over(w))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    return numbered.select(*TAIL, back.alias("_back")).where(F.col("_back") <= MIN_BARS).drop("_back")


def extend_panel(tail: DataFrame, fresh: DataFrame, **gates) -> tuple[DataFrame, DataFrame]:
    """(panel rows of the fresh bars, the tail after them).  ``fresh`` are bars later than their symbol's tail,
    one per (symbol, day); nothing but they and the tail is read."""
    ends = tail.groupBy("symbol").agg(F.max("bar_no").alias("_end"))
    own = F.row_number().over(by_symbol())
    added = fresh.select("symbol", "trade_date", "close", "amount").withColumn("_no", own).join(ends, "symbol", "left").withColumn("bar_no", F.coalesce("_end", F.lit(0)) + F.col("_no"))
    both = tail.join(fresh.select("symbol").distinct(), "symbol", "left_semi").select(*TAIL).unionByName(added.select(*TAIL))
    rows = factor_panel(both, **gates).join(ends, "symbol", "left").where(F.col("bar_no") > F.coalesce("_end", F.lit(0))).drop("_end")
    return rows, panel_tail(both)


def changed_panel(bars: DataFrame, changed: DataFrame, **gates) -> DataFrame:
    """Panel rows that corrected bars change: those up to MIN_BARS - 1 bars after a changed one.

    ``bars`` hold the corrected history; ``changed`` is (symbol, trade_date, inserted).  A bar that was
    inserted moves the numbers of all later ones, so all later rows of its symbol are made again.
    """
    w, reach = by_symbol(), MIN_BARS - 1
    marks = changed.groupBy("symbol", "trade_date").agg(F.max("inserted").alias("_inserted"), F.lit(True).alias("_changed"))
    of = bars.join(changed.select("symbol").distinct(), "symbol", "left_semi").withColumn("bar_no", F.row_number().over(w)).join(marks, ["symbol", "trade_date"], "left")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    last, moved = F.max(F.when(F.col("_changed"), F.col("bar_no"))).over(before), F.max(F.coalesce("_inserted", F.lit(False))).over(before)
    of = of.withColumn("_again", F.coalesce(F.col("bar_no") - last <= reach, F.lit(False)) | moved)
    needed = of.withColumn("_needed", F.max("_again").over(w.rowsBetween(0, reach))).where("_needed")
    again = needed.where("_again").select("symbol", "trade_date")
    return factor_panel(needed.select(*TAIL), **gates).join(again, ["symbol", "trade_date"], "left_semi")


def latest_bars(panel: DataFrame) -> DataFrame:
    """Last row per symbol, picked by aggregation (no second sort)."""
    others = [c for c in panel.columns if c != "symbol"]
    return panel.groupBy("symbol").agg(
        F.max_by(F.struct(*others), F.col("trade_date")).alias("_r")
    ).select("symbol", "_r.*")


def market_factors(bars: DataFrame, **gates) -> DataFrame:
    """The latest factor row of each eligible symbol."""
    return (
        latest_bars(factor_panel(bars, **gates)).where(F.col("reason") == "eligible")
        .select("symbol", F.col("trade_date").alias("as_of"), "close", "average_amount_20", *FACTORS)
    )


def score_table(
    table: DataFrame, config: ScoreConfig = CONFIG_V1, keys: list[str] | None = None,
) -> DataFrame:
    """Contributions, coverage, composite, rank and percentile per cross-section.

    The table is settled once.  A member that stands twice in a cross-section is refused.
    """
    keys, rows = keys or ["as_of"], settled(table)
    twice = duplicate_members(rows, keys).take(3)
    if twice:
        raise ValueError(f"symbols stand twice in a cross-section: {[tuple(r) for r in twice]}")
    return _scored(rows, config, keys)


def _scored(rows: DataFrame, config: ScoreConfig, keys: list[str], shown: Column | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``score_table`` of rows that are cheap to read and unique per (keys, symbol); rows that are not ``shown`` count in
    every rank, but are dealt with their composite score alone."""
    names = [s.name for s in config.specs]
    zed = winsorized_zscores(rows, keys, names, config.lower, config.upper, stats=stats)
    # One-row arrays keep the optimiser from writing scores into every later mention of them.
    signed = F.struct(*[(F.col("z_" + s.name) * s.sign).alias("score_" + s.name) for s in config.specs])
    scored = zed.select(*rows.columns, F.inline(F.array(signed)))
    total = sum(s.weight for s in config.specs)
    have = sum((F.when(F.col("score_" + s.name).isNotNull(), s.weight).otherwise(0.0) for s in config.specs), F.lit(0.0))
    add = sum((F.coalesce(F.col("score_" + s.name), F.lit(0.0)) * s.weight for s in config.specs), F.lit(0.0))
    coverage = have / total
    composite = F.when(coverage >= config.min_coverage - 1e-12, _composite(add, have, config.score_digits))
    scored = scored.select(*scored.columns, F.inline(F.array(F.struct(coverage.alias("factor_coverage"), composite.alias("composite_score")))))
    if shown is not None:
        scored = scored.select(*[F.col(c) if c in (*keys, "composite_score") else F.when(shown, F.col(c)).alias(c) for c in scored.columns])
    ranked = rank_min(scored, keys, "composite_score", "rank", count_out="_scored")
    pct = F.when(F.col("_scored") == 1, 100.0).otherwise(
        (F.col("_scored") - F.col("rank")) / (F.col("_scored") - 1) * 100.0
    )
    return ranked.withColumn(
        "score_percentile", F.when(F.col("rank").isNotNull(), pct)
    ).drop("_scored")


def duplicate_members(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    cols = [*(keys or ["as_of"]), "symbol"]
    return table.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def factor_engine(
    bars: DataFrame, config: ScoreConfig = CONFIG_V1, **gates
) -> tuple[DataFrame, DataFrame]:
    """S3: (ranking, exclusions) over each symbol's latest bar, as one cross-section."""
    latest = settled(latest_bars(factor_panel(bars, **gates)))
    eligible = latest.where(F.col("reason") == "eligible").select(
        F.lit("latest").alias("_run"), "symbol", F.col("trade_date").alias("as_of"), "close",
        "average_amount_20", *FACTORS,
    )
    ranking = _scored(eligible, config, ["_run"]).drop("_run")
    shown = F.when(~F.col("reason").startswith("insufficient_history"), F.col("average_amount_20"))
    exclusions = latest.where(F.col("reason") != "eligible").select(
        "symbol", "reason", shown.alias("average_amount_20")
    )
    return ranking, exclusions


def calendar_index(bars: DataFrame) -> DataFrame:
    """Distinct dates numbered 0.. in order; at most one row per calendar day."""
    days = bars.select("trade_date").distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("trade_date")) - 1)


def carry_spans(panel: DataFrame, start: str | None = None, end: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Each bar with the numbers of the days on which it is its symbol's last one: ``day_no`` (its own) and
    ``_from`` to ``_until``, cut to the days from ``start`` to ``end``; bars without such a day are left out.
    ``days`` is the panel's ``calendar_index``, if it is known already.  Where bars have the date of their symbol's next
    one as ``_next_date``, they are not dealt and put in order for it."""
    days = calendar_index(panel) if days is None else days
    within = (F.col("trade_date") >= F.lit(start).cast("date") if start else F.lit(True)) & (F.col("trade_date") <= F.lit(end).cast("date") if end else F.lit(True))
    ends = days.agg(F.min(F.when(within, F.col("day_no"))).alias("_low"), F.max(F.when(within, F.col("day_no"))).alias("_high"))
    if "_next_date" in panel.columns:
        spans = panel.join(days, "trade_date").join(days.toDF("_next_date", "_next"), "_next_date", "left").drop("_next_date")
    else:
        spans = panel.join(days, "trade_date").withColumn("_next", F.lead("day_no").over(Window.partitionBy("symbol").orderBy("day_no")))
    spans = spans.join(F.broadcast(ends))
    spans = spans.withColumn("_from", F.greatest("day_no", "_low")).withColumn("_until", F.least(F.coalesce(F.col("_next") - 1, F.col("_high")), "_high"))
    return spans.where(F.col("_from") <= F.col("_until")).drop("_next", "_low", "_high")


def carry_forward(panel: DataFrame) -> DataFrame:
    """Every date on or after a symbol's first bar, with the last bar known then (``as_of``).

    Each bar is valid until the symbol's next bar; the dates in between are generated from day
    numbers, so the output is written once and no dates-by-symbols product is joined.
    """
    dense = carry_spans(panel).withColumn("_day", F.explode(F.sequence("_from", "_until"))).withColumnRenamed("trade_date", "bar_date")
    named = calendar_index(panel).select(F.col("day_no").alias("_day"), F.col("trade_date").alias("as_of"))
    return dense.join(named, "_day").drop("_day", "_from", "_until", "day_no")


def historical_rankings(
    bars: DataFrame, config: ScoreConfig = CONFIG_V1, *, stale: str = "score_then_drop",
    start: str | None = None, end: str | None = None, metadata: DataFrame | None = None, **gates,
) -> DataFrame:
    """The ranking observable on each date, for all dates at once.

    ``score_then_drop`` scores stale symbols too and removes them afterwards, so ranks may have
    gaps; ``drop_then_score`` ranks only symbols with a bar on the date.

    The panel is settled once, bar by bar: the days to which a bar is carried are generated anew by
    each step that reads them, and a carried row has only what its score needs.
    """
    kept = ["symbol", "close", "average_amount_20", *FACTORS]
    if stale == "score_then_drop":
        # the next bar's date comes from the order that the panel needs anyway
        panel = factor_panel(bars.withColumn("_next_date", F.lead("trade_date").over(by_symbol())), carried=["_next_date"], **gates)
        days = settled(calendar_index(bars))  # the panel has the days of its bars
        spans = settled(carry_spans(panel, start, end, days).where(F.col("reason") == "eligible").select("day_no", "_from", "_until", "trade_date", *kept))
        own = F.col("_day") == F.col("day_no")
        needed = {s.name for s in config.specs}
        stats = carried_stats(spans, [s.name for s in config.specs], config.lower, config.upper)
        dense = spans.withColumn("_day", F.explode(F.sequence("_from", "_until")))
        table = dense.select("_day", *[(F.col(c) if c in needed else F.when(own, F.col(c))).alias(c) for c in kept], F.when(own, F.col("trade_date")).alias("as_of"))
        ranked = _scored(table, config, ["_day"], F.col("as_of").isNotNull(), stats).where(F.col("as_of").isNotNull()).drop("_day")
        ranked = ranked.select("as_of", *[c for c in ranked.columns if c != "as_of"])
    elif stale == "drop_then_score":
        table = factor_panel(bars, **gates).where(F.col("reason") == "eligible").select(F.col("trade_date").alias("as_of"), *kept)
        for edge, inside in ((start, F.col("as_of") >= F.lit(start).cast("date")), (end, F.col("as_of") <= F.lit(end).cast("date"))):
            table = table.where(inside) if edge else table
        ranked = _scored(settled(table), config, ["as_of"])
    else:
        raise ValueError("stale must be score_then_drop or drop_then_score")
    return ranked if metadata is None else attach_metadata(ranked, metadata)


def attach_metadata(ranking: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of descriptive columns; Spark sizes the side at run time."""
    keep = [c for c in ("symbol", "name", "exchange", "board", "is_st", "screen_source") if c in metadata.columns]
    return ranking.join(metadata.select(*keep), "symbol", "left")


def strict_rankings(
    bars: DataFrame, candidates: DataFrame, config: ScoreConfig = CONFIG_V1, **gates,
) -> tuple[DataFrame, DataFrame]:
    """Rank only the (as_of, symbol) pairs observed that day; (ranking, refused dates)."""
    listed = candidates.select("as_of", "symbol").distinct()
    panel = factor_panel(bars.join(listed.select("symbol").distinct(), "symbol", "left_semi"), **gates)
    known = panel.select("symbol", "trade_date", "reason", "close", "average_amount_20", *FACTORS)
    # The last bar on or before each observed (date, symbol): one ordered pass per symbol.
    payload = F.struct(*[c for c in known.columns if c != "symbol"])
    marks = known.select("symbol", F.col("trade_date").alias("_t"), F.lit(0).alias("_ask"), payload.alias("_bar"))
    asks = listed.select("symbol", F.col("as_of").alias("_t"), F.lit(1).alias("_ask"),
                         F.lit(None).cast(marks.schema["_bar"].dataType).alias("_bar"))
    w = Window.partitionBy("symbol").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = settled(
        marks.unionByName(asks).withColumn("_bar", F.last("_bar", ignorenulls=True).over(w))
        .where((F.col("_ask") == 1) & F.col("_bar").isNotNull())
        .select("symbol", F.col("_t").alias("as_of"), "_bar.*")
    )
    eligible = seen.where(F.col("reason") == "eligible").drop("reason")
    ranked = _scored(eligible, config, ["as_of"]).where(
        F.col("trade_date") == F.col("as_of")
    ).drop("trade_date")
    meta = candidates.select(*[c for c in ("as_of", "symbol", "name", "exchange", "board", "is_st") if c in candidates.columns])
    out = settled(ranked.join(meta, ["as_of", "symbol"], "left"))
    per_day = (
        listed.select("as_of").distinct()
        .join(seen.groupBy("as_of").agg(F.count(F.lit(1)).alias("histories"),
                                        F.count_if(F.col("reason") == "eligible").alias("eligible")), "as_of", "left")
        .join(out.groupBy("as_of").agg(F.count(F.lit(1)).alias("ranked"),
                                       F.count_if(F.col("board").isNull() | F.col("is_st").isNull()).alias("no_meta")), "as_of", "left")
    )
    reason = (
        F.when(F.col("histories").isNull(), "no_histories")
        .when(F.col("eligible") == 0, "no_eligible_factor_rows")
        .when(F.col("ranked").isNull(), "no_same_day_factor_rows")
        .when(F.col("no_meta") > 0, "missing_point_in_time_metadata")
    )
    refused = per_day.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("as_of", "reason")
    return out.join(refused.select("as_of"), "as_of", "left_anti"), refused


def score_configs(
    table: DataFrame, configs: dict[str, ScoreConfig], keys: list[str] | None = None,
) -> DataFrame:
    """Several weight sets over one panel; z-scores are shared, only weights differ."""
    keys = keys or ["as_of"]
    bounds = {(c.lower, c.upper) for c in configs.values()}
    if len(bounds) != 1:
        raise ValueError("configs scored together must share winsor bounds")
    (lower, upper), = bounds
    names = sorted({s.name for c in configs.values() for s in c.specs})
    zed = winsorized_zscores(settled(table), keys, names, lower, upper)
    cases = []
    for cid, cfg in sorted(configs.items()):
        total = sum(s.weight for s in cfg.specs)
        have = sum((F.when(F.col("z_" + s.name).isNotNull(), s.weight).otherwise(0.0) for s in cfg.specs), F.lit(0.0))
        add = sum((F.coalesce(F.col("z_" + s.name), F.lit(0.0)) * (s.weight * s.sign) for s in cfg.specs), F.lit(0.0))
        cases.append(F.struct(
            F.lit(cid).alias("config_id"), (have / total).alias("factor_coverage"),
            F.when(have / total >= cfg.min_coverage - 1e-12, _composite(add, have, cfg.score_digits)).alias("composite_score"),
        ))
    exploded = zed.select(*keys, "symbol", F.inline(F.array(*cases)))
    ranked = rank_min(exploded, ["config_id", *keys], "composite_score", "rank", count_out="_scored")
    pct = F.when(F.col("_scored") == 1, 100.0).otherwise((F.col("_scored") - F.col("rank")) / (F.col("_scored") - 1) * 100.0)
    return ranked.withColumn("score_percentile", F.when(F.col("rank").isNotNull(), pct)).drop("_scored")
