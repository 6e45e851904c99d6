"""Trading-rule expressions: fees, duties, price limits, lots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TradingRules:
    board_lot: int = 100
    commission_rate: float = 0.0003
    minimum_commission: float = 5.0
    commission_threshold: float | None = None
    commission_excess_rate: float | None = None
    stock_transfer_rate: float = 0.0
    etf_commission_rate: float = 0.00005
    etf_minimum_commission: float = 0.5
    slippage_bps: float = 5.0

    @classmethod
    def small_account(cls, slippage_bps: float = 5.0) -> "TradingRules":
        """Flat fee up to a threshold, a rate on the excess above it."""
        return cls(
            commission_threshold=10_000.0, commission_excess_rate=0.000086,
            stock_transfer_rate=0.00001, slippage_bps=slippage_bps,
        )


# Dated seller stamp duty, [valid_from, valid_to).
STAMP_DUTY = [("2008-09-19", "2023-08-28", 0.001), ("2023-08-28", None, 0.0005)]
# Dated daily price limits per board group.
PRICE_LIMITS = [
    ("star", None, None, 0.20),
    ("etf", None, None, 0.10),
    ("bse", None, None, 0.30),
    ("chinext", None, "2020-08-24", 0.10),
    ("chinext", "2020-08-24", None, 0.20),
    ("main_st", None, "2026-07-06", 0.05),
    ("main_st", "2026-07-06", None, 0.10),
    ("main", None, None, 0.10),
]
BOARD_GROUPS = {
    "star": ("科创板", "star", "star_market", "etf20"),
    "etf": ("etf", "etf10"),
    "bse": ("北交所", "bse", "beijing"),
    "chinext": ("创业板", "chinext"),
}


def board_group(board: Column, is_st: Column) -> Column:
    name = F.lower(F.trim(board))
    expr = F.when(F.lit(False), F.lit(""))
    for group, names in BOARD_GROUPS.items():
        expr = expr.when(name.isin(*names), group)
    return expr.when(is_st, "main_st").otherwise("main")


def _dated(date: Column, valid_from: str | None, valid_to: str | None) -> Column:
    inside = F.lit(True)
    if valid_from:
        inside = inside & (date >= F.lit(valid_from).cast("date"))
    if valid_to:
        inside = inside & (date < F.lit(valid_to).cast("date"))
    return inside


def price_limit_pct(board: Column, is_st: Column, trade_date: Column) -> Column:
    """The dated limit; the rule rows fold into one CASE, no join is needed."""
    group = board_group(board, F.coalesce(is_st, F.lit(False)))
    expr = F.when(F.lit(False), F.lit(0.0))
    for name, start, end, pct in PRICE_LIMITS:
        expr = expr.when((group == name) & _dated(trade_date, start, end), pct)
    return expr


def stamp_duty_rate(trade_date: Column, side: Column) -> Column:
    """Seller-only duty; NULL on a sell date that no rule row covers."""
    expr = F.when(F.lower(side) != "sell", 0.0)
    for start, end, rate in STAMP_DUTY:
        expr = expr.when(_dated(trade_date, start, end), rate)
    return expr


def cents(value: Column) -> Column:
    return F.round(value + F.lit(1e-12), 2)


def trade_cost(
    notional: Column, side: Column, trade_date: Column, instrument_type: Column, rules: TradingRules
) -> dict[str, Column]:
    """Commission, stamp_duty, transfer_fee, total_cost and a violation code."""
    is_etf = F.lower(F.trim(instrument_type)) == "etf"
    etf_fee = F.greatest(notional * rules.etf_commission_rate, F.lit(rules.etf_minimum_commission))
    if rules.commission_threshold is not None and rules.commission_excess_rate is not None:
        excess = F.greatest(notional - rules.commission_threshold, F.lit(0.0))
        stock_fee = F.lit(rules.minimum_commission) + excess * rules.commission_excess_rate
    else:
        stock_fee = F.greatest(notional * rules.commission_rate, F.lit(rules.minimum_commission))
    duty_rate = F.when(is_etf, 0.0).otherwise(stamp_duty_rate(trade_date, side))
    idle = notional == 0
    commission = F.when(idle, 0.0).otherwise(cents(F.when(is_etf, etf_fee).otherwise(stock_fee)))
    duty = F.when(idle, 0.0).otherwise(cents(notional * duty_rate))
    transfer = F.when(idle | is_etf, 0.0).otherwise(cents(notional * rules.stock_transfer_rate))
    violation = (
        F.when(notional < 0, "negative_notional")
        .when(~F.lower(side).isin("buy", "sell"), "unsupported_side")
        .when(~idle & duty_rate.isNull(), "stamp_duty_not_modelled")
    )
    return {
        "commission": commission, "stamp_duty": duty, "transfer_fee": transfer,
        "total_cost": commission + duty + transfer, "cost_violation": violation,
    }


def fill_price(open_price: Column, side: Column, bps) -> Column:
    """NULL for a non-positive open or an unknown side."""
    slip = (bps if isinstance(bps, Column) else F.lit(float(bps))) / F.lit(10_000.0)
    return F.when(
        open_price > 0,
        F.when(F.lower(side) == "buy", open_price * (1 + slip)).when(
            F.lower(side) == "sell", open_price * (1 - slip)
        ),
    )


def limit_prices(previous_close: Column, pct: Column) -> tuple[Column, Column]:
    """(lower, upper), rounded half-up to cents."""
    valid = (previous_close > 0) & (pct > 0) & (pct < 1)
    return (
        F.when(valid, F.round(previous_close * (1 - pct), 2)),
        F.when(valid, F.round(previous_close * (1 + pct), 2)),
    )


def limit_blocked(
    side: Column, open_price: Column, previous_close: Column, pct: Column, tolerance: float = 0.001
) -> Column:
    lower, upper = limit_prices(previous_close, pct)
    return F.when(F.lower(side) == "buy", open_price >= upper - tolerance).when(
        F.lower(side) == "sell", open_price <= lower + tolerance
    )


def round_lot(shares: Column, lot: int = 100) -> Column:
    """P10."""
    return F.when(shares > 0, F.floor(shares / lot) * lot).otherwise(F.lit(0)).cast("long")


def affordable_lot(close: Column, ticket, buffer_rate, lot: int = 100) -> Column:
    """one board lot plus a buffer fits the ticket."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return close * float(lot) * (1.0 + as_col(buffer_rate)) <= as_col(ticket)
