"""Canonical table layouts shared by sources, validators and operators."""

from pyspark.sql import types as T

_D, _S, _B = T.DoubleType(), T.StringType(), T.BooleanType()
_DATE, _TS, _I = T.DateType(), T.TimestampType(), T.IntegerType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


BARS = _table(
    symbol=_S, trade_date=_DATE, open=_D, high=_D, low=_D, close=_D, volume=_D, amount=_D,
    amplitude_pct=_D, change_pct=_D, change=_D, turnover_pct=_D,
)
SPOT = _table(
    symbol=_S, name=_S, last=_D, amount=_D, turnover_pct=_D, market_cap=_D, float_market_cap=_D
)
MASTER = _table(
    symbol=_S, name=_S, exchange=_S, board=_S, list_date=_DATE, industry=_S, total_shares=_D,
    float_shares=_D, is_st=_B, is_listed=_B, observed_at=_TS,
)
FACTS = _table(symbol=_S, metric=_S, value=_D, period_end=_TS, available_at=_TS, source=_S)
BENCHMARK = _table(trade_date=_DATE, close=_D)
LIFECYCLE = _table(
    symbol=_S, name=_S, exchange=_S, board=_S, list_date=_DATE, delist_date=_DATE,
    currently_listed=_B, membership_source=_S, reconstruction_grade=_S,
)
AMOUNTS = _table(symbol=_S, trade_date=_DATE, amount=_D)
STATES = _table(symbol=_S, trade_date=_DATE, is_st=_B, trade_status=_B, close=_D)
SIGNALS = _table(
    trade_date=_DATE, symbol=_S, target_weight=_D, board=_S, is_st=_B, instrument_type=_S,
    source_rank=_I,
)
CANDIDATES = _table(
    symbol=_S, name=_S, exchange=_S, board=_S, list_date=_DATE, is_st=_B, is_listed=_B,
    amount=_D, float_market_cap=_D, screen_source=_S, listing_age_verified=_B,
)
SIGNAL_LEDGER = _table(
    signal_date=_DATE, symbol=_S, name=_S, board=_S, is_st=_B, rank=_I, composite_score=_D,
    target_weight=_D, screen_source=_S, strategy_version=_S, observed_at=_TS,
)
RANKING_LEDGER = _table(
    signal_date=_DATE, symbol=_S, name=_S, board=_S, is_st=_B, rank=_I, composite_score=_D,
    close=_D, momentum_20=_D, trend_close_ma20=_D, screen_source=_S, strategy_version=_S,
    observed_at=_TS,
)

BAR_NUMERIC = [f.name for f in BARS if f.dataType == _D]
REQUIRED_EXCHANGES = ("BSE", "SSE", "SZSE")
MASTER_STATE = (
    "symbol", "name", "exchange", "board", "list_date", "industry", "is_st", "is_listed"
)
