"""Queries over signals, fills, costs, equity and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import asof as J
from tidemark.operators import normalize as N
from tidemark.operators import performance as Q
from tidemark.operators import portfolio as P
from tidemark.sources.scratch import settled
from tidemark.plans.oracle_views import VIEWS, with_views
from tidemark.plans.registry import query, r, rounded
from tidemark.sources import views as V

# --- rankings to signals ----------------------------------------------------------------------


# amounts are added as decimals: a sum of doubles depends on its order, which would decide between equal amounts
_EXACT = VIEWS["rankings"].replace("sum(amount) AS amount", "CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount")


@query("validate_rankings", with_views(["bars", "lifecycle"], "SELECT as_of, symbol, rank FROM rankings WHERE rank IS NOT NULL AND close > 0 AND momentum_20 IS NOT NULL AND trend_close_ma20 IS NOT NULL", {"rankings": _EXACT}))
def _(spark, sf):
    return N.validate_rankings(settled(V.rankings(spark, sf))).select("as_of", "symbol", "rank")


@query("top_n_per_date", with_views(["chosen"], "SELECT as_of, symbol, board, is_st FROM chosen"))
def _(spark, sf):
    return P.top_n_per_date(settled(V.rankings(spark, sf)), 5).select("as_of", "symbol", "board", "is_st")


@query("rebalance_calendar", with_views(["steps"], "SELECT as_of, CAST(date_no AS INTEGER) AS date_no FROM (SELECT as_of, row_number() OVER (ORDER BY as_of) - 1 AS date_no FROM steps) WHERE date_no % 5 = 0"))
def _(spark, sf):
    return P.rebalance_calendar(settled(V.rankings(spark, sf)), 5)


@query("dropped_holdings", with_views(["signals"], "SELECT trade_date AS as_of, symbol FROM signals WHERE target_weight = 0"))
def _(spark, sf):
    ranked = settled(V.rankings(spark, sf))
    chosen = P.top_n_per_date(ranked, 5).select("as_of", "symbol", "board", "is_st")
    return P.dropped_holdings(chosen, ranked).select("as_of", "symbol")


@query("equal_weight_signals", with_views(["signals"], f"SELECT trade_date, symbol, {r('least(target_weight, 0.19)')} AS target_weight, board, is_st FROM signals"))
def _(spark, sf):
    return rounded(P.equal_weight_signals(settled(V.rankings(spark, sf)), 5, 0.19))


@query("equal_weight_snapshot", with_views(["rankings"], f"""SELECT as_of AS signal_date, symbol, name, board, rank, {r('1.0 / count(*) OVER ()')} AS target_weight, 'unknown' AS screen_source FROM rankings
    WHERE as_of = (SELECT max(as_of) FROM rankings) AND rank <= 10"""))
def _(spark, sf):
    ranked = settled(V.rankings(spark, sf)).withColumn("composite_score", F.col("amount"))
    last = ranked.agg(F.max("as_of").alias("as_of"))
    day = ranked.join(F.broadcast(last), "as_of").where(F.col("rank") <= 10)
    rows, _ = P.equal_weight_snapshot(day, F.lit("2027-01-01").cast("timestamp"), "market-v1")
    return rounded(rows.select("signal_date", "symbol", "name", "board", "rank", "target_weight", "screen_source"))


@query("weight_cap_check", with_views(["signals"], f"SELECT trade_date, {r('sum(target_weight)')} AS total_weight FROM signals GROUP BY 1 HAVING sum(target_weight) > 0.75 + 1e-7"))
def _(spark, sf):
    return rounded(P.weight_cap_check(settled(V.signals(spark, sf)), 0.75))


_BENT = "SELECT *, CASE WHEN CAST(symbol AS BIGINT) % 7 = 1 THEN target_weight * 6 ELSE target_weight END AS w, CASE WHEN CAST(symbol AS BIGINT) % 9 = 2 THEN 'bond' ELSE 'stock' END AS kind FROM signals"


def _bent_signals(spark, sf):
    k = F.col("symbol").cast("long")
    return settled(V.signals(spark, sf)).withColumns({
        "target_weight": F.when(k % 7 == 1, F.col("target_weight") * 6).otherwise(F.col("target_weight")), "instrument_type": F.when(k % 9 == 2, "bond").otherwise("stock"),
    })


@query("validate_signals", with_views(["signals"], f"SELECT trade_date, symbol, {r('w')} AS target_weight FROM bent WHERE w BETWEEN 0 AND 1 AND kind = 'stock'", {"bent": _BENT}))
def _(spark, sf):
    return rounded(N.validate_signals(_bent_signals(spark, sf)).clean.select("trade_date", "symbol", "target_weight"))


@query("validate_signals_violations", with_views(["signals"], """SELECT 'weight_out_of_range' AS rule, count(*) AS keys FROM bent WHERE w > 1 HAVING count(*) > 0 UNION ALL SELECT 'unsupported_instrument', count(*) FROM bent WHERE kind = 'bond' HAVING count(*) > 0
    UNION ALL SELECT 'weights_above_one', count(*) FROM (SELECT trade_date FROM bent GROUP BY 1 HAVING sum(w) > 1.0000001) HAVING count(*) > 0""", {"bent": _BENT}))
def _(spark, sf):
    return N.validate_signals(_bent_signals(spark, sf)).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


CONFIGS = [
    P.PortfolioRules("calm", rebalance_every=1, minimum_holding=3, entry_rank_max=15, keep_rank_max=30, initial_cash=20000.0),
    P.PortfolioRules("eager", rebalance_every=2, minimum_holding=1, entry_rank_max=40, keep_rank_max=60, max_stock_positions=5, stock_weight_per_position=0.15, initial_cash=100000.0, entry_needs_momentum=False),
    P.PortfolioRules("strict", rebalance_every=5, minimum_holding=5, entry_rank_max=10, keep_rank_max=20, entry_needs_trend=False, keep_needs_trend=False, initial_cash=50000.0),
]
_CFG = ("SELECT * FROM (VALUES " + ", ".join(
    f"('{c.config_id}', {c.rebalance_every}, {c.minimum_holding}, {c.entry_rank_max}, {c.keep_rank_max}, {c.max_stock_positions}, {c.stock_weight_per_position}, {c.ticket}, {c.entry_needs_momentum}, {c.entry_needs_trend}, {c.keep_needs_trend})"
    for c in CONFIGS) + ") v(config_id, every, hold, enter_max, keep_max, slots, weight, ticket, need_mom, need_trend, keep_trend)")

# The selector as a recursive query: one step per rebalance date, the held set as a list.
_WALK = {
    "cfg": _CFG,
    "usable": "SELECT * FROM rankings WHERE rank IS NOT NULL AND close > 0 AND momentum_20 IS NOT NULL AND trend_close_ma20 IS NOT NULL",
    "due": "SELECT config_id, as_of, no, row_number() OVER (PARTITION BY config_id ORDER BY no) AS step FROM (SELECT as_of, row_number() OVER (ORDER BY as_of) - 1 AS no FROM steps) d, cfg WHERE no % every = 0",
    "days": """SELECT d.config_id, d.as_of, d.no, d.step, c.slots, c.hold, c.weight,
        coalesce((SELECT list({'symbol': u.symbol, 'board': u.board, 'is_st': u.is_st, 'entry': d.no} ORDER BY u.rank, u.symbol) FROM usable u WHERE u.as_of = d.as_of AND u.rank <= c.enter_max
            AND (NOT c.need_mom OR u.momentum_20 > 0) AND (NOT c.need_trend OR u.trend_close_ma20 > 0) AND u.close * 100.0 * (1 + 0.002) <= c.ticket), []) AS entries,
        coalesce((SELECT list(u.symbol) FROM usable u WHERE u.as_of = d.as_of AND u.rank <= c.keep_max AND (NOT c.keep_trend OR u.trend_close_ma20 > 0)), []) AS keepers
        FROM due d JOIN cfg c USING (config_id)""",
    "walk": """SELECT config_id, as_of, step, weight, [] :: STRUCT(symbol VARCHAR, board VARCHAR, is_st BOOLEAN, entry BIGINT)[] AS before, entries[1:slots] :: STRUCT(symbol VARCHAR, board VARCHAR, is_st BOOLEAN, entry BIGINT)[] AS held FROM days WHERE step = 1
        UNION ALL SELECT config_id, as_of, step, weight, before, (kept || list_transform(list_filter(entries, lambda e: NOT list_contains(list_transform(kept, lambda k: k.symbol), e.symbol)),
            lambda e: coalesce(list_filter(before, lambda b: b.symbol = e.symbol)[1], e)))[1:slots]
        FROM (SELECT d.*, w.held AS before, list_sort(list_filter(w.held, lambda h: d.no - h.entry < d.hold OR list_contains(d.keepers, h.symbol)))[1:d.slots] AS kept FROM walk w JOIN days d ON d.config_id = w.config_id AND d.step = w.step + 1)""",
    "hold_rows": """SELECT config_id, as_of AS trade_date, h.symbol, weight AS target_weight, h.board, h.is_st, true AS active FROM (SELECT config_id, as_of, weight, unnest(held) AS h FROM walk)
        UNION ALL SELECT config_id, as_of, b.symbol, 0.0, b.board, b.is_st, false FROM (SELECT config_id, as_of, held, unnest(before) AS b FROM walk) WHERE NOT list_contains(list_transform(held, lambda h: h.symbol), b.symbol)""",
}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("hold_buffer_signals", _recursive(with_views(["steps"], f"""SELECT h.config_id, h.trade_date, h.symbol, {r('h.target_weight')} AS target_weight, h.board, h.is_st, CASE WHEN active THEN u.rank END AS source_rank
    FROM hold_rows h LEFT JOIN usable u ON u.as_of = h.trade_date AND u.symbol = h.symbol""", _WALK)))
def _(spark, sf):
    s = P.hold_buffer_signals(settled(V.rankings(spark, sf)), P.config_table(spark, CONFIGS))
    return rounded(s.drop("instrument_type"))


_ETF = {
    "closes": "SELECT symbol, trade_date, close, close / lag(close, 20) OVER w - 1 AS mom, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ma60, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)",
    "asked": "SELECT DISTINCT as_of FROM steps", "names": "SELECT DISTINCT symbol FROM bars",
    "known": "SELECT a.as_of, c.* FROM (SELECT as_of, symbol FROM asked, names) a ASOF JOIN closes c ON a.symbol = c.symbol AND a.as_of >= c.trade_date",
    "fit": "SELECT as_of, symbol, mom, close FROM known WHERE n >= 61 AND mom > 0 AND close > ma60",
    "best": "SELECT as_of, symbol AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mom DESC, symbol) AS rn FROM fit) WHERE rn = 1",
}


@query("etf_snapshot", with_views(["steps", "bars"], f"SELECT as_of, symbol, {r('mom')} AS momentum_20, close FROM fit", _ETF))
def _(spark, sf):
    dates = settled(V.rankings(spark, sf)).select(F.col("as_of").alias("trade_date")).distinct()
    return rounded(P.etf_snapshot(V.bars(spark, sf), dates), exact=("close",))


@query("argmax_per_date", with_views(["steps", "bars"], "SELECT as_of, chosen FROM best", _ETF))
def _(spark, sf):
    dates = settled(V.rankings(spark, sf)).select(F.col("as_of").alias("trade_date")).distinct()
    return P.best_per_date(P.etf_snapshot(V.bars(spark, sf), dates))


_SLEEVE = {
    **_WALK, **_ETF,
    "used": "SELECT config_id, trade_date AS as_of, sum(target_weight) AS w FROM hold_rows WHERE target_weight > 0 GROUP BY 1, 2",
    "wish": """SELECT d.config_id, d.as_of, b.chosen, CASE WHEN b.chosen IS NULL THEN 0 ELSE least(0.40, 0.15 + greatest(0, 0.75 - coalesce(u.w, 0)), greatest(0, 1 - 0.10 - coalesce(u.w, 0))) END AS desired
        FROM due d LEFT JOIN best b USING (as_of) LEFT JOIN used u ON u.config_id = d.config_id AND u.as_of = d.as_of""",
    "sleeve": "SELECT *, lag(CASE WHEN desired > 0 THEN chosen END) OVER (PARTITION BY config_id ORDER BY as_of) AS prior FROM wish",
    "etf_rows": """SELECT config_id, as_of AS trade_date, chosen AS symbol, desired AS target_weight FROM sleeve WHERE chosen IS NOT NULL AND desired > 0
        UNION ALL SELECT config_id, as_of, prior, 0.0 FROM sleeve WHERE prior IS NOT NULL AND (chosen IS NULL OR prior <> chosen)""",
}


@query("etf_rotation", _recursive(with_views(["steps", "bars"], f"SELECT config_id, trade_date, symbol, {r('target_weight')} AS target_weight, 'ETF10' AS board, 'etf' AS instrument_type FROM etf_rows", _SLEEVE)))
def _(spark, sf):
    ranked, configs = settled(V.rankings(spark, sf)), P.config_table(spark, CONFIGS)
    stock = P.hold_buffer_signals(ranked, configs)
    etf = P.etf_rotation(V.bars(spark, sf), P.rebalance_days(ranked, configs), stock, configs)
    return rounded(etf.select("config_id", "trade_date", "symbol", "target_weight", "board", "instrument_type"))


@query("portfolio_sweep", _recursive(with_views(["steps", "bars"], f"""SELECT config_id, trade_date, 'stock' AS instrument_type, symbol, {r('target_weight')} AS target_weight FROM hold_rows
    UNION ALL SELECT config_id, trade_date, 'etf', symbol, {r('target_weight')} FROM etf_rows""", _SLEEVE)))
def _(spark, sf):
    s = P.portfolio_sweep(settled(V.rankings(spark, sf)), V.bars(spark, sf), P.config_table(spark, CONFIGS))
    return rounded(s.select("config_id", "trade_date", "instrument_type", "symbol", "target_weight"))


@query("combine_signals_check", _recursive(with_views(["steps", "bars"], f"""SELECT config_id, trade_date, {r('sum(target_weight)')} AS total_weight FROM (SELECT config_id, trade_date, target_weight FROM hold_rows
    UNION ALL SELECT config_id, trade_date, target_weight FROM etf_rows) GROUP BY 1, 2 HAVING sum(target_weight) > 0.85 + 1e-7""", _SLEEVE)))
def _(spark, sf):
    s = P.portfolio_sweep(settled(V.rankings(spark, sf)), V.bars(spark, sf), P.config_table(spark, CONFIGS))
    return rounded(P.weight_cap_check(s, 0.85, keys=["config_id", "trade_date"]))


@query("entry_gate", with_views(["rankings"], """SELECT as_of, count(*) AS usable, count(*) FILTER (WHERE rank <= 15 AND momentum_20 > 0 AND trend_close_ma20 > 0 AND close * 100.0 * (1 + 0.002) <= 5000) AS may_enter FROM rankings
    WHERE rank IS NOT NULL AND close > 0 AND momentum_20 IS NOT NULL AND trend_close_ma20 IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    ok = (F.col("rank") <= 15) & (F.col("momentum_20") > 0) & (F.col("trend_close_ma20") > 0) & R.affordable_lot(F.col("close"), 5000.0, 0.002)
    return N.validate_rankings(settled(V.rankings(spark, sf))).groupBy("as_of").agg(F.count(F.lit(1)).alias("usable"), F.count_if(ok).alias("may_enter"))


# --- trading rules ----------------------------------------------------------------------------

_DUTY = "CASE WHEN side <> 'sell' THEN 0 WHEN trade_date >= DATE '2023-08-28' THEN 0.0005 WHEN trade_date >= DATE '2008-09-19' THEN 0.001 END"
_COST = f"""SELECT *, round((CASE WHEN instrument_type = 'etf' THEN greatest(notional * 0.00005, 0.5) WHEN notional <= 10000 THEN 5.0 ELSE 5.0 + (notional - 10000) * 0.000086 END) + 1e-12, 2) AS commission,
    round(CASE WHEN instrument_type = 'etf' THEN 0 ELSE notional * {_DUTY} END + 1e-12, 2) AS stamp_duty, round(CASE WHEN instrument_type = 'etf' THEN 0 ELSE notional * 0.00001 END + 1e-12, 2) AS transfer_fee FROM trades"""


def costed_trades(spark, sf):
    t = V.trades(spark, sf)
    costs = R.trade_cost(F.col("notional"), F.col("side"), F.col("trade_date"), F.col("instrument_type"), R.TradingRules.small_account())
    return t.withColumns(costs).withColumn("slippage_cost", F.col("quantity") * 0.01)


@query("trade_cost", with_views(["trades"], f"SELECT l_orderkey, l_linenumber, {r('commission', 2)} AS commission, {r('stamp_duty', 2)} AS stamp_duty, {r('transfer_fee', 2)} AS transfer_fee, {r('commission + stamp_duty + transfer_fee', 2)} AS total_cost FROM costed", {"costed": _COST}))
def _(spark, sf):
    return rounded(costed_trades(spark, sf).select("l_orderkey", "l_linenumber", "commission", "stamp_duty", "transfer_fee", "total_cost"), 2)


@query("effective_dated_rate", with_views(["trades"], f"SELECT trade_date, side, max({_DUTY}) + 0.0 AS stamp_duty_rate, count(*) AS trades FROM trades GROUP BY 1, 2"))
def _(spark, sf):
    t = V.trades(spark, sf).withColumn("rate", R.stamp_duty_rate(F.col("trade_date"), F.col("side")))
    return t.groupBy("trade_date", "side").agg(F.max("rate").alias("stamp_duty_rate"), F.count(F.lit(1)).alias("trades"))


_LIMIT = """CASE WHEN board = '科创板' THEN 0.20 WHEN board = '北交所' THEN 0.30 WHEN board = '创业板' THEN CASE WHEN trade_date >= DATE '2020-08-24' THEN 0.20 ELSE 0.10 END
    WHEN is_st THEN CASE WHEN trade_date >= DATE '2026-07-06' THEN 0.10 ELSE 0.05 END ELSE 0.10 END"""
_BOARDED = "SELECT r.*, l.board, CAST(r.symbol AS BIGINT) % 11 = 3 AS is_st FROM returns r JOIN lifecycle l USING (symbol)"


def _boarded(spark, sf):
    from tidemark.operators.factors import daily_returns

    life = V.lifecycle(spark, sf).select("symbol", "board", (F.col("symbol").cast("long") % 11 == 3).alias("is_st"))
    return daily_returns(V.bars(spark, sf)).join(life, "symbol")


@query("price_limit_pct", with_views(["returns", "lifecycle"], f"SELECT board, is_st, limit_pct, count(*) AS bars, min(trade_date) AS first_day, max(trade_date) AS last_day FROM (SELECT *, CAST({_LIMIT} AS DOUBLE) AS limit_pct FROM boarded) GROUP BY 1, 2, 3", {"boarded": _BOARDED}))
def _(spark, sf):
    b = _boarded(spark, sf).withColumn("limit_pct", R.price_limit_pct(F.col("board"), F.col("is_st"), F.col("trade_date")))
    return b.groupBy("board", "is_st", "limit_pct").agg(F.count(F.lit(1)).alias("bars"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


@query("limit_blocked", with_views(["returns", "lifecycle"], """SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE open >= round(previous_close * (1 + p), 2) - 0.001) AS buy_blocked,
    count(*) FILTER (WHERE open <= round(previous_close * (1 - p), 2) + 0.001) AS sell_blocked FROM (SELECT *, CAST(""" + _LIMIT + """ AS DOUBLE) AS p FROM boarded) WHERE previous_close IS NOT NULL GROUP BY 1""", {"boarded": _BOARDED}))
def _(spark, sf):
    b = _boarded(spark, sf).where(F.col("previous_close").isNotNull()).withColumn("p", R.price_limit_pct(F.col("board"), F.col("is_st"), F.col("trade_date")))
    hit = lambda side: F.count_if(R.limit_blocked(F.lit(side), F.col("open"), F.col("previous_close"), F.col("p")))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), hit("buy").alias("buy_blocked"), hit("sell").alias("sell_blocked"))


@query("fill_price", with_views(["trades"], """SELECT l_orderkey, l_linenumber, notional / quantity * CASE WHEN side = 'buy' THEN 1 + 0.0005 ELSE 1 - 0.0005 END AS price,
    CAST(floor(quantity * 77 / 100) * 100 AS BIGINT) AS lot_shares FROM trades"""))
def _(spark, sf):
    t = V.trades(spark, sf)
    return t.select("l_orderkey", "l_linenumber", R.fill_price(F.col("notional") / F.col("quantity"), F.col("side"), 5.0).alias("price"), R.round_lot(F.col("quantity") * 77).alias("lot_shares"))


# --- fills, valuation, equity -----------------------------------------------------------------

_SIDED = """SELECT *, lead(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS superseded_on FROM (SELECT *, CASE WHEN target_weight > previous_weight THEN 'buy' ELSE 'sell' END AS side FROM (
    SELECT *, coalesce(lag(target_weight) OVER (PARTITION BY portfolio_id, symbol ORDER BY trade_date), 0) AS previous_weight FROM signals)) WHERE target_weight <> previous_weight"""
_FILLED = f"""SELECT s.symbol, s.trade_date AS signal_date, s.side, s.target_weight, s.previous_weight, b.trade_date AS fill_date, b.open, b.prev FROM sided s
    JOIN (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev FROM bars) b ON b.symbol = s.symbol AND b.trade_date > s.trade_date AND b.volume > 0 AND b.prev IS NOT NULL
    WHERE (CASE WHEN s.side = 'buy' THEN b.open < round(b.prev * (1 + lim), 2) - 0.001 ELSE b.open > round(b.prev * (1 - lim), 2) + 0.001 END)
    AND (superseded_on IS NULL OR b.trade_date <= superseded_on) AND b.trade_date - s.trade_date <= 60 QUALIFY row_number() OVER (PARTITION BY s.symbol, s.trade_date ORDER BY b.trade_date) = 1"""
_FILLED = _FILLED.replace("lim)", "(" + _LIMIT.replace("trade_date", "b.trade_date").replace("board", "s.board").replace("is_st", "s.is_st") + "))")
_FILLS = {"sided": _SIDED, "filled": _FILLED}


@query("next_tradable_bar", with_views(["signals", "bars"], "SELECT symbol, signal_date, side, fill_date, open AS raw_open, prev AS previous_close FROM filled", _FILLS))
def _(spark, sf):
    sided = P.signal_sides(settled(V.signals(spark, sf)), ["portfolio_id"]).where(F.col("target_weight") != F.col("previous_weight"))
    got = J.next_tradable_bar(sided, V.bars(spark, sf), max_wait_days=60, keys=["portfolio_id"]).where(F.col("fill_date").isNotNull())
    return got.select("symbol", F.col("trade_date").alias("signal_date"), "side", "fill_date", "raw_open", "previous_close")


_SCEN = "(VALUES ('a5', 5.0), ('b10', 10.0), ('c20', 20.0)) v(scenario_id, bps)"
_SIZED = f"""SELECT *, shares * price AS notional FROM (SELECT *, CAST(floor(abs(target_weight - previous_weight) * 10000000 / price / 100) * 100 AS BIGINT) AS shares FROM (
    SELECT f.*, scenario_id, open * CASE WHEN side = 'buy' THEN 1 + bps / 10000 ELSE 1 - bps / 10000 END AS price FROM filled f, {_SCEN})) WHERE shares > 0"""


@query("signal_fills", with_views(["signals", "bars"], f"""SELECT scenario_id, symbol, signal_date, fill_date AS trade_date, side, shares, price, notional, {r('round(greatest(notional * 0.0003, 5.0) + 1e-12, 2)', 2)} AS commission,
    {r("round(CASE WHEN side = 'sell' THEN notional * CASE WHEN fill_date >= DATE '2023-08-28' THEN 0.0005 ELSE 0.001 END ELSE 0 END + 1e-12, 2)", 2)} AS stamp_duty, abs(price - open) * shares AS slippage_cost, CAST(fill_date - signal_date AS INTEGER) AS days_waited FROM sized""",
    {**_FILLS, "sized": _SIZED}))
def _(spark, sf):
    f = P.signal_fills(settled(V.signals(spark, sf)), V.bars(spark, sf), 10_000_000.0, scenarios={"a5": 5.0, "b10": 10.0, "c20": 20.0}, max_wait_days=60, keys=["portfolio_id"])
    return rounded(f.select("scenario_id", "symbol", "signal_date", "trade_date", "side", "shares", "price", "notional", "commission", "stamp_duty", "slippage_cost", "days_waited"), 2, exact=("price", "notional", "slippage_cost"))


@query("mark_to_market", with_views(["signals", "bars"], f"""SELECT portfolio_id, p.trade_date, {r('coalesce(sum(shares * b.close), 0)', 2)} AS market_value FROM (SELECT portfolio_id, trade_date, symbol, CAST(100 + CAST(symbol AS BIGINT) % 5 AS DOUBLE) AS shares FROM signals) p
    ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.trade_date >= b.trade_date GROUP BY 1, 2"""))
def _(spark, sf):
    held = settled(V.signals(spark, sf)).select("portfolio_id", "trade_date", "symbol", (100 + F.col("symbol").cast("long") % 5).cast("double").alias("shares"))
    return rounded(J.mark_to_market(held, V.bars(spark, sf)), 2)


_TWE = {
    "marks": "SELECT portfolio_id, trade_date AS s, lead(trade_date) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT portfolio_id, trade_date FROM signals)",
    "market": "SELECT DISTINCT trade_date FROM bars",
    "pdays": "SELECT m.portfolio_id, m.s, d.trade_date FROM marks m JOIN market d ON d.trade_date > m.s AND (m.nxt IS NULL OR d.trade_date <= m.nxt)",
    "act": "SELECT portfolio_id, trade_date AS s, symbol, target_weight AS w FROM signals WHERE target_weight > 0",
    "ent": "SELECT a.*, b.close AS entry FROM act a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.s >= b.trade_date",
    "held": "SELECT p.*, e.symbol, e.w, e.entry FROM pdays p JOIN ent e USING (portfolio_id, s)",
    "mk": "SELECT h.*, b.close AS mark FROM held h ASOF LEFT JOIN bars b ON h.symbol = b.symbol AND h.trade_date >= b.trade_date",
    "grow": "SELECT p.portfolio_id, p.s, p.trade_date, 1 + coalesce(sum(w * (coalesce(mark / entry, 1) - 1)), 0) AS g FROM pdays p LEFT JOIN mk USING (portfolio_id, s, trade_date) GROUP BY 1, 2, 3",
    "whole": "SELECT portfolio_id, s, arg_max(g, trade_date) AS g FROM grow GROUP BY 1, 2",
    "chain": "SELECT portfolio_id, s, exp(sum(ln(g)) OVER (PARTITION BY portfolio_id ORDER BY s) - ln(g)) AS base FROM whole",
}


@query("target_weight_equity", with_views(["signals", "bars"], f"SELECT portfolio_id, trade_date, {r('ln(base * g)', 6)} AS log_equity FROM grow JOIN chain USING (portfolio_id, s)", _TWE))
def _(spark, sf):
    # The test prices jump by factors, so the compounded equity is shown as its logarithm.
    e = P.target_weight_equity(settled(V.signals(spark, sf)), V.bars(spark, sf))
    return rounded(e.select("portfolio_id", "trade_date", F.log("equity").alias("log_equity")))


@query("weight_turnover", with_views(["signals"], f"""SELECT portfolio_id, trade_date AS signal_date, {r('sum(abs(target_weight - previous_weight))')} AS turnover FROM (SELECT *, coalesce(lag(target_weight) OVER (PARTITION BY symbol ORDER BY trade_date), 0) AS previous_weight FROM signals) GROUP BY 1, 2"""))
def _(spark, sf):
    return rounded(P.weight_turnover(settled(V.signals(spark, sf)), ["portfolio_id"]))


# --- performance ------------------------------------------------------------------------------

_DD = "SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date) - 1 AS dd FROM equity WINDOW w AS (PARTITION BY portfolio_id ORDER BY trade_date)"


@query("normalize_series", with_views(["equity"], "SELECT portfolio_id, trade_date, equity, equity / lag(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date) - 1 AS daily_return FROM equity"))
def _(spark, sf):
    return N.normalize_series(V.equity(spark, sf), "equity", ["portfolio_id"], "equity")


@query("returns_drawdown", with_views(["equity"], "SELECT portfolio_id, trade_date, r AS daily_return, dd AS drawdown FROM dds", {"dds": _DD}))
def _(spark, sf):
    return Q.returns_drawdown(V.equity(spark, sf)).select("portfolio_id", "trade_date", "daily_return", "drawdown")


@query("performance_summary", with_views(["equity"], f"""SELECT portfolio_id, {r('l / f - 1')} AS total_return, {r('pow(l / f, 365.25 / greatest(days, 1)) - 1')} AS annualized_return, {r('sd * sqrt(252.0)')} AS annualized_volatility, {r('mdd')} AS max_drawdown, {r('m / sd * sqrt(252.0)')} AS sharpe
    FROM (SELECT portfolio_id, arg_min(equity, trade_date) AS f, arg_max(equity, trade_date) AS l, max(trade_date) - min(trade_date) AS days, min(dd) AS mdd, avg(r) AS m, stddev_samp(r) AS sd FROM dds GROUP BY 1)""", {"dds": _DD}))
def _(spark, sf):
    return rounded(Q.performance_summary(V.equity(spark, sf)))


@query("trade_statistics", with_views(["equity", "trades"], f"""SELECT portfolio_id, count(*) AS trade_count, count(*) FILTER (WHERE side = 'buy') AS buy_count, count(*) FILTER (WHERE side = 'sell') AS sell_count, {r('sum(notional)', 1)} AS gross_traded_notional,
    {r('sum(notional) / any_value(m)', 5)} AS turnover, {r('sum(commission)', 2)} AS commission, {r('sum(stamp_duty)', 2)} AS stamp_duty, {r('sum(commission) + sum(stamp_duty)', 2)} AS total_cost FROM costed JOIN (SELECT portfolio_id, avg(equity) AS m FROM equity GROUP BY 1) USING (portfolio_id) GROUP BY 1""", {"costed": _COST}))
def _(spark, sf):
    s = Q.trade_statistics(V.equity(spark, sf), costed_trades(spark, sf))
    return rounded(s.withColumns({"gross_traded_notional": F.round("gross_traded_notional", 1), "turnover": F.round("turnover", 5), **{c: F.round(c, 2) for c in ("commission", "stamp_duty", "total_cost")}}))


_CMP = """SELECT portfolio_id, trade_date, equity / first_value(equity) OVER w AS portfolio_index, close / first_value(close) OVER w AS benchmark_index FROM equity JOIN index_series USING (trade_date) WINDOW w AS (PARTITION BY portfolio_id ORDER BY trade_date)"""


@query("benchmark_comparison", with_views(["equity", "index_series"], "SELECT portfolio_id, trade_date, portfolio_index, benchmark_index, portfolio_index / benchmark_index AS excess_index FROM cmp", {"cmp": _CMP}))
def _(spark, sf):
    return Q.benchmark_comparison(V.equity(spark, sf), V.benchmark(spark, sf)).select("portfolio_id", "trade_date", "portfolio_index", "benchmark_index", "excess_index")


@query("benchmark_returns", with_views(["equity", "index_series"], f"SELECT portfolio_id, count(*) AS aligned_dates, {r('arg_max(portfolio_index, trade_date) - 1')} AS portfolio_return, {r('arg_max(benchmark_index, trade_date) - 1')} AS benchmark_return, {r('arg_max(portfolio_index / benchmark_index, trade_date) - 1')} AS excess_return FROM cmp GROUP BY 1", {"cmp": _CMP}))
def _(spark, sf):
    return rounded(Q.benchmark_returns(Q.benchmark_comparison(V.equity(spark, sf), V.benchmark(spark, sf))))


_BLOCKS = {
    "costed": _COST,
    "er": "SELECT *, equity / lag(equity) OVER w - 1 AS r, lag(equity) OVER w AS before FROM equity WINDOW w AS (PARTITION BY portfolio_id ORDER BY trade_date)",
    "br": "SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS b FROM index_series",
    "nb": "SELECT e.*, b.b, CAST(floor((row_number() OVER (PARTITION BY portfolio_id ORDER BY e.trade_date) - 1) / 20) + 1 AS INTEGER) AS block FROM er e LEFT JOIN br b USING (trade_date) WHERE r IS NOT NULL",
    "wl": "SELECT *, exp(sum(ln(1 + r)) OVER w) AS wealth FROM nb WINDOW w AS (PARTITION BY portfolio_id, block ORDER BY trade_date)",
    "dw": "SELECT *, wealth / max(wealth) OVER (PARTITION BY portfolio_id, block ORDER BY trade_date) - 1 AS dd FROM wl",
    "bk": """SELECT portfolio_id, block, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS trading_days, product(1 + r) - 1 AS ret, CASE WHEN count(b) = 20 THEN product(1 + b) - 1 END AS bench, min(dd) AS mdd,
        avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS pos, arg_min(before, trade_date) AS base FROM dw GROUP BY 1, 2 HAVING count(*) = 20""",
    "blocks": """SELECT k.portfolio_id, k.block, any_value(start_date) AS start_date, any_value(end_date) AS end_date, any_value(ret) AS ret, any_value(bench) AS bench, any_value(mdd) AS mdd, any_value(pos) AS pos, any_value(base) AS base,
        count(t.notional) AS n, coalesce(sum(t.notional), 0) AS notional, coalesce(sum(commission + stamp_duty + transfer_fee), 0) AS explicit, coalesce(sum(quantity * 0.01), 0) AS slip
        FROM bk k LEFT JOIN costed t ON t.portfolio_id = k.portfolio_id AND t.trade_date BETWEEN k.start_date AND k.end_date GROUP BY 1, 2""",
}


def _blocks(spark, sf):
    return Q.rolling_blocks(V.equity(spark, sf), costed_trades(spark, sf), V.benchmark(spark, sf))


@query("rolling_blocks", with_views(["equity", "index_series", "trades"], f"""SELECT portfolio_id, block, start_date, end_date, {r('ret')} AS "return", {r('bench')} AS benchmark_return, {r('ret - bench')} AS excess_return, {r('mdd')} AS max_drawdown, {r('pos')} AS positive_day_rate, n AS trade_count,
    {r('notional / base')} AS turnover, {r('explicit', 2)} AS explicit_cost, {r('slip', 2)} AS slippage_cost, {r('(explicit + slip) / base')} AS cost_drag FROM blocks""", _BLOCKS))
def _(spark, sf):
    b = _blocks(spark, sf).drop("trading_days")
    return rounded(b.withColumns({"explicit_cost": F.round("explicit_cost", 2), "slippage_cost": F.round("slippage_cost", 2)}))


_SUMMARY = """SELECT portfolio_id, count(*) AS block_count, median(ret) AS median_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_block_rate, median(mdd) AS median_max_drawdown, median(notional / base) AS median_turnover, median((explicit + slip) / base) AS median_cost_drag,
    avg(CASE WHEN bench IS NOT NULL THEN CASE WHEN ret > bench THEN 1.0 ELSE 0.0 END END) AS benchmark_outperformance_rate, median(ret - bench) AS median_excess_return, min(ret) AS worst_block_return, max(ret) AS best_block_return,
    product(CASE WHEN rn > 1 THEN 1 + ret ELSE 1 END) - 1 AS return_excluding_best_block, CASE WHEN sum(ln(1 + ret)) > 0 THEN sum(CASE WHEN rn <= 1 THEN ln(1 + ret) END) / sum(ln(1 + ret)) END AS top_1_log_return_share,
    CASE WHEN sum(ln(1 + ret)) > 0 THEN sum(CASE WHEN rn <= 2 THEN ln(1 + ret) END) / sum(ln(1 + ret)) END AS top_2_log_return_share
    FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY ret DESC, block) AS rn FROM blocks) GROUP BY 1"""
_SUM_COLS = ["median_return", "positive_block_rate", "median_max_drawdown", "median_turnover", "median_cost_drag", "benchmark_outperformance_rate", "median_excess_return", "worst_block_return", "best_block_return", "return_excluding_best_block", "top_1_log_return_share", "top_2_log_return_share"]
_GATE = "coalesce(block_count >= 12 AND positive_block_rate >= 0.5 AND median_max_drawdown > -0.08 AND median_turnover <= 2 AND median_cost_drag <= 0.01 AND benchmark_outperformance_rate >= 0.55 AND median_excess_return > 0, false)"


@query("rolling_summary", with_views(["equity", "index_series", "trades"], f"SELECT portfolio_id, block_count, {', '.join(f'{r(c, 5)} AS {c}' for c in _SUM_COLS)}, {_GATE} AS development_gate_passed FROM summary", {**_BLOCKS, "summary": _SUMMARY}))
def _(spark, sf):
    return rounded(Q.rolling_summary(_blocks(spark, sf)), 5)


@query("shadow_metrics", with_views(["signals", "bars"], f"""SELECT portfolio_id, observed_return_days, {r('win')} AS daily_win_rate, {r('ln(latest)')} AS log_equity, latest_trade_date, signal_dates, signal_rows, distinct_symbols, trade_count,
    CASE WHEN observed_return_days < 20 THEN 'collecting' WHEN observed_return_days < 60 THEN 'first_review' ELSE 'rolling_validation' END AS validation_phase FROM
    (SELECT portfolio_id, count(r) AS observed_return_days, avg(CASE WHEN r > 1e-9 THEN 1.0 WHEN r <= 1e-9 THEN 0.0 END) AS win, arg_max(equity, trade_date) AS latest, max(trade_date) AS latest_trade_date FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date) - 1 AS r FROM eq) GROUP BY 1)
    JOIN (SELECT portfolio_id, count(DISTINCT trade_date) AS signal_dates, count(*) AS signal_rows, count(DISTINCT symbol) AS distinct_symbols FROM signals GROUP BY 1) USING (portfolio_id), (SELECT count(*) AS trade_count FROM filled)""",
    {**_TWE, **_FILLS, "eq": "SELECT portfolio_id, trade_date, base * g AS equity FROM grow JOIN chain USING (portfolio_id, s)"}))
def _(spark, sf):
    s, b = settled(V.signals(spark, sf)), V.bars(spark, sf)
    fills = P.signal_fills(s, b, 1e9, max_wait_days=60, keys=["portfolio_id"])
    m = Q.shadow_metrics(s, P.target_weight_equity(s, b), fills)
    return rounded(m.withColumn("log_equity", F.log("latest_equity")).drop("latest_equity"))


@query("portfolio_metrics", with_views(["rankings", "signals", "equity"], f"""SELECT s.portfolio_id, rebalance_dates, observed_return_days, {r('win')} AS daily_win_rate, (SELECT count(DISTINCT as_of) FROM rankings) AS ranking_dates, (SELECT max(as_of) FROM rankings) AS latest_ranking_date
    FROM (SELECT 'P1' AS portfolio_id, count(DISTINCT trade_date) AS rebalance_dates FROM signals) s LEFT JOIN (SELECT portfolio_id, count(r) AS observed_return_days, avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END) AS win FROM dds GROUP BY 1) USING (portfolio_id)""", {"dds": _DD}))
def _(spark, sf):
    s = settled(V.signals(spark, sf)).withColumn("portfolio_id", F.lit("P1"))
    return rounded(Q.portfolio_metrics(settled(V.rankings(spark, sf)), s, V.equity(spark, sf), ["portfolio_id"]))


def _bias_side(spark, sf, strict):
    sums = Q.rolling_summary(_blocks(spark, sf)).join(Q.performance_summary(V.equity(spark, sf)), "portfolio_id")
    other = F.when(F.col("portfolio_id") == "P2", "2020-01-02").otherwise("2020-01-01")
    out = sums.withColumns({"strategy_version": F.col("portfolio_id"), "status": F.lit("complete"), "strict_point_in_time_universe": F.lit(True), "end": F.lit("2026-11-03"),
                            "start": F.lit("2020-01-01") if strict else other})
    return out if strict else out.withColumn("total_return", F.col("total_return") * 2)


@query("bias_comparison", with_views(["equity"], f"""SELECT portfolio_id AS strategy_version, {r('t')} AS strict_total_return, {r('2 * t')} AS current_total_return, {r('t - 2 * t')} AS strict_minus_current_return FROM (
    SELECT portfolio_id, arg_max(equity, trade_date) / arg_min(equity, trade_date) - 1 AS t FROM equity GROUP BY 1) WHERE portfolio_id <> 'P2'"""))
def _(spark, sf):
    ok, _ = Q.bias_comparison(_bias_side(spark, sf, True), _bias_side(spark, sf, False))
    return rounded(ok.select("strategy_version", "strict_total_return", "current_total_return", "strict_minus_current_return"))
