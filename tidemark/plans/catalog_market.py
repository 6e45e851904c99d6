"""Queries over bars, factors, cross-sections and universes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.labels import after_close_gate, data_quality_label, gate_open
from tidemark.functions.rules import affordable_lot
from tidemark.functions.symbols import (
    contains_st, extract_symbol, hash_shard, infer_board, infer_exchange, is_a_share_code, market_code, pad_symbol, parse_flag,
)
from tidemark.operators import factors as W
from tidemark.operators import normalize as N
from tidemark.operators import universe as U
from tidemark.operators.crosssection import winsorized_zscores
from tidemark.plans.oracle_views import FACTOR_SQL, V1, V2, scored, with_views
from tidemark.plans.registry import query, r, rounded
from tidemark.sources import tables as IO
from tidemark.sources import views as V
from tidemark.sources.scratch import settled

MIN_AMOUNT = 35000.0
# Two engines add in different orders: for the comparison, scores equal to nine digits tie in both.
CHECKED_V1, CHECKED_V2 = (replace(c, score_digits=9) for c in (W.CONFIG_V1, W.CONFIG_V2))
GATES = {"min_average_amount": MIN_AMOUNT}
_ELIGIBLE = f"bar_no >= 61 AND average_amount_20 >= {MIN_AMOUNT}"

# --- bars: validation and normalising ---------------------------------------------------------

_RAW = """raw AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) + 9131 AS trade_date,
    CASE WHEN l_discount = 0.10 THEN NULL WHEN l_discount = 0.09 THEN 0 ELSE l_extendedprice / l_quantity END AS close, l_quantity AS volume FROM lineitem)"""


@query("validate_bars", f"""WITH {_RAW} SELECT symbol, trade_date, any_value(close) AS close, any_value(volume) AS volume FROM raw
    WHERE close > 0 GROUP BY 1, 2 HAVING count(*) = 1""")
def _(spark, sf):
    return W.validate_bars(V.raw_bars(spark, sf)).clean.select("symbol", "trade_date", "close", "volume")


@query("validate_bars_violations", f"""WITH {_RAW} SELECT 'close_missing' AS rule, count(*) AS keys, count(*) AS rows FROM raw WHERE close IS NULL
    UNION ALL SELECT 'price_not_positive', count(*), count(*) FROM raw WHERE close <= 0
    UNION ALL SELECT 'duplicate_key', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, trade_date HAVING count(*) > 1)""")
def _(spark, sf):
    bad = W.validate_bars(V.raw_bars(spark, sf)).violations
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows"))


@query("normalize_bars_cn", with_views(["bars"], f"SELECT symbol, trade_date, open, close, amount FROM bars"))
def _(spark, sf):
    back = {v: k for k, v in N.BAR_HEADERS.items()}
    raw = V.bars(spark, sf).withColumnsRenamed(back)
    return N.normalize_bars_cn(raw).select("symbol", "trade_date", "open", "close", "amount")


@query("normalize_bars_derived", with_views(["bars"], f"""SELECT symbol, trade_date, close, close - lag(close) OVER w AS change,
    (close - lag(close) OVER w) / lag(close) OVER w * 100 AS change_pct, (high - low) / lag(close) OVER w * 100 AS amplitude_pct,
    volume / 1000 * 100 AS turnover_pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"""))
def _(spark, sf):
    raw = V.bars(spark, sf).select("symbol", F.col("trade_date").alias("date"), "open", "high", "low", "close", "volume", "amount", (F.col("volume") / 1000).alias("turnover"))
    return N.normalize_bars_derived(raw).select("symbol", "trade_date", "close", "change", "change_pct", "amplitude_pct", "turnover_pct")


@query("normalize_benchmark", with_views(["index_series"], "SELECT trade_date, close FROM index_series"))
def _(spark, sf):
    return N.normalize_benchmark(V.benchmark(spark, sf).withColumnsRenamed({"trade_date": "日期", "close": "收盘"})).clean


@query("merge_bars", with_views(["bars"], f"""SELECT symbol, trade_date, CASE WHEN CAST(trade_date - DATE '2020-01-01' AS INTEGER) % 3 = 0 THEN close * 2 ELSE close END AS close FROM bars"""))
def _(spark, sf):
    stored = V.bars(spark, sf)
    third = F.datediff("trade_date", F.lit("2020-01-01").cast("date")) % 3 == 0
    incoming = stored.where(third).withColumn("close", F.col("close") * 2)
    return IO.merge_bars(stored, incoming).select("symbol", "trade_date", "close")


_SPOT_RAW = """coded AS (SELECT (CASE o_custkey % 5 WHEN 0 THEN 'sh600' WHEN 1 THEN 'sz000' WHEN 2 THEN 'sz300' WHEN 3 THEN 'bj830' ELSE 'x' END) || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS code,
    (CASE WHEN o_custkey % 7 = 0 THEN '*ST' ELSE 'N' END) || CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000 END AS last,
    o_totalprice AS amount, o_orderkey AS seq FROM orders),
    snap AS (SELECT * FROM (SELECT regexp_extract(code, '([0-9]{6})$', 1) AS symbol, name, last, amount, row_number() OVER (PARTITION BY regexp_extract(code, '([0-9]{6})$', 1) ORDER BY seq DESC) AS rn
        FROM coded WHERE regexp_matches(code, '[0-9]{6}$')) WHERE rn = 1 AND last > 0 AND amount >= 0)"""


@query("normalize_spot", f"WITH {_SPOT_RAW} SELECT symbol, name, {r('last')} AS last, {r('amount')} AS amount FROM snap")
def _(spark, sf):
    return rounded(N.normalize_spot(V.order_codes(spark, sf), layout="short", order="seq").select("symbol", "name", "last", "amount"))


@query("normalize_master", """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, (CASE WHEN s_acctbal < 0 THEN 'st' ELSE '' END) || s_name AS name, 'SZSE' AS exchange, 'B' || CAST(s_nationkey AS VARCHAR) AS board,
    DATE '2019-06-01' + CAST(s_suppkey % 900 AS INTEGER) AS list_date, round(s_acctbal, 2) + 0.0 AS total_shares, s_acctbal < 0 AS is_st FROM supplier""")
def _(spark, sf):
    raw = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("A股代码"), F.concat(F.when(F.col("s_acctbal") < 0, "st").otherwise(""), F.col("s_name")).alias("A股简称"),
        F.concat(F.lit("B"), F.col("s_nationkey").cast("string")).alias("板块"), F.date_add(F.lit("2019-06-01").cast("date"), (F.col("s_suppkey") % 900).cast("int")).cast("string").alias("A股上市日期"),
        F.col("s_acctbal").cast("string").alias("A股总股本"),
    )
    clean = N.validate_master(N.normalize_master(raw, "SZSE", F.lit("2027-01-01").cast("timestamp"))).clean
    return rounded(clean.select("symbol", "name", "exchange", "board", "list_date", "total_shares", "is_st"), 2)


# --- code and flag expressions ---------------------------------------------------------------


@query("market_code", """SELECT c_custkey, 'sh' || code AS index_code, CASE WHEN left(code, 1) IN ('5','6') THEN 'sh' || code WHEN left(code, 1) IN ('0','1','2','3') THEN 'sz' || code END AS plain,
    CASE WHEN left(code, 1) = '6' THEN 'sh.' || code WHEN left(code, 1) IN ('0','3') THEN 'sz.' || code END AS dotted
    FROM (SELECT c_custkey, CAST((c_custkey * 7919) % 10 AS VARCHAR) || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS code FROM customer) WHERE NOT (code LIKE '399%' OR code LIKE '899%')
    UNION ALL SELECT c_custkey, CASE WHEN code LIKE '399%' THEN 'sz' ELSE 'bj' END || code, CASE WHEN left(code, 1) = '3' THEN 'sz' || code END, CASE WHEN left(code, 1) = '3' THEN 'sz.' || code END
    FROM (SELECT c_custkey, CAST((c_custkey * 7919) % 10 AS VARCHAR) || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS code FROM customer) WHERE code LIKE '399%' OR code LIKE '899%'""")
def _(spark, sf):
    c = _customer_codes(spark, sf)
    return c.select("c_custkey", market_code(F.col("code"), "index").alias("index_code"), market_code(F.col("code")).alias("plain"), market_code(F.col("code"), "dotted").alias("dotted"))


def _customer_codes(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.concat(((k * 7919) % 10).cast("string"), F.lpad((k % 100000).cast("string"), 5, "0")).alias("code"))


_CUST = "(SELECT c_custkey, c_name, c_acctbal, CAST((c_custkey * 7919) % 10 AS VARCHAR) || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS code FROM customer)"


@query("infer_exchange_board", f"""SELECT c_custkey, exchange, CASE exchange WHEN 'SSE' THEN CASE WHEN left(code, 3) IN ('688','689') THEN '科创板' ELSE '上证主板' END
    WHEN 'SZSE' THEN CASE WHEN left(code, 3) IN ('300','301') THEN '创业板' ELSE '深证主板' END ELSE '北交所' END AS board
    FROM (SELECT *, CASE WHEN left(code, 1) = '6' THEN 'SSE' WHEN left(code, 1) IN ('0','3') THEN 'SZSE' WHEN left(code, 1) IN ('4','8','9') THEN 'BSE' END AS exchange FROM {_CUST})""")
def _(spark, sf):
    c = _customer_codes(spark, sf).withColumn("exchange", infer_exchange(F.col("code")))
    return c.select("c_custkey", "exchange", infer_board(F.col("code"), F.col("exchange")).alias("board"))


@query("filter_a_share_codes", f"""SELECT dotted FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'sh.' ELSE 'sz.' END || code AS dotted FROM {_CUST})
    WHERE regexp_full_match(dotted, 'sh\\.6[0-9]{{5}}') OR regexp_full_match(dotted, 'sz\\.(00[0-3]|30[01])[0-9]{{3}}')""")
def _(spark, sf):
    c = _customer_codes(spark, sf).select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "sh.").otherwise("sz."), F.col("code")).alias("dotted"))
    return c.where(is_a_share_code(F.col("dotted")))


@query("parse_flag", """SELECT event_type, count(*) AS rows, count(f) AS parsed, count(*) FILTER (WHERE f) AS true_rows FROM (
    SELECT event_type, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS f FROM events) GROUP BY 1""")
def _(spark, sf):
    raw = F.element_at(F.array(*[F.lit(v) for v in (" True", "1", "FALSE ", "0", "yes", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    e = V.table(spark, sf, "events").withColumn("f", parse_flag(raw))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count("f").alias("parsed"), F.count_if("f").alias("true_rows"))


@query("pad_symbol", """SELECT c_custkey, CASE WHEN length(CAST(c_custkey * 997 AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey * 997 AS VARCHAR), 6, '0') ELSE CAST(c_custkey * 997 AS VARCHAR) END AS symbol,
    nullif(regexp_extract(c_name, '([0-9]{6})', 1), '') AS extracted, contains(upper(c_mktsegment), 'ST') AS has_st FROM customer""")
def _(spark, sf):
    return V.table(spark, sf, "customer").select(
        "c_custkey", pad_symbol(F.col("c_custkey") * 997).alias("symbol"), extract_symbol(F.col("c_name")).alias("extracted"), contains_st(F.col("c_mktsegment")).alias("has_st"))


@query("hash_shard", """SELECT symbol, CAST(CAST('0x' || substr(sha256(symbol), 1, 16) AS HUGEINT) % 32 AS INTEGER) AS shard FROM (
    SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS symbol FROM customer)""")
def _(spark, sf):
    return V.table(spark, sf, "customer").select(pad_symbol(F.col("c_custkey")).alias("symbol")).withColumn("shard", hash_shard(F.col("symbol"), 32))


@query("after_close_gate", """SELECT event_id, CASE WHEN isodow(d) > 5 THEN 'non_weekday_signal' WHEN l < d + INTERVAL '15 hours 10 minutes' THEN 'before_signal_close_or_future_signal'
    WHEN l >= d + INTERVAL '1 day 9 hours 15 minutes' THEN 'expired_before_preopen' WHEN CAST(l AS DATE) = d THEN 'eligible_after_close' ELSE 'eligible_overnight' END AS reason
    FROM (SELECT event_id, ts + INTERVAL '8 hours' AS l, CAST(ts AS DATE) - CAST(event_id % 2 AS INTEGER) AS d FROM events)""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.date_sub(F.to_date("ts"), (F.col("event_id") % 2).cast("int")).alias("d"))
    return e.select("event_id", after_close_gate(F.col("d"), F.col("ts")).alias("reason"))


@query("after_close_admitted", """SELECT count(*) AS rows, count(*) FILTER (WHERE isodow(d) <= 5 AND l >= d + INTERVAL '15 hours 10 minutes' AND l < d + INTERVAL '1 day 9 hours 15 minutes') AS admitted
    FROM (SELECT ts + INTERVAL '8 hours' AS l, CAST(ts AS DATE) AS d FROM events)""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select(after_close_gate(F.to_date("ts"), F.col("ts").cast("timestamp")).alias("reason"))
    return e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(gate_open(F.col("reason"))).alias("admitted"))


@query("data_quality_label", """SELECT doc_id, CASE WHEN m = 'degraded_current_universe' OR starts_with(s, 'bootstrap_') OR starts_with(s, 'candidate_cache_') OR starts_with(s, 'history_liquidity_') THEN 'degraded' ELSE 'normal' END AS label
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bootstrap_spot' WHEN 1 THEN 'candidate_cache_x' WHEN 2 THEN 'spot_amount' WHEN 3 THEN 'history_liquidity_y' ELSE '' END AS s,
    CASE WHEN doc_id % 4 = 0 THEN 'degraded_current_universe' ELSE source END AS m FROM documents)""")
def _(spark, sf):
    k = F.col("doc_id")
    s = F.when(k % 5 == 0, "bootstrap_spot").when(k % 5 == 1, "candidate_cache_x").when(k % 5 == 2, "spot_amount").when(k % 5 == 3, "history_liquidity_y").otherwise("")
    m = F.when(k % 4 == 0, "degraded_current_universe").otherwise(F.col("source"))
    return V.table(spark, sf, "documents").select("doc_id", data_quality_label(s, m).alias("label"))


# --- factors ----------------------------------------------------------------------------------


def _factor_query(name, sql_cols, columns, build):
    sql = with_views(["returns"], f"SELECT symbol, trade_date, {sql_cols} FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), "
                     "w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")

    @query(name, sql)
    def _(spark, sf):
        exact = ("previous_close", "daily_return")
        return rounded(build(W.daily_returns(V.bars(spark, sf)), W.by_symbol()).select("symbol", "trade_date", *columns), exact=exact)


_factor_query("momentum", f"{r('close / lag(close, 20) OVER w - 1')} AS momentum_20, {r('close / lag(close, 60) OVER w - 1')} AS momentum_60", ["momentum_20", "momentum_60"],
              lambda df, w: df.withColumns({"momentum_20": W.momentum(w, 20), "momentum_60": W.momentum(w, 60)}))
_factor_query("ma_trend", f"{r('CASE WHEN bar_no >= 60 THEN avg(close) OVER w20 / avg(close) OVER w60 - 1 END')} AS trend_ma20_ma60, {r('CASE WHEN bar_no >= 20 THEN close / avg(close) OVER w20 - 1 END')} AS trend_close_ma20",
              ["trend_ma20_ma60", "trend_close_ma20"],
              lambda df, w: df.withColumns({"trend_ma20_ma60": W.moving_average(w, 20) / W.moving_average(w, 60) - 1.0, "trend_close_ma20": F.col("close") / W.moving_average(w, 20) - 1.0}))
_factor_query("realized_vol", f"{r('CASE WHEN count(r) OVER w20 = 20 THEN stddev_pop(r) OVER w20 * sqrt(252.0) END', 5)} AS volatility_20", ["volatility_20"],
              lambda df, w: df.withColumn("volatility_20", F.round(W._REGISTRY["volatility_20"](w), 5)))
_factor_query("log_liquidity", f"{r('ln(1 + avg(amount) OVER w20)')} AS log_amount_20", ["log_amount_20"], lambda df, w: df.withColumn("log_amount_20", W._REGISTRY["log_amount_20"](w)))
_factor_query("previous_bar", "previous_close, r AS daily_return", ["previous_close", "daily_return"], lambda df, w: df)


@query("rolling_max_drawdown", with_views(["drawdowns"], f"SELECT symbol, trade_date, {r('max_drawdown_60')} AS max_drawdown_60 FROM drawdowns WHERE max_drawdown_60 IS NOT NULL"))
def _(spark, sf):
    dd = W.rolling_drawdown(V.bars(spark, sf)).withColumn("n", F.row_number().over(W.by_symbol())).where(F.col("n") >= 60)
    return rounded(dd.select("symbol", "trade_date", "max_drawdown_60"))


_PANEL_COLS = ["momentum_20", "momentum_60", "trend_ma20_ma60", "trend_close_ma20", "volatility_20", "max_drawdown_60", "log_amount_20"]
_PANEL_SQL = ", ".join(f"{r(c, 5)} AS {c}" for c in _PANEL_COLS)


@query("market_factors", with_views(["panel"], f"""SELECT symbol, trade_date AS as_of, close, {r('average_amount_20', 4)} AS average_amount_20, {_PANEL_SQL}
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM panel) WHERE rn = 1 AND {_ELIGIBLE}"""))
def _(spark, sf):
    m = W.market_factors(V.bars(spark, sf), **GATES)
    return rounded(m.withColumn("average_amount_20", F.round("average_amount_20", 4)), 5, exact=("close",))


@query("factor_panel", with_views(["panel"], f"SELECT symbol, trade_date, {_PANEL_SQL} FROM panel WHERE {_ELIGIBLE}"))
def _(spark, sf):
    p = W.factor_panel(V.bars(spark, sf), **GATES).where(F.col("reason") == "eligible")
    return rounded(p.select("symbol", "trade_date", *_PANEL_COLS), 5)


_SINCE = "2023-03-01"


@query("factor_panel_extended", with_views(["panel"], f"SELECT symbol, trade_date, bar_no, {_PANEL_SQL} FROM panel WHERE {_ELIGIBLE} AND trade_date >= DATE '{_SINCE}'"))
def _(spark, sf):
    """Rows of later days made from each symbol's last 61 bars before them."""
    bars = V.bars(spark, sf)
    tail = W.panel_tail(bars.where(F.col("trade_date") < F.lit(_SINCE).cast("date")))
    p, _ = W.extend_panel(tail, bars.where(F.col("trade_date") >= F.lit(_SINCE).cast("date")), **GATES)
    return rounded(p.where(F.col("reason") == "eligible").select("symbol", "trade_date", F.col("bar_no").cast("long").alias("bar_no"), *_PANEL_COLS), 5)


_LATEST = {"latest": f"SELECT *, 1 AS run FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM panel) WHERE rn = 1 AND {_ELIGIBLE}"}
_SCORES = ", ".join(f"{r('score_' + f, 5)} AS score_{f}" for f in FACTOR_SQL)
_PCT = "CASE WHEN n = 1 THEN 100.0 ELSE (n - rank) * 100.0 / (n - 1) END"


@query("score_table", with_views(["panel"], f"SELECT symbol, {_SCORES}, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank, {r(_PCT, 5)} AS score_percentile FROM scored",
                                 {**_LATEST, **scored("latest", "run", V1)}))
def score_latest(spark, sf):
    ranking, _ = W.factor_engine(V.bars(spark, sf), CHECKED_V1, **GATES)
    return rounded(ranking.select("symbol", *["score_" + f for f in FACTOR_SQL], "composite_score", "rank", "score_percentile"), 5)


_HOLES = {**_LATEST, "holes": "SELECT * REPLACE (CASE WHEN CAST(symbol AS INTEGER) % 7 <> 0 THEN log_amount_20 END AS log_amount_20, CASE WHEN CAST(symbol AS INTEGER) % 5 <> 0 THEN momentum_20 END AS momentum_20) FROM latest"}
_MISSING_SQL = f"SELECT symbol, {r('score_momentum_20', 5)} AS score_momentum_20, {r('score_log_amount_20', 5)} AS score_log_amount_20, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank FROM scored"


def _with_missing(spark, sf, coverage):
    """The latest cross-section with NaN for one factor of some names and NULL for another's."""
    number = F.col("symbol").cast("int")
    latest = W.market_factors(V.bars(spark, sf), **GATES).withColumns({
        "run": F.lit(1), "log_amount_20": F.when(number % 7 != 0, F.col("log_amount_20")).otherwise(F.lit(float("nan"))), "momentum_20": F.when(number % 5 != 0, F.col("momentum_20"))})
    s = W.score_table(latest, replace(CHECKED_V1, min_coverage=coverage), ["run"])
    return rounded(s.select("symbol", "score_momentum_20", "score_log_amount_20", "composite_score", "rank"), 5)


@query("score_table_nan", with_views(["panel"], _MISSING_SQL, {**_HOLES, **scored("holes", "run", V1)}))
def _(spark, sf):
    return _with_missing(spark, sf, 1.0)


@query("score_table_partial_coverage", with_views(["panel"], _MISSING_SQL, {**_HOLES, **scored("holes", "run", V1, 0.7)}))
def _(spark, sf):
    return _with_missing(spark, sf, 0.7)


@query("factor_engine_exclusions", with_views(["panel"], f"""SELECT symbol, CASE WHEN bar_no < 61 THEN 'insufficient_history:' || CAST(bar_no AS VARCHAR) || '<61' ELSE 'below_min_average_amount_20' END AS reason,
    {r('CASE WHEN bar_no >= 61 THEN average_amount_20 END', 4)} AS average_amount_20
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM panel) WHERE rn = 1 AND NOT ({_ELIGIBLE})"""))
def _(spark, sf):
    return rounded(W.factor_engine(V.bars(spark, sf), CHECKED_V1, **GATES)[1], 4)


@query("winsorized_zscore", with_views(["panel"], f"SELECT as_of, symbol, {r('score_momentum_20', 5)} AS z_momentum_20, {r('score_log_amount_20', 5)} AS z_log_amount_20 FROM zed",
                                       {"dated": f"SELECT *, trade_date AS as_of FROM panel WHERE {_ELIGIBLE}", **scored("dated", "as_of", {"momentum_20": (1, 1), "log_amount_20": (1, 1)})}))
def _(spark, sf):
    p = W.factor_panel(V.bars(spark, sf), **GATES).where(F.col("reason") == "eligible").withColumnRenamed("trade_date", "as_of")
    z = winsorized_zscores(settled(p.select("as_of", "symbol", "momentum_20", "log_amount_20")), ["as_of"], ["momentum_20", "log_amount_20"])
    return rounded(z.select("as_of", "symbol", "z_momentum_20", "z_log_amount_20"), 5)


_DATED = {"dated": f"SELECT *, trade_date AS as_of FROM panel WHERE {_ELIGIBLE}"}


@query("historical_rankings", with_views(["panel"], f"SELECT as_of, symbol, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank, {r(_PCT, 5)} AS score_percentile FROM scored",
                                         {**_DATED, **scored("dated", "as_of", V2)}))
def _(spark, sf):
    h = W.historical_rankings(V.bars(spark, sf), CHECKED_V2, stale="drop_then_score", **GATES)
    return rounded(h.select("as_of", "symbol", "composite_score", "rank", "score_percentile"), 5)


# A date's cross-section holds every symbol's last bar known then, found by the checking engine's as-of join.
_CARRIED = {
    "grid": "SELECT d.trade_date AS as_of, s.symbol FROM (SELECT DISTINCT trade_date FROM bars) d, (SELECT DISTINCT symbol FROM bars) s",
    "carried": f"SELECT g.as_of, p.* FROM grid g ASOF JOIN panel p ON g.symbol = p.symbol AND g.as_of >= p.trade_date",
    "dated": f"SELECT * FROM carried WHERE {_ELIGIBLE}",
}


@query("historical_rankings_carried", with_views(["panel"], f"SELECT as_of, symbol, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank FROM scored WHERE trade_date = as_of",
                                                 {**_CARRIED, **scored("dated", "as_of", V2)}))
def _(spark, sf):
    h = W.historical_rankings(V.bars(spark, sf), CHECKED_V2, stale="score_then_drop", **GATES)
    return rounded(h.select("as_of", "symbol", "composite_score", "rank"), 5)


def quarter_candidates(spark, sf):
    """Names with an archived amount in a quarter, observed on the quarter's first day."""
    life = V.lifecycle(spark, sf).select("symbol", "name", "exchange", "board", (F.col("symbol").cast("long") % 7 == 0).alias("is_st"))
    return V.archive_amounts(spark, sf).select(F.col("trade_date").alias("as_of"), "symbol").join(life, "symbol")


_CANDS = {"cands": "SELECT a.trade_date AS as_of, a.symbol, l.board FROM archive_amounts a JOIN lifecycle l USING (symbol)"}


@query("strict_rankings", with_views(["panel", "archive_amounts", "lifecycle"], f"SELECT as_of, symbol, board, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank FROM scored WHERE trade_date = as_of",
                                     {**_CANDS, "seen": "SELECT c.as_of, c.board, p.* FROM cands c ASOF JOIN panel p ON c.symbol = p.symbol AND c.as_of >= p.trade_date",
                                      "dated": f"SELECT * FROM seen WHERE {_ELIGIBLE}", **scored("dated", "as_of", V2)}))
def _(spark, sf):
    ranked, _ = W.strict_rankings(V.bars(spark, sf), quarter_candidates(spark, sf), CHECKED_V2, **GATES)
    return rounded(ranked.select("as_of", "symbol", "board", "composite_score", "rank"), 5)


@query("strict_rankings_refused", with_views(["panel", "archive_amounts", "lifecycle"], f"""SELECT as_of, CASE WHEN h = 0 THEN 'no_histories' WHEN e = 0 THEN 'no_eligible_factor_rows' ELSE 'no_same_day_factor_rows' END AS reason FROM (
    SELECT as_of, count(trade_date) AS h, count(*) FILTER (WHERE {_ELIGIBLE}) AS e, count(*) FILTER (WHERE {_ELIGIBLE} AND trade_date = as_of) AS s FROM seen GROUP BY as_of) WHERE s = 0""",
    {**_CANDS, "seen": "SELECT c.as_of, p.* FROM cands c ASOF LEFT JOIN panel p ON c.symbol = p.symbol AND c.as_of >= p.trade_date"}))
def _(spark, sf):
    return W.strict_rankings(V.bars(spark, sf), quarter_candidates(spark, sf), CHECKED_V2, **GATES)[1]


@query("score_configs", with_views(["panel"], f"""SELECT * FROM (SELECT 'v1' AS config_id, symbol, {r('c1', 5)} AS composite_score, CAST(rank() OVER (ORDER BY c1 DESC) AS INTEGER) AS rank FROM mixes
    UNION ALL SELECT 'v2', symbol, {r('c2', 5)}, CAST(rank() OVER (ORDER BY c2 DESC) AS INTEGER) FROM mixes)""",
    {**_LATEST, **scored("latest", "run", V1),
     "mixes": "SELECT symbol, " + ", ".join("round(" + " + ".join(f"score_{f} * {w}" for f, (w, _) in cfg.items()) + f", 9) AS c{i}" for i, cfg in ((1, V1), (2, V2))) + " FROM zed"}))
def _(spark, sf):
    latest = W.market_factors(V.bars(spark, sf), **GATES).withColumn("run", F.lit(1))
    s = W.score_configs(latest, {"v1": CHECKED_V1, "v2": CHECKED_V2}, ["run"])
    return rounded(s.select("config_id", "symbol", "composite_score", "rank"), 5)


@query("attach_metadata", with_views(["panel", "master"], "SELECT s.symbol, CAST(rank AS INTEGER) AS rank, m.name, m.exchange, m.board, m.is_st FROM scored s LEFT JOIN master m USING (symbol)",
                                     {**_LATEST, **scored("latest", "run", V1)}))
def _(spark, sf):
    ranking, _ = W.factor_engine(V.bars(spark, sf), CHECKED_V1, **GATES)
    return W.attach_metadata(ranking.select("symbol", "rank"), V.master(spark, sf))


@query("top_n_selected", with_views(["panel"], f"SELECT symbol, {r('composite_score', 5)} AS composite_score, CAST(rank AS INTEGER) AS rank FROM scored ORDER BY composite_score DESC, symbol LIMIT 10",
                                    {**_LATEST, **scored("latest", "run", V1)}))
def _(spark, sf):
    ranking, _ = W.factor_engine(V.bars(spark, sf), CHECKED_V1, **GATES)
    top = U.top_k(ranking.where(F.col("rank").isNotNull()), 10, [F.col("composite_score").desc(), F.col("symbol").asc()])
    return rounded(top.select("symbol", "composite_score", "rank"), 5)


# --- universes --------------------------------------------------------------------------------

AS_OF = "2024-06-30"
_SCREEN = "is_listed AND NOT is_st AND list_date <= DATE '2024-06-30' - 120 AND exchange IN ('SSE','SZSE')"


@query("market_eligibility", with_views(["returns"], f"""SELECT symbol, max(bar_no) AS bars, CASE WHEN max(bar_no) < 550 THEN 'insufficient_history:' || CAST(max(bar_no) AS VARCHAR) || '<550'
    WHEN avg(amount) FILTER (WHERE rn <= 20) < {MIN_AMOUNT} THEN 'below_min_average_amount_20' ELSE 'eligible' END AS reason,
    {r('CASE WHEN max(bar_no) >= 550 THEN avg(amount) FILTER (WHERE rn <= 20) END', 4)} AS average_amount_20
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM returns) GROUP BY symbol"""))
def _(spark, sf):
    return rounded(U.market_eligibility(V.bars(spark, sf), min_history=550, min_average_amount=MIN_AMOUNT), 4)


@query("select_liquid", with_views(["master", "spot"], f"""SELECT m.symbol, m.exchange, m.board, {r('s.amount', 2)} AS amount, {r('s.float_market_cap', 4)} AS float_market_cap FROM master m JOIN spot s USING (symbol)
    WHERE {_SCREEN} AND amount >= 20000 AND last > 0 ORDER BY s.amount DESC, s.float_market_cap DESC NULLS LAST, m.symbol LIMIT 30"""))
def _(spark, sf):
    got = U.select_liquid(V.master(spark, sf), V.spot(spark, sf), AS_OF, limit=30, min_amount=20000.0)
    return got.select("symbol", "exchange", "board", F.round("amount", 2).alias("amount"), F.round("float_market_cap", 4).alias("float_market_cap"))


@query("select_liquid_spot_only", f"""WITH {_SPOT_RAW}, ex AS (SELECT *, CASE WHEN left(symbol, 1) = '6' THEN 'SSE' WHEN left(symbol, 1) IN ('0','3') THEN 'SZSE' ELSE 'BSE' END AS exchange FROM snap)
    SELECT symbol, name, exchange, CASE WHEN exchange = 'SSE' THEN '上证主板' WHEN left(symbol, 3) IN ('300','301') THEN '创业板' ELSE '深证主板' END AS board, {r('amount', 2)} AS amount
    FROM ex WHERE exchange IN ('SSE','SZSE') AND NOT contains(upper(name), 'ST') AND amount >= 50000 ORDER BY ex.amount DESC, symbol LIMIT 30""")
def _(spark, sf):
    snap = N.normalize_spot(V.order_codes(spark, sf), layout="short", order="seq")
    return rounded(U.select_liquid_spot_only(snap, limit=30, min_amount=50000.0).select("symbol", "name", "exchange", "board", "amount"), 2)


@query("select_liquid_from_history", with_views(["master", "bars"], f"""SELECT symbol, exchange, {r('avg_amount', 4)} AS amount FROM big JOIN (
    SELECT symbol, avg(amount) AS avg_amount, count(*) AS n FROM (SELECT symbol, amount, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars WHERE trade_date <= DATE '2024-06-30' AND trade_date >= DATE '2024-06-30' - 65)
    WHERE rn <= 20 GROUP BY symbol) h USING (symbol) WHERE n >= 10 AND avg_amount >= 20000 ORDER BY avg_amount DESC, symbol LIMIT 15""",
    {"big": f"SELECT * FROM (SELECT *, coalesce(float_shares, total_shares) AS size_proxy FROM master WHERE {_SCREEN}) WHERE size_proxy > 0 ORDER BY size_proxy DESC, symbol LIMIT 40"}))
def _(spark, sf):
    got = U.select_liquid_from_history(V.master(spark, sf), V.bars(spark, sf), AS_OF, limit=15, min_amount=20000.0, prefilter=40)
    return rounded(got.select("symbol", "exchange", "amount"), 4)


@query("revalidate_candidates", with_views(["master", "spot"], f"""SELECT m.symbol, {r('c.amount', 2)} AS amount FROM master m JOIN (SELECT symbol, amount / 2 AS amount, float_market_cap FROM spot) c USING (symbol)
    WHERE {_SCREEN} AND amount >= 10000 ORDER BY c.amount DESC, c.float_market_cap DESC NULLS LAST, m.symbol LIMIT 20"""))
def _(spark, sf):
    cached = V.spot(spark, sf).withColumn("amount", F.col("amount") / 2)
    return rounded(U.revalidate_candidates(cached, V.master(spark, sf), AS_OF, limit=20, min_amount=10000.0).select("symbol", "amount"), 2)


@query("layered_universe", with_views(["master", "spot"], f"""SELECT m.symbol, {r('c.amount', 2)} AS amount, 2 AS layer, 'candidate_cache' AS layer_name FROM master m JOIN (SELECT symbol, amount / 2 AS amount, float_market_cap FROM spot) c USING (symbol)
    WHERE {_SCREEN} AND amount >= 10000 ORDER BY c.amount DESC, c.float_market_cap DESC NULLS LAST, m.symbol LIMIT 5"""))
def _(spark, sf):
    m, s = V.master(spark, sf), V.spot(spark, sf)
    live = U.select_liquid(m, s, AS_OF, limit=5, min_amount=1e9).select("symbol", "amount")
    cached = U.revalidate_candidates(s.withColumn("amount", F.col("amount") / 2), m, AS_OF, limit=5, min_amount=10000.0).select("symbol", "amount")
    history = U.select_liquid_from_history(m, V.bars(spark, sf), AS_OF, limit=5, min_amount=20000.0).select("symbol", "amount")
    picked = U.layered_universe([("live_spot", live), ("candidate_cache", cached), ("history_liquidity", history)], needed=5)
    return rounded(picked.select("symbol", "amount", "layer", "layer_name"), 2)


@query("spot_coverage", with_views(["master"], """SELECT count(*) AS listed, count(s.symbol) AS covered, round(count(s.symbol) / count(*), 6) + 0.0 AS coverage, count(s.symbol) / count(*) >= 0.80 AS passed
    FROM master m LEFT JOIN (SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol FROM lineitem) s USING (symbol) WHERE m.is_listed AND m.exchange IN ('SSE','SZSE')"""))
def _(spark, sf):
    snap = V.table(spark, sf, "lineitem").select(V.code("l_suppkey").alias("symbol"))
    return rounded(U.spot_coverage(V.master(spark, sf), snap))


@query("membership_as_of", with_views(["lifecycle"], "SELECT symbol, exchange, list_date, delist_date FROM lifecycle WHERE list_date <= DATE '2024-06-30' AND (delist_date IS NULL OR delist_date > DATE '2024-06-30')"))
def _(spark, sf):
    return U.membership_as_of(V.lifecycle(spark, sf), AS_OF).select("symbol", "exchange", "list_date", "delist_date")


@query("membership_aged", with_views(["lifecycle"], "SELECT symbol FROM lifecycle WHERE list_date <= DATE '2021-06-30' - 120 AND (delist_date IS NULL OR delist_date > DATE '2021-06-30') AND exchange IN ('SSE','SZSE')"))
def _(spark, sf):
    return U.membership_as_of(V.lifecycle(spark, sf), "2021-06-30", min_listing_days=120, exchanges=("SSE", "SZSE")).select("symbol")


@query("membership_calendar", with_views(["lifecycle", "order_calendar"], """SELECT c.trade_date, count(l.symbol) AS listed_total, count(*) FILTER (WHERE l.exchange = 'SSE') AS sse_listed, count(*) FILTER (WHERE l.exchange = 'SZSE') AS szse_listed
    FROM order_calendar c LEFT JOIN (SELECT * FROM lifecycle WHERE exchange IN ('SSE','SZSE')) l ON l.list_date <= c.trade_date AND (l.delist_date IS NULL OR l.delist_date > c.trade_date) GROUP BY 1"""))
def _(spark, sf):
    return U.membership_calendar(V.lifecycle(spark, sf), V.order_calendar(spark, sf))


@query("membership_crosscheck", with_views(["lifecycle", "bars"], f"""SELECT trade_date, observed_count, listed_total, observed_count - listed_total AS count_difference, {r('(observed_count - listed_total) / nullif(listed_total, 0)')} AS relative_difference FROM
    (SELECT trade_date, count(DISTINCT symbol) AS observed_count FROM bars GROUP BY 1) o JOIN (SELECT c.trade_date, count(l.symbol) AS listed_total FROM (SELECT DISTINCT trade_date FROM bars) c
    LEFT JOIN (SELECT * FROM lifecycle WHERE exchange IN ('SSE','SZSE')) l ON l.list_date <= c.trade_date AND (l.delist_date IS NULL OR l.delist_date > c.trade_date) GROUP BY 1) m USING (trade_date)"""))
def _(spark, sf):
    b = V.bars(spark, sf)
    seen = b.groupBy("trade_date").agg(F.count_distinct("symbol").alias("observed_count"))
    return rounded(U.membership_crosscheck(seen, U.membership_calendar(V.lifecycle(spark, sf), b.select("trade_date"))))


@query("drop_stale", with_views(["bars"], """SELECT symbol, 'stale_latest_bar:' || CAST(latest AS VARCHAR) || ' != ' || CAST(market AS VARCHAR) AS error FROM (
    SELECT symbol, max(trade_date) AS latest, (SELECT max(trade_date) FROM bars) AS market FROM bars GROUP BY symbol) WHERE latest < market"""))
def _(spark, sf):
    return U.drop_stale(V.bars(spark, sf))[1]


@query("fresh_bars", with_views(["bars"], """SELECT symbol, count(*) AS bars FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING max(trade_date) = (SELECT max(trade_date) FROM bars)) GROUP BY symbol"""))
def _(spark, sf):
    return U.drop_stale(V.bars(spark, sf))[0].groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("window_trim", with_views(["trades"], f"SELECT symbol, count(*) AS rows, {r('sum(notional)', 2)} AS notional FROM (SELECT symbol, CAST(notional AS DECIMAL(18,2)) AS notional FROM trades WHERE trade_date BETWEEN DATE '2023-01-03' AND DATE '2024-12-31') GROUP BY 1"))
def _(spark, sf):
    t = U.window_trim(V.trades(spark, sf), "2023-01-03", "2024-12-31")
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(V.money("notional")).cast("double"), 2).alias("notional"))


@query("period_overlap", with_views(["lifecycle"], """SELECT symbol, greatest(DATE '2021-01-01', list_date) AS effective_start, least(DATE '2024-06-30', delist_date) AS effective_end FROM lifecycle
    WHERE list_date <= DATE '2024-06-30' AND (delist_date IS NULL OR delist_date >= DATE '2021-01-01')"""))
def _(spark, sf):
    return U.period_overlap(V.lifecycle(spark, sf), "2021-01-01", "2024-06-30").select("symbol", "effective_start", "effective_end")


@query("rankable_state", with_views(["archive_states"], "SELECT trade_date, count(*) AS states, count(*) FILTER (WHERE NOT is_st AND trade_status AND close > 0) AS rankable FROM archive_states GROUP BY 1"))
def _(spark, sf):
    s = V.archive_states(spark, sf).withColumn("k", U.rankable(F.col("is_st"), F.col("trade_status"), F.col("close")))
    return s.groupBy("trade_date").agg(F.count(F.lit(1)).alias("states"), F.count_if("k").alias("rankable"))


@query("affordable_lot", with_views(["bars"], "SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE close * 100 * (1 + 0.002) <= 150000) AS affordable FROM bars GROUP BY 1"))
def _(spark, sf):
    b = V.bars(spark, sf).withColumn("ok", affordable_lot(F.col("close"), 150000.0, 0.002))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if("ok").alias("affordable"))


@query("min_universe_gate", with_views(["spot"], "SELECT 'spot' AS gate, count(DISTINCT symbol) AS usable, CAST(60 AS BIGINT) AS needed, count(DISTINCT symbol) >= 60 AS passed FROM spot"))
def _(spark, sf):
    return U.min_universe_gate(V.spot(spark, sf), 60, "spot")
