"""The views of ``tidemark.sources.views`` again, as independent ANSI SQL for the checking engine."""

SHIFT = 9131

_EXCHANGE = "CASE s_nationkey % 3 WHEN 0 THEN 'SSE' WHEN 1 THEN 'SZSE' ELSE 'BSE' END"
_BOARD = """CASE s_nationkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN '科创板' ELSE '上证主板' END
    WHEN 1 THEN CASE WHEN s_suppkey % 4 = 0 THEN '创业板' ELSE '深证主板' END ELSE '北交所' END"""
_LISTED = "DATE '2019-06-01' + CAST(s_suppkey * 37 % 900 AS INTEGER)"
_DELISTED = "CASE WHEN s_suppkey % 9 = 4 THEN DATE '2024-01-01' + CAST(s_suppkey * 53 % 700 AS INTEGER) END"

VIEWS = {
    "bars": f"""SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) + {SHIFT} AS trade_date,
        arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close,
        sum(l_quantity) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM lineitem GROUP BY 1, 2""",
    "lifecycle": f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, s_name AS name, {_EXCHANGE} AS exchange, {_BOARD} AS board,
        {_LISTED} AS list_date, {_DELISTED} AS delist_date, s_suppkey % 9 <> 4 AS currently_listed FROM supplier""",
    "master": f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN s_acctbal < 0 THEN '*ST ' || s_name ELSE s_name END AS name,
        {_EXCHANGE} AS exchange, {_BOARD} AS board, {_LISTED} AS list_date, CASE WHEN s_nationkey % 7 <> 3 THEN n_name END AS industry,
        round(abs(s_acctbal) * 1000) AS total_shares, CASE WHEN s_suppkey % 5 <> 2 THEN round(abs(s_acctbal) * 600) END AS float_shares,
        s_acctbal < 0 AS is_st, s_suppkey % 9 <> 4 AS is_listed, TIMESTAMP '2027-01-01 08:00:00' AS observed_at
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "master_history": """SELECT symbol, name, exchange, board, list_date, industry, total_shares, float_shares,
        (CAST(total_shares AS BIGINT) + i) % 4 = 0 AS is_st, is_listed, t AS observed_at
        FROM master, (VALUES (TIMESTAMP '2024-06-30 08:00:00', 0), (TIMESTAMP '2025-06-30 08:00:00', 1), (TIMESTAMP '2026-06-30 08:00:00', 2)) v(t, i)
        WHERE list_date <= CAST(t AS DATE) - (1500 - 300 * i)""",
    "spot": """SELECT symbol, (CASE WHEN CAST(symbol AS BIGINT) % 13 = 5 THEN 'ST ' ELSE '' END) || 'N' || symbol AS name, arg_max(close, trade_date) AS last,
        arg_max(amount, trade_date) AS amount, arg_max(close, trade_date) * 1000 AS market_cap,
        CASE WHEN CAST(symbol AS BIGINT) % 10 <> 0 THEN arg_max(close, trade_date) * 500 END AS float_market_cap FROM bars GROUP BY symbol""",
    "facts": f"""SELECT symbol, metric, round(CAST(sum(v) AS DOUBLE) - CASE WHEN contains(metric, '净利润') THEN 60000.0 ELSE 0.0 END, 2) AS value, period_end, available_at, source
        FROM (SELECT lpad(CAST(CAST(floor(o_custkey / 15) AS BIGINT) AS VARCHAR), 6, '0') AS symbol,
            CASE o_orderpriority WHEN '1-URGENT' THEN '利润表::营业总收入' WHEN '2-HIGH' THEN '利润表::净利润' WHEN '3-MEDIUM' THEN '现金流量表::经营活动产生的现金流量净额'
                WHEN '4-NOT SPECIFIED' THEN '资产负债表::资产总计' WHEN '5-LOW' THEN '资产负债表::负债合计' END AS metric,
            CAST(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE) + {SHIFT}) AS DATE) - 1 AS TIMESTAMP) AS period_end,
            CAST(CAST(o_orderdate AS DATE) + {SHIFT} AS TIMESTAMP) AS available_at, o_orderstatus AS source, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
        GROUP BY symbol, metric, period_end, available_at, source""",
    "equity": f"""SELECT 'P' || CAST(o_orderkey % 3 AS VARCHAR) AS portfolio_id, CAST(o_orderdate AS DATE) + {SHIFT} AS trade_date,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) + 1000000.0 AS equity FROM orders GROUP BY 1, 2""",
    "index_series": f"""SELECT CAST(o_orderdate AS DATE) + {SHIFT} AS trade_date,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100 + 3000 AS close FROM orders GROUP BY 1""",
    "order_calendar": f"SELECT DISTINCT CAST(o_orderdate AS DATE) + {SHIFT} AS trade_date FROM orders",
    "trades": f"""SELECT 'P' || CAST(l_orderkey % 3 AS VARCHAR) AS portfolio_id, CAST(l_shipdate AS DATE) + {SHIFT} AS trade_date,
        lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice AS notional,
        CASE WHEN l_linestatus = 'F' THEN 'etf' ELSE 'stock' END AS instrument_type, l_quantity AS quantity, l_orderkey, l_linenumber FROM lineitem""",
    "quarters": f"""SELECT symbol, trade_date, n, qty, top, px, amount, year(trade_date) * 4 + quarter(trade_date) AS qno FROM (
        SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(date_trunc('quarter', CAST(l_shipdate AS DATE) + {SHIFT}) AS DATE) AS trade_date,
            count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, max(l_quantity) AS top, max(l_extendedprice / l_quantity) AS px,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1, 2)""",
    "archive_amounts": "SELECT symbol, trade_date, amount FROM quarters",
    "archive_states": "SELECT symbol, trade_date, n % 5 = 0 AS is_st, qty % 7 <> 0 AS trade_status, px AS close FROM quarters",
    "gap_amounts": "SELECT symbol, trade_date, amount FROM quarters WHERE NOT (qno % 7 = 3 AND top < 48)",
    "gap_states": """SELECT symbol, trade_date, n % 5 = 0 AS is_st, qty % 7 <> 0 AS trade_status, px AS close FROM quarters
        WHERE NOT (qno % 5 = 0 AND top < 48)""",
    "states_daily": """SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS trade_date, bool_or(event_type = 'error') AS is_st,
        bool_or(event_type <> 'signup') AS trade_status, max(value) AS close FROM events GROUP BY 1, 2""",
    "name_changes": """SELECT symbol, change_date, (CASE WHEN b THEN '*ST' ELSE '' END) || 'N' || symbol AS old_name,
        (CASE WHEN a THEN '*ST' ELSE '' END) || 'N' || symbol || (CASE WHEN e % 11 = 0 THEN '退' ELSE '' END) AS new_name, b AS is_st_before, a AS is_st_after,
        b <> a AS st_transition, CASE WHEN e % 13 = 0 THEN 'other' ELSE 'szse_official_abbreviation_change' END AS source
        FROM (SELECT *, e % 2 = 0 AS b, CASE WHEN e % 5 = 0 THEN e % 2 = 0 ELSE e % 2 <> 0 END AS a FROM (
            SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS change_date, min(event_id) AS e FROM events GROUP BY 1, 2))""",
    "verified_events": """SELECT symbol, (CASE WHEN e % 3 = 0 THEN 'SSE' ELSE 'SZSE' END) || (CASE WHEN (e % 2 = 0) = (e % 7 <> 0) THEN '_apply' ELSE '_remove' END) AS cohort,
        d - CAST(e % 4 - 1 AS INTEGER) AS published, d AS effective_date, CASE WHEN e % 2 = 0 THEN 'apply_st' ELSE 'remove_st' END AS action,
        e % 2 <> 0 AS is_st_before, e % 2 = 0 AS is_st_after, CASE WHEN e % 17 = 0 THEN 'ftp://x' ELSE 'http://x' END AS pdf_url,
        CASE WHEN e % 19 = 0 THEN 'bad' ELSE sha256(CAST(e AS VARCHAR)) END AS pdf_sha256
        FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS d, min(event_id) AS e FROM events GROUP BY 1, 2)""",
    # factor panel over bars: seven factors per (symbol, day), by frames written out in SQL
    "returns": """SELECT symbol, trade_date, open, high, low, close, volume, amount, lag(close) OVER w AS previous_close, close / lag(close) OVER w - 1 AS r,
        row_number() OVER w AS bar_no FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""",
    "drawdowns": """SELECT symbol, trade_date, CASE WHEN len(closes) = 60 THEN 1 - list_min(list_transform(range(1, 61), lambda i: closes[i] / list_max(closes[1:i]))) END AS max_drawdown_60
        FROM (SELECT symbol, trade_date, list(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS closes FROM bars)""",
    "panel": """SELECT r.symbol, r.trade_date, r.close, r.previous_close, r.bar_no, m60.max_drawdown_60, avg(r.amount) OVER w20 AS average_amount_20,
        r.close / lag(r.close, 20) OVER w - 1 AS momentum_20, r.close / lag(r.close, 60) OVER w - 1 AS momentum_60,
        CASE WHEN r.bar_no >= 60 THEN avg(r.close) OVER w20 / avg(r.close) OVER w60 - 1 END AS trend_ma20_ma60,
        CASE WHEN r.bar_no >= 20 THEN r.close / avg(r.close) OVER w20 - 1 END AS trend_close_ma20,
        CASE WHEN count(r.r) OVER w20 = 20 THEN stddev_pop(r.r) OVER w20 * sqrt(252.0) END AS volatility_20, ln(1 + avg(r.amount) OVER w20) AS log_amount_20
        FROM returns r JOIN drawdowns m60 USING (symbol, trade_date)
        WINDOW w AS (PARTITION BY r.symbol ORDER BY r.trade_date), w20 AS (PARTITION BY r.symbol ORDER BY r.trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        w60 AS (PARTITION BY r.symbol ORDER BY r.trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "rankings": """SELECT m.symbol, as_of, close, amount, close / lag(close) OVER w - 1 AS momentum_20,
        close / ((close + lag(close, 1) OVER w + lag(close, 2) OVER w) / 3) - 1 AS trend_close_ma20, CAST(rank() OVER (PARTITION BY as_of ORDER BY amount DESC) AS INTEGER) AS rank,
        l.name, l.exchange, l.board, CAST(m.symbol AS BIGINT) % 11 = 3 AS is_st
        FROM (SELECT symbol, CAST(date_trunc('month', trade_date) AS DATE) AS as_of, arg_max(close, trade_date) / 100 AS close, sum(amount) AS amount FROM bars GROUP BY 1, 2) m
        JOIN lifecycle l USING (symbol) WINDOW w AS (PARTITION BY m.symbol ORDER BY as_of)""",
    "chosen": """SELECT as_of, symbol, board, is_st, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY rank, symbol) AS rn FROM rankings) WHERE rn <= 5""",
    "steps": "SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next_as_of FROM (SELECT DISTINCT as_of FROM rankings)",
    "signals": """SELECT 'EW' AS portfolio_id, as_of AS trade_date, symbol, CAST(weight AS DOUBLE) AS target_weight, board, is_st, 'stock' AS instrument_type FROM chosen
        UNION ALL SELECT 'EW', s.next_as_of, c.symbol, 0.0, c.board, c.is_st, 'stock' FROM chosen c JOIN steps s USING (as_of)
        WHERE s.next_as_of IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chosen n WHERE n.as_of = s.next_as_of AND n.symbol = c.symbol)""",
}

NEEDS = {
    "master_history": ["master"], "spot": ["bars"], "archive_amounts": ["quarters"], "archive_states": ["quarters"], "gap_amounts": ["quarters"], "gap_states": ["quarters"], "returns": ["bars"],
    "drawdowns": ["bars"], "panel": ["returns", "drawdowns"],
    "rankings": ["bars", "lifecycle"], "chosen": ["rankings"], "steps": ["rankings"], "signals": ["chosen", "steps"],
}


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named views and what they need, then extra steps, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


FACTOR_SQL = ["momentum_20", "momentum_60", "trend_ma20_ma60", "volatility_20", "max_drawdown_60", "log_amount_20"]


def scored(source: str, key: str, weights: dict[str, tuple[float, int]], coverage: float = 1.0) -> dict[str, str]:
    """Steps bounds -> clipped -> moments -> z -> scored for one cross-section key; NULL is a missing factor."""
    fs = list(weights)
    bounds = ", ".join(f"quantile_cont({f}, 0.05) AS lo_{f}, quantile_cont({f}, 0.95) AS hi_{f}" for f in fs)
    clip = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, lo_{f}), hi_{f}) END AS c_{f}" for f in fs)
    moment = ", ".join(f"avg(c_{f}) AS m_{f}, stddev_pop(c_{f}) AS s_{f}" for f in fs)
    z = ", ".join(f"CASE WHEN c_{f} IS NULL THEN NULL WHEN s_{f} > 0 THEN (c_{f} - m_{f}) / s_{f} ELSE 0 END * {sign} AS score_{f}" for f, (_, sign) in weights.items())
    total = sum(w for w, _ in weights.values())
    mix = " + ".join(f"coalesce(score_{f}, 0) * {w}" for f, (w, _) in weights.items())
    have = " + ".join(f"CASE WHEN score_{f} IS NOT NULL THEN {w} ELSE 0 END" for f, (w, _) in weights.items())
    return {
        "bounds": f"SELECT {key}, {bounds} FROM {source} GROUP BY {key}",
        "clipped": f"SELECT t.*, {clip} FROM {source} t JOIN bounds USING ({key})",
        "moments": f"SELECT {key}, {moment} FROM clipped GROUP BY {key}",
        "zed": f"SELECT c.*, {z} FROM clipped c JOIN moments USING ({key})",
        "mixed": f"SELECT *, CASE WHEN ({have}) / {total} >= {coverage} - 1e-12 THEN round(({mix}) / ({have}), 9) END AS composite_score FROM zed",
        "scored": f"""SELECT *, CASE WHEN composite_score IS NOT NULL THEN rank() OVER (PARTITION BY {key} ORDER BY composite_score DESC NULLS LAST) END AS rank, count(composite_score) OVER (PARTITION BY {key}) AS n FROM mixed""",
    }


V1 = {"momentum_20": (0.20, 1), "momentum_60": (0.20, 1), "trend_ma20_ma60": (0.15, 1), "volatility_20": (0.15, -1), "max_drawdown_60": (0.15, -1), "log_amount_20": (0.15, 1)}
V2 = {"momentum_20": (0.15, 1), "momentum_60": (0.10, 1), "trend_ma20_ma60": (0.15, 1), "volatility_20": (0.25, -1), "max_drawdown_60": (0.25, -1), "log_amount_20": (0.10, 1)}
