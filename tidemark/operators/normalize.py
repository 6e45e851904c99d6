"""Raw source layouts to canonical tables (N2-N25). The raw rows already sit in storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import LOCAL_ZONE, classify_title
from tidemark.functions.symbols import (
    BOARD_BSE, STAR_PREFIXES_NARROW, column_containing, contains_st, extract_symbol, first_column,
    infer_board, need_column, pad_symbol, parse_flag,
)
from tidemark.operators.checks import Checked, check_rows, latest_per_key, require_columns
from tidemark.operators.factors import by_symbol
from tidemark.schema import BAR_NUMERIC, BARS, FACTS, MASTER_STATE, REQUIRED_EXCHANGES, SPOT

# Header names of the raw feeds.
BAR_HEADERS = {
    "日期": "trade_date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume",
    "成交额": "amount", "振幅": "amplitude_pct", "涨跌幅": "change_pct", "涨跌额": "change", "换手率": "turnover_pct",
}
STATEMENT_META = ("报告日", "公告日期", "更新日期", "数据源", "是否审计", "币种", "类型")


def number(name: str) -> Column:
    """Lenient double; text that is no number, and NaN, become NULL."""
    value = F.expr(f"try_cast(`{name}` AS double)")
    return F.when(~F.isnan(value), value)


def day(name: str) -> Column:
    return F.to_date(F.expr(f"try_cast(`{name}` AS timestamp)"))


def _text(name: str | None) -> Column:
    return F.lit("") if name is None else F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def normalize_bars_cn(raw: DataFrame) -> DataFrame:
    """Chinese headers of stock and fund bars; the symbol travels as a column."""
    require_columns(raw, ["symbol", *BAR_HEADERS], "bars")
    named = raw.withColumnsRenamed(BAR_HEADERS)
    return named.select(pad_symbol(F.col("symbol")).alias("symbol"), day("trade_date").alias("trade_date"),
                        *[number(c).alias(c) for c in BAR_NUMERIC])


def normalize_bars_derived(raw: DataFrame) -> DataFrame:
    """Change columns from the previous close; turnover share to percent."""
    require_columns(raw, ["symbol", "date", "open", "high", "low", "close", "volume", "amount"], "bars")
    w = by_symbol()
    turnover = number("turnover") * 100 if "turnover" in raw.columns else F.lit(None).cast("double")
    base = raw.select(
        pad_symbol(F.col("symbol")).alias("symbol"), day("date").alias("trade_date"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")],
        turnover.alias("turnover_pct"),
    ).withColumn("_prev", F.lag("close").over(w))
    return base.withColumns({
        "change": F.col("close") - F.col("_prev"),
        "change_pct": F.try_divide(F.col("close") - F.col("_prev"), F.col("_prev")) * 100,
        "amplitude_pct": F.try_divide(F.col("high") - F.col("low"), F.col("_prev")) * 100,
    }).select(*BARS.names)


def normalize_benchmark(raw: DataFrame) -> Checked:
    """Either header language, rows without a close dropped, positive, one row per day."""
    date, close = need_column(raw.columns, ("date", "日期", "trade_date")), need_column(raw.columns, ("close", "收盘"))
    rows = raw.select(day(date).alias("trade_date"), number(close).alias("close")).where(F.col("close").isNotNull())
    return check_rows(rows, ["trade_date"], {"trade_date_invalid": F.col("trade_date").isNotNull(),
                                             "close_not_positive": F.col("close") > 0}, unique=["trade_date"])


def normalize_spot(raw: DataFrame, *, order: str, layout: str = "full") -> DataFrame:
    """``full`` or ``short`` snapshot layout; the last copy of a symbol by the column ``order`` wins."""
    short = layout == "short"
    symbol = extract_symbol(F.col("`代码`"), at_end=True) if short else pad_symbol(F.col("`代码`"))
    blank = F.lit(None).cast("double")
    rows = raw.select(
        symbol.alias("symbol"), F.col("`名称`").cast("string").alias("name"), number("最新价").alias("last"),
        number("成交额").alias("amount"),
        (blank if short else number("换手率")).alias("turnover_pct"),
        (blank if short else number("总市值")).alias("market_cap"),
        (blank if short else number("流通市值")).alias("float_market_cap"),
        F.col(order).alias("_order"),
    ).where(F.col("symbol").isNotNull())
    last = latest_per_key(rows, ["symbol"], ["_order"])
    return last.where((F.col("last") > 0) & (F.col("amount") >= 0)).select(*SPOT.names)


# Per exchange (code, name, list date, total, float) headers of the master feeds.
MASTER_HEADERS = {
    "SSE": ("证券代码", "证券简称", "上市日期", "总股本", "流通股本"),
    "SZSE": ("A股代码", "A股简称", "A股上市日期", "A股总股本", "A股流通股本"),
    "BSE": ("证券代码", "证券简称", "上市日期", "总股本", "流通股本"),
}


def normalize_master(raw: DataFrame, exchange: str, observed_at: Column, board: str | None = None) -> DataFrame:
    """One exchange's current list; ST comes from the name."""
    code, name, listed, total, floating = MASTER_HEADERS[exchange]
    optional = lambda c: number(c) if c in raw.columns else F.lit(None).cast("double")
    boards = {"SZSE": F.col("`板块`") if "板块" in raw.columns else F.lit(None)}
    board_col = F.lit(board) if board else boards.get(exchange, F.lit(BOARD_BSE))
    return raw.select(
        pad_symbol(F.col(f"`{code}`")).alias("symbol"), F.col(f"`{name}`").cast("string").alias("name"),
        F.lit(exchange).alias("exchange"), board_col.cast("string").alias("board"), day(listed).alias("list_date"),
        (F.col("`所属行业`").cast("string") if "所属行业" in raw.columns else F.lit(None).cast("string")).alias("industry"),
        optional(total).alias("total_shares"), optional(floating).alias("float_shares"),
        contains_st(F.col(f"`{name}`").cast("string")).alias("is_st"), F.lit(True).alias("is_listed"),
        observed_at.cast("timestamp").alias("observed_at"),
    )


def validate_master(master: DataFrame) -> Checked:
    """N7 rules: known exchanges, one row per symbol."""
    return check_rows(master, ["symbol"], {
        "unsupported_exchange": F.col("exchange").isin(*REQUIRED_EXCHANGES),
        "observed_at_missing": F.col("observed_at").isNotNull(),
    }, unique=["symbol"])


def statement_to_facts(raw: DataFrame, source: str = "financial_report") -> DataFrame:
    """Wide statement rows (symbol, statement, ...) to long facts.

    A fact is visible from the later of its announcement and update dates.
    """
    require_columns(raw, ["symbol", "statement", "报告日", "公告日期"], "statement")
    ids = [c for c in raw.columns if c in STATEMENT_META or c in ("symbol", "statement")]
    items = [c for c in raw.columns if c not in ids]
    if not items:
        raise ValueError("statement has no metric columns")
    typed = raw.select(*[F.col(f"`{c}`") for c in ids], *[number(c).alias(c) for c in items])
    long = typed.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in items], "item", "value")
    stamp = lambda c: F.expr(f"try_cast(`{c}` AS timestamp)")
    visible = F.greatest(stamp("公告日期"), stamp("更新日期")) if "更新日期" in ids else stamp("公告日期")
    return long.where(F.col("value").isNotNull()).select(
        pad_symbol(F.col("symbol")).alias("symbol"), F.concat_ws("::", "statement", "item").alias("metric"), "value",
        stamp("报告日").alias("period_end"), visible.alias("available_at"), F.lit(source).alias("source"),
    )


FACT_KEY = ["symbol", "metric", "period_end", "available_at", "source"]


def validate_facts(raw: DataFrame) -> Checked:
    """Numeric value, never visible before the period ends, unique key."""
    require_columns(raw, FACTS.names, "facts")
    cast = raw.select(
        pad_symbol(F.col("symbol")).alias("symbol"), F.col("metric").cast("string").alias("metric"), number("value").alias("value"),
        F.expr("try_cast(period_end AS timestamp)").alias("period_end"),
        F.expr("try_cast(available_at AS timestamp)").alias("available_at"), F.col("source").cast("string").alias("source"),
    )
    return check_rows(cast, FACT_KEY, {
        "value_not_numeric": F.col("value").isNotNull(),
        "dates_invalid": F.col("period_end").isNotNull() & F.col("available_at").isNotNull(),
        "available_before_period_end": F.col("available_at") >= F.col("period_end"),
    }, unique=FACT_KEY)


def validate_lifecycle(raw: DataFrame) -> Checked:
    """N10."""
    require_columns(raw, ["symbol", "name", "exchange", "board", "list_date", "delist_date"], "lifecycle")
    cast = raw.withColumns({"symbol": pad_symbol(F.col("symbol")), "list_date": day("list_date"), "delist_date": day("delist_date")})
    return check_rows(cast, ["symbol"], {"list_date_missing": F.col("list_date").isNotNull()}, unique=["symbol"])


def validate_amounts(raw: DataFrame) -> Checked:
    """N11."""
    require_columns(raw, ["symbol", "trade_date", "amount"], "amounts")
    cast = raw.select(pad_symbol(F.col("symbol")).alias("symbol"), day("trade_date").alias("trade_date"), number("amount").alias("amount"))
    return check_rows(cast, ["symbol", "trade_date"], {
        "trade_date_invalid": F.col("trade_date").isNotNull(), "amount_invalid": F.col("amount").isNotNull(),
    }, unique=["symbol", "trade_date"])


def validate_states(raw: DataFrame) -> Checked:
    """Strict flags; a tradable row needs a positive close."""
    require_columns(raw, ["symbol", "trade_date", "is_st", "trade_status", "close"], "states")
    cast = raw.select(
        pad_symbol(F.col("symbol")).alias("symbol"), day("trade_date").alias("trade_date"), parse_flag(F.col("is_st")).alias("is_st"),
        parse_flag(F.col("trade_status")).alias("trade_status"), number("close").alias("close"),
    )
    return check_rows(cast, ["symbol", "trade_date"], {
        "trade_date_invalid": F.col("trade_date").isNotNull(), "is_st_unknown": F.col("is_st").isNotNull(),
        "trade_status_unknown": F.col("trade_status").isNotNull(),
        "tradable_without_close": F.coalesce(~F.col("trade_status"), F.lit(True)) | F.coalesce(F.col("close") > 0, F.lit(False)),
    }, unique=["symbol", "trade_date"])


def normalize_listings(raw: DataFrame, exchange: str, order: str) -> DataFrame:
    """A current list of either layout to lifecycle rows, the first copy of a symbol by the column ``order`` kept."""
    sse = exchange == "SSE"
    pick = lambda a, b: need_column(raw.columns, (a, b) if sse else (b, a))
    code, name, listed = pick("证券代码", "A股代码"), pick("证券简称", "A股简称"), pick("上市日期", "A股上市日期")
    board = None if sse else first_column(raw.columns, ("板块",))
    rows = raw.select(
        extract_symbol(F.col(f"`{code}`")).alias("symbol"), F.col(f"`{name}`").cast("string").alias("name"),
        F.lit(exchange).alias("exchange"), day(listed).alias("list_date"), F.col(order).alias("_order"),
        *([F.col(f"`{board}`").cast("string").alias("board")] if board else []),
    )
    if not board:
        rows = rows.withColumn("board", infer_board(F.col("symbol"), F.col("exchange"), STAR_PREFIXES_NARROW))
    kept = rows.where(F.col("symbol").isNotNull() & F.col("list_date").isNotNull()).withColumn("currently_listed", F.lit(True))
    first = kept.groupBy("symbol").agg(F.min_by(F.struct(*[c for c in kept.columns if c not in ("symbol", "_order")]), "_order").alias("_r"))
    return first.select("symbol", "_r.*")


def normalize_delisted(raw: DataFrame, exchange: str, order: str | None = None) -> DataFrame:
    """Delisted list, A-share prefixes only, last copy of a symbol by ``order`` (or delist date)."""
    code = need_column(raw.columns, ("公司代码", "证券代码", "A股代码"))
    name = need_column(raw.columns, ("公司简称", "证券简称", "A股简称"))
    listed = need_column(raw.columns, ("上市日期", "A股上市日期"))
    delisted = need_column(raw.columns, ("终止上市日期", "暂停上市日期", "摘牌日期", "退市日期"))
    rows = raw.select(
        extract_symbol(F.col(f"`{code}`")).alias("symbol"), F.col(f"`{name}`").cast("string").alias("name"),
        F.lit(exchange).alias("exchange"), day(listed).alias("list_date"), day(delisted).alias("delist_date"),
        (F.col(order) if order else day(delisted)).alias("_order"),
    ).withColumn("board", infer_board(F.col("symbol"), F.col("exchange"), STAR_PREFIXES_NARROW))
    prefix = "^6" if exchange == "SSE" else "^[03]"
    kept = rows.where(
        F.col("symbol").rlike(prefix) & F.col("list_date").isNotNull() & F.col("delist_date").isNotNull()
    ).withColumn("currently_listed", F.lit(False))
    return latest_per_key(kept, ["symbol"], ["_order"]).drop("_order")


TRANSITION_SOURCE = "szse_official_abbreviation_change"


def name_change_columns(columns: list[str]) -> tuple[str | None, ...]:
    return (
        first_column(columns, ("证券代码", "A股代码")), first_column(columns, ("变更日期",)),
        first_column(columns, ("变更前简称", "原证券简称", "原简称")) or column_containing(columns, ("变更前", "简称")),
        first_column(columns, ("变更后简称", "新证券简称", "新简称", "证券简称")) or column_containing(columns, ("变更后", "简称")),
    )


def name_changes_to_transitions(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """(transitions, warnings); headers without both names give an empty table and a warning."""
    code, date, old, new = name_change_columns(raw.columns)
    warnings = [] if code and date and old and new else [f"name changes cannot be read from columns {raw.columns}"]
    src = raw if not warnings else raw.limit(0)
    part = lambda c: F.col(f"`{c}`") if c and not warnings else F.lit(None).cast("string")
    rows = src.select(
        extract_symbol(part(code)).alias("symbol"), F.to_date(part(date).cast("string").try_cast("timestamp")).alias("change_date"),
        part(old).cast("string").alias("old_name"), part(new).cast("string").alias("new_name"),
    ).where(F.col("symbol").isNotNull() & F.col("change_date").isNotNull())
    return rows.withColumns({
        "is_st_before": contains_st(F.col("old_name")), "is_st_after": contains_st(F.col("new_name")),
        "st_transition": contains_st(F.col("old_name")) != contains_st(F.col("new_name")), "source": F.lit(TRANSITION_SOURCE),
    }), warnings


ANNOUNCEMENT_HEADERS = {
    "code": ("代码", "secCode", "证券代码"), "name": ("简称", "secName", "证券简称"),
    "title": ("公告标题", "announcementTitle", "标题"), "time": ("公告时间", "announcementTime", "公告日期"),
    "link": ("公告链接", "announcementUrl", "链接"), "id": ("announcementId", "公告ID"), "org": ("orgId", "组织ID"),
    "adjunct": ("adjunctUrl", "附件路径"), "adjunct_type": ("adjunctType", "附件类型"),
}


def normalize_announcements(
    raw: DataFrame, category: str, *, file_base: str = "", detail_base: str = "", source: str = "disclosure_metadata",
    epoch_ms: bool | None = None, title_classes=None,
) -> DataFrame:
    """Alias headers, local time, urls, A-share codes, title class.

    ``epoch_ms`` None decides per table: epoch when over 90% of the times are numeric (one
    aggregate row broadcast back), else text.
    """
    cols = {k: first_column(raw.columns, v) for k, v in ANNOUNCEMENT_HEADERS.items()}
    missing = [k for k in ("code", "name", "title", "time") if cols[k] is None]
    if missing:
        raise ValueError(f"announcements missing fields {missing}")
    ms = F.col("_time").try_cast("double")
    as_epoch = F.from_utc_timestamp(F.timestamp_millis(ms.cast("long")), LOCAL_ZONE)
    as_text = F.col("_time").try_cast("timestamp")
    rows = raw.select(
        F.col(f"`{cols['time']}`").cast("string").alias("_time"),
        extract_symbol(F.col(f"`{cols['code']}`")).alias("symbol"), _text(cols["name"]).alias("name"),
        _text(cols["title"]).alias("announcement_title"), _text(cols["link"]).alias("_link"),
        _text(cols["id"]).alias("announcement_id"), _text(cols["org"]).alias("org_id"),
        _text(cols["adjunct"]).alias("adjunct_url"), _text(cols["adjunct_type"]).alias("adjunct_type"),
    )
    if epoch_ms is None:
        share = rows.agg((F.avg(F.when(ms.isNotNull(), 1.0).otherwise(0.0)) > 0.90).alias("_epoch"))
        rows = rows.join(F.broadcast(share))
    else:
        rows = rows.withColumn("_epoch", F.lit(epoch_ms))
    timed = rows.withColumn("announcement_time", F.when(F.col("_epoch"), as_epoch).otherwise(as_text)).where(
        F.col("announcement_time").isNotNull() & F.col("symbol").rlike(r"^[036][0-9]{5}$")
    )
    adjunct = F.trim("adjunct_url")
    pdf = F.when((adjunct == "") | (F.lower("adjunct_url") == "nan"), "").otherwise(
        F.concat(F.lit(file_base), F.regexp_replace("adjunct_url", "^/+", ""))
    )
    detail = F.concat(
        F.lit(detail_base), F.lit("?stockCode="), F.col("symbol"), F.lit("&announcementId="), F.col("announcement_id"),
        F.lit("&orgId="), F.col("org_id"), F.lit("&announcementTime="), F.col("announcement_time").cast("string"),
    )
    return timed.select(
        "symbol", "name", "announcement_title", "announcement_time",
        F.when(F.col("_link") == "", detail).otherwise(F.col("_link")).alias("announcement_link"),
        "announcement_id", "org_id", "adjunct_url", "adjunct_type", pdf.alias("pdf_url"), F.lit(category).alias("category"),
        classify_title(F.col("announcement_title"), title_classes).alias("event_candidate"), F.lit(source).alias("source"),
    )


def dedup_announcements(df: DataFrame) -> DataFrame:
    """One row per (symbol, title, time, link), whatever window or category it came from."""
    return df.dropDuplicates(["symbol", "announcement_title", "announcement_time", "announcement_link"])


def validate_candidates(raw: DataFrame) -> Checked:
    """N19."""
    require_columns(raw, ["symbol", "name", "exchange", "board", "list_date", "is_st", "is_listed", "amount", "screen_source"], "candidates")
    cast = raw.withColumns({
        "symbol": pad_symbol(F.col("symbol")), "list_date": day("list_date"), "is_st": parse_flag(F.col("is_st")),
        "is_listed": parse_flag(F.col("is_listed")), "amount": number("amount"),
    })
    keys = [c for c in ("evidence_date",) if c in raw.columns] + ["symbol"]
    return check_rows(cast, keys, {
        "is_st_unknown": F.col("is_st").isNotNull(), "is_listed_unknown": F.col("is_listed").isNotNull(),
        "amount_invalid": F.col("amount").isNotNull(),
    }, unique=keys)


def project_master_state(master: DataFrame) -> DataFrame:
    """N20."""
    return master.select(*[F.coalesce("industry", F.lit("")).alias("industry") if c == "industry" else F.col(c) for c in MASTER_STATE])


def validate_rankings(rankings: DataFrame) -> DataFrame:
    """Rows that a portfolio rule may use."""
    require_columns(rankings, ["symbol", "rank", "board", "is_st", "close", "momentum_20", "trend_close_ma20"], "rankings")
    return rankings.where(
        F.col("rank").isNotNull() & (F.col("close") > 0) & F.col("momentum_20").isNotNull() & F.col("trend_close_ma20").isNotNull()
    )


def validate_signals(signals: DataFrame, keys: list[str] | None = None) -> Checked:
    """Weights within [0, 1], known instruments, at most 100% per key and date."""
    keys = keys or ["trade_date"]
    kind = F.lower(F.coalesce("instrument_type", F.lit("stock")))
    checked = check_rows(signals, [*keys, "symbol"], {
        "weight_out_of_range": (F.col("target_weight") >= 0) & (F.col("target_weight") <= 1),
        "unsupported_instrument": kind.isin("stock", "etf"),
    })
    over = (
        signals.groupBy(*keys).agg(F.sum("target_weight").alias("_w"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("_w") > 1.0000001)
        .select(F.lit("weights_above_one").alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "rows")
    )
    return Checked(checked.clean, checked.violations.unionByName(over))


def normalize_series(df: DataFrame, value: str, keys: list[str] | None = None, order: str | None = None,
                     return_name: str = "daily_return") -> DataFrame:
    """One value per (keys, date), the last by ``order``, with its daily return."""
    keys = keys or []
    one = latest_per_key(df, [*keys, "trade_date"], [order]) if order else df
    w = Window.partitionBy(*keys).orderBy("trade_date") if keys else Window.orderBy("trade_date")
    return one.withColumn(return_name, F.col(value) / F.lag(value).over(w) - 1.0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
