"""Domain tables derived from the driver's TPC-H-like parquet tables.

The registered queries run the operators over these views of the whole tables.  Dates are
shifted by 25 years so that every dated trading rule is crossed by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.normalize import TRANSITION_SOURCE

SHIFT_DAYS = 9131


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code(key: str | Column) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.lpad(col.cast("string"), 6, "0")


def shifted(column: str) -> Column:
    return F.date_add(F.to_date(column), SHIFT_DAYS)


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by symbol and day.  They are dealt by symbol before they are added up, so one exchange serves the bars and
    what reads them symbol by symbol; hardly two lines share a symbol and day, so adding up before it would keep nearly all.
    A least or greatest struct is added up in order of the keys, which holds no row per key and spares windows their sort."""
    null = F.lit(None).cast("double")
    lines = table(spark, sf, "lineitem").select(
        code("l_suppkey").alias("symbol"), shifted("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), "l_quantity", "l_extendedprice",
    ).repartition("symbol")
    line = F.when(F.col("seq").isNotNull(), F.struct("seq", "price"))
    return (
        lines.groupBy("symbol", "trade_date")
        .agg(
            F.min(line)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(line)["price"].alias("close"),
            F.sum("l_quantity").alias("volume"), F.sum(money("l_extendedprice")).cast("double").alias("amount"),
        )
        .select(
            "symbol", "trade_date", "open", "high", "low", "close", "volume", "amount",
            null.alias("amplitude_pct"), null.alias("change_pct"), null.alias("change"), null.alias("turnover_pct"),
        )
    )


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as text bars: copies of a day, zero prices and broken numbers included."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    text = F.when(F.col("l_discount") == 0.10, "n/a").when(F.col("l_discount") == 0.09, "0").otherwise(price.cast("string"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), shifted("l_shipdate").cast("string").alias("trade_date"), text.alias("close"),
        *[price.cast("string").alias(c) for c in ("open", "high", "low")], F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"),
        *[F.lit(None).cast("double").alias(c) for c in ("amplitude_pct", "change_pct", "change", "turnover_pct")],
    )


def _exchange(nation: Column) -> Column:
    return F.when(nation % 3 == 0, "SSE").when(nation % 3 == 1, "SZSE").otherwise("BSE")


def _board(nation: Column, key: Column) -> Column:
    return (
        F.when(nation % 3 == 0, F.when(key % 4 == 0, "科创板").otherwise("上证主板"))
        .when(nation % 3 == 1, F.when(key % 4 == 0, "创业板").otherwise("深证主板")).otherwise("北交所")
    )


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    delist = F.when(k % 9 == 4, F.date_add(F.lit("2024-01-01").cast("date"), (k * 53 % 700).cast("int")))
    return table(spark, sf, "supplier").select(
        code("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), _exchange(n).alias("exchange"), _board(n, k).alias("board"),
        F.date_add(F.lit("2019-06-01").cast("date"), (k * 37 % 900).cast("int")).alias("list_date"), delist.alias("delist_date"),
        delist.isNull().alias("currently_listed"),
    )


def master(spark: SparkSession, sf: str) -> DataFrame:
    k, n, bal = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(nation, "s_nationkey").select(
        code("s_suppkey").alias("symbol"), F.when(bal < 0, F.concat(F.lit("*ST "), F.col("s_name"))).otherwise(F.col("s_name")).alias("name"),
        _exchange(n).alias("exchange"), _board(n, k).alias("board"),
        F.date_add(F.lit("2019-06-01").cast("date"), (k * 37 % 900).cast("int")).alias("list_date"),
        F.when(n % 7 != 3, F.col("n_name")).alias("industry"), F.round(F.abs(bal) * 1000).alias("total_shares"),
        F.when(k % 5 != 2, F.round(F.abs(bal) * 600)).alias("float_shares"), (bal < 0).alias("is_st"), (k % 9 != 4).alias("is_listed"),
        F.lit("2027-01-01 08:00:00").cast("timestamp").alias("observed_at"),
    )


SNAPSHOTS = ["2024-06-30 08:00:00", "2025-06-30 08:00:00", "2026-06-30 08:00:00"]


def master_history(spark: SparkSession, sf: str) -> DataFrame:
    """Three snapshots: names listed by then, ST flag turning over with the balance's parity."""
    times = F.array(*[F.struct(F.lit(t).cast("timestamp").alias("observed_at"), F.lit(i).alias("_i")) for i, t in enumerate(SNAPSHOTS)])
    base = master(spark, sf).drop("observed_at").select("*", F.inline(times))
    flip = (F.col("total_shares").cast("long") + F.col("_i")) % 4 == 0
    return base.where(F.col("list_date") <= F.date_sub(F.to_date("observed_at"), 1500 - 300 * F.col("_i"))).withColumn("is_st", flip).drop("_i")


def spot(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("symbol").cast("long")
    last = bars(spark, sf).groupBy("symbol").agg(F.max_by(F.struct("close", "amount"), "trade_date").alias("r"))
    null = F.lit(None).cast("double")
    return last.select(
        "symbol", F.concat(F.when(k % 13 == 5, "ST ").otherwise(""), F.lit("N"), F.col("symbol")).alias("name"), F.col("r.close").alias("last"),
        F.col("r.amount").alias("amount"), null.alias("turnover_pct"), (F.col("r.close") * 1000).alias("market_cap"),
        F.when(k % 10 != 0, F.col("r.close") * 500).alias("float_market_cap"),
    )


def order_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw spot rows from orders: prefixed codes, several copies per code, zero and missing values."""
    k = F.col("o_custkey")
    head = F.when(k % 5 == 0, "sh600").when(k % 5 == 1, "sz000").when(k % 5 == 2, "sz300").when(k % 5 == 3, "bj830").otherwise("x")
    return table(spark, sf, "orders").select(
        F.concat(head, F.lpad((k % 1000).cast("string"), 3, "0")).alias("代码"),
        F.concat(F.when(k % 7 == 0, "*ST").otherwise("N"), k.cast("string")).alias("名称"),
        F.when(F.col("o_orderkey") % 11 == 0, "0").when(F.col("o_orderkey") % 17 == 0, "-").otherwise((F.col("o_totalprice") / 1000).cast("string")).alias("最新价"),
        F.col("o_totalprice").alias("成交额"), F.col("o_orderkey").alias("seq"),
    )


METRICS = {
    "1-URGENT": "利润表::营业总收入", "2-HIGH": "利润表::净利润", "3-MEDIUM": "现金流量表::经营活动产生的现金流量净额",
    "4-NOT SPECIFIED": "资产负债表::资产总计", "5-LOW": "资产负债表::负债合计",
}


def facts(spark: SparkSession, sf: str) -> DataFrame:
    metric = F.when(F.lit(False), F.lit(""))
    for priority, name in METRICS.items():
        metric = metric.when(F.col("o_orderpriority") == priority, name)
    day = shifted("o_orderdate")
    quarter_end = F.date_sub(F.trunc(day, "quarter"), 1)
    rows = table(spark, sf, "orders").select(
        code(F.floor(F.col("o_custkey") / 15)).alias("symbol"), metric.alias("metric"), quarter_end.cast("timestamp").alias("period_end"),
        day.cast("timestamp").alias("available_at"), F.col("o_orderstatus").alias("source"), money("o_totalprice").alias("_v"),
    )
    net = F.sum("_v").cast("double") - F.when(F.contains(F.col("metric"), F.lit("净利润")), 60000.0).otherwise(0.0)
    return rows.groupBy("symbol", "metric", "period_end", "available_at", "source").agg(F.round(net, 2).alias("value")).select(
        "symbol", "metric", "value", "period_end", "available_at", "source"
    )


def raw_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw facts: duplicate keys and facts visible before their period ends included."""
    day = shifted("o_orderdate")
    early = F.when(F.col("o_orderkey") % 19 == 0, F.date_add(day, 30)).otherwise(F.date_sub(F.trunc(day, "month"), 1))
    return table(spark, sf, "orders").select(
        F.floor(F.col("o_custkey") / 15).cast("string").alias("symbol"), F.col("o_orderpriority").alias("metric"),
        F.when(F.col("o_orderkey") % 23 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
        early.cast("string").alias("period_end"), day.cast("string").alias("available_at"), F.col("o_orderstatus").alias("source"),
    )


def statements(spark: SparkSession, sf: str) -> DataFrame:
    day = shifted("o_orderdate")
    rows = table(spark, sf, "orders").select(
        F.floor(F.col("o_custkey") / 15).cast("string").alias("symbol"), F.date_sub(F.trunc(day, "quarter"), 1).alias("q"), day.alias("d"),
        money("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"),
    )
    g = rows.groupBy("symbol", "q").agg(
        F.min("d").alias("a"), F.max(F.when(F.col("s") == "F", F.col("d"))).alias("u"), F.sum("v").alias("r"), F.sum(F.when(F.col("s") == "O", F.col("v"))).alias("p"),
    )
    return g.select(
        "symbol", F.lit("利润表").alias("statement"), F.col("q").cast("string").alias("报告日"), F.col("a").cast("string").alias("公告日期"),
        F.col("u").cast("string").alias("更新日期"), F.lit("CNY").alias("币种"), F.col("r").cast("string").alias("营业收入"), F.col("p").cast("string").alias("净利润"),
    )


def equity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string")).alias("portfolio_id"), shifted("o_orderdate").alias("trade_date")
    ).agg((F.sum(money("o_totalprice")).cast("double") + 1000000.0).alias("equity"))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    day = table(spark, sf, "orders").groupBy(shifted("o_orderdate").alias("trade_date")).agg(
        F.sum(money("o_totalprice")).cast("double").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return day.select("trade_date", (F.col("s") / F.col("n") / 100 + 3000).alias("close"))


def order_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(shifted("o_orderdate").alias("trade_date")).distinct()


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), (F.col("l_orderkey") % 3).cast("string")).alias("portfolio_id"), shifted("l_shipdate").alias("trade_date"), code("l_suppkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").alias("notional"),
        F.when(F.col("l_linestatus") == "F", "etf").otherwise("stock").alias("instrument_type"), F.col("l_quantity").alias("quantity"),
        "l_orderkey", "l_linenumber",
    )


def archive_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-grain archive of all names."""
    return _quarters(spark, sf).select("symbol", "trade_date", "amount")


def archive_states(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-grain states of all names."""
    return _states(_quarters(spark, sf))


def gap_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """The archive with gaps, for what finds and mends them: in every seventh quarter thinly traded names have no amount."""
    return _quarters(spark, sf).where(~((F.col("qno") % 7 == 3) & (F.col("top") < 48))).select("symbol", "trade_date", "amount")


def gap_states(spark: SparkSession, sf: str) -> DataFrame:
    """The states with gaps: in every fifth quarter thinly traded names have no state."""
    return _states(_quarters(spark, sf).where(~((F.col("qno") % 5 == 0) & (F.col("top") < 48))))


def _states(quarters: DataFrame) -> DataFrame:
    return quarters.select("symbol", "trade_date", (F.col("n") % 5 == 0).alias("is_st"), (F.col("qty") % 7 != 0).alias("trade_status"), F.col("px").alias("close"))


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    day = F.trunc(shifted("l_shipdate"), "quarter")
    g = table(spark, sf, "lineitem").groupBy(code("l_suppkey").alias("symbol"), day.alias("trade_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"), F.max("l_quantity").alias("top"),
        F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.sum(money("l_extendedprice")).cast("double").alias("amount"),
    )
    return g.withColumn("qno", F.year("trade_date") * 4 + F.quarter("trade_date"))


def states_daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(code("user_id").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(
        F.bool_or(F.col("event_type") == "error").alias("is_st"), F.bool_or(F.col("event_type") != "signup").alias("trade_status"), F.max("value").alias("close"),
    )


def raw_states(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw state rows: many copies per day and unknown flags included."""
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").cast("string").alias("trade_date"),
        F.when(e == "error", "1").when(e == "view", "maybe").otherwise("False").alias("is_st"), F.when(e == "signup", "0").otherwise("TRUE").alias("trade_status"),
        F.when(F.col("event_id") % 29 == 0, "x").otherwise(F.col("value").cast("string")).alias("close"),
    )


def name_changes(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(code("user_id").alias("symbol"), F.to_date("ts").alias("change_date")).agg(
        F.min("event_id").alias("e")
    )
    e = F.col("e")
    before = e % 2 == 0
    after = F.when(e % 5 == 0, before).otherwise(~before)
    label = lambda st, tail: F.concat(F.when(st, "*ST").otherwise(""), F.lit("N"), F.col("symbol"), tail)
    return g.select(
        "symbol", "change_date", label(before, F.lit("")).alias("old_name"), label(after, F.when(e % 11 == 0, "退").otherwise("")).alias("new_name"),
        before.alias("is_st_before"), after.alias("is_st_after"), (before != after).alias("st_transition"),
        F.when(e % 13 == 0, "other").otherwise(TRANSITION_SOURCE).alias("source"),
    )


def verified_events(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(code("user_id").alias("symbol"), F.to_date("ts").alias("d")).agg(F.min("event_id").alias("e"))
    e = F.col("e")
    after = e % 2 == 0
    return g.select(
        "symbol", F.concat(F.when(e % 3 == 0, "SSE").otherwise("SZSE"), F.when(after == (e % 7 != 0), "_apply").otherwise("_remove")).alias("cohort"),
        F.date_sub("d", (e % 4).cast("int") - 1).cast("timestamp").alias("announcement_time"), F.col("d").alias("effective_date"),
        F.when(after, "apply_st").otherwise("remove_st").alias("action"), (~after).cast("string").alias("is_st_before"), after.cast("string").alias("is_st_after"),
        F.when(e % 17 == 0, "ftp://x").otherwise("http://x").alias("pdf_url"), F.when(e % 19 == 0, "bad").otherwise(F.sha2(e.cast("string"), 256)).alias("pdf_sha256"),
    )


def raw_announcements(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    head = F.when(k % 4 == 0, "600").when(k % 4 == 1, "000").when(k % 4 == 2, "300").otherwise("900")
    title = (
        F.when(n % 6 == 0, "关于撤销退市风险警示的公告").when(n % 6 == 1, "关于股票交易被实施其他风险警示的公告").when(n % 6 == 2, "终止上市提示")
        .when(n % 6 == 3, "撤销公司股票*ST标识").when(n % 6 == 4, "实施风险警示").otherwise("")
    )
    millis = F.lit(1704067200000) + k * 3600000
    return table(spark, sf, "documents").select(
        F.concat(head, F.lpad((k % 1000).cast("string"), 3, "0")).alias("secCode"), F.col("source").alias("secName"),
        F.concat(title, F.col("text")).alias("announcementTitle"), F.when(k % 41 == 0, "").otherwise(millis.cast("string")).alias("announcementTime"),
        F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("announcementId"), F.col("lang").alias("orgId"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("/finalpage/"), k.cast("string"), F.lit(".PDF"))).alias("adjunctUrl"), F.lit("PDF").alias("adjunctType"),
    )


def announcement_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each followed by a notice whose form depends on the document."""
    k, n = F.col("doc_id"), F.col("n_chars")
    a, b = F.concat(F.lit("甲"), (n % 7).cast("string")), F.concat(F.lit("ST乙"), (n % 5).cast("string"))
    month, day = (k % 12 + 1).cast("string"), (k % 28 + 1).cast("string")
    quoted = lambda x, y: F.concat(F.lit("公司股票简称由“"), x, F.lit("”变更为“"), y, F.lit("”，"))
    plain = lambda x, y: F.concat(F.lit("证券简称由"), x, F.lit("变更为"), y, F.lit("。"))
    start = F.concat(month, F.lit("月"), day, F.lit("日"))
    notice = (
        F.when(n % 8 == 0, F.concat(quoted(a, b), F.lit("自2024年"), start, F.lit("开市起实施退市风险警示。")))
        .when(n % 8 == 1, F.concat(plain(b, a), F.lit("风险警示的起始日为"), start, F.lit("，撤销其他风险警示")))
        .when(n % 8 == 2, F.concat(quoted(b, a), F.lit("自"), start, F.lit("起撤销风险警示，继续被实施其他风险警示")))
        .when(n % 8 == 3, quoted(a, a)).when(n % 8 == 4, F.concat(quoted(a, b), F.lit("风险警示")))
        .when(n % 8 == 5, F.concat(quoted(a, b), quoted(b, a), F.lit("自2024年"), start, F.lit("起实施风险警示，撤销风险警示")))
        .when(n % 8 == 6, F.concat(quoted(a, b), F.lit("自1999年"), start, F.lit("起实施风险警示"))).otherwise("")
    )
    return table(spark, sf, "documents").select(
        "doc_id", code("doc_id").alias("symbol"), F.concat(F.col("text"), F.lit("\n"), notice).alias("text"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 360).cast("int")).cast("timestamp").alias("announcement_time"),
    )


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Month-grain rankings by traded amount with a month's last price and its trend.  Ranks read the months twice: they are settled."""
    from pyspark.sql import Window

    from tidemark.operators.crosssection import rank_min
    from tidemark.sources.scratch import settled

    month = F.trunc("trade_date", "month")
    monthly = bars(spark, sf).groupBy("symbol", month.alias("as_of")).agg(
        (F.max_by("close", "trade_date") / 100).alias("close"), F.sum(money("amount")).cast("double").alias("amount")  # exact, so that equal amounts tie
    )
    w = Window.partitionBy("symbol").orderBy("as_of")
    past = (F.col("close") + F.lag("close", 1).over(w) + F.lag("close", 2).over(w)) / 3
    dated = monthly.withColumns({
        "momentum_20": F.col("close") / F.lag("close").over(w) - 1.0, "trend_close_ma20": F.col("close") / past - 1.0,
    })
    life = lifecycle(spark, sf).select("symbol", "name", "exchange", "board", (F.col("symbol").cast("long") % 11 == 3).alias("is_st"))
    return rank_min(settled(dated), ["as_of"], "amount", "rank").join(life, "symbol")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weight signals of the five best ranked names, one portfolio."""
    from tidemark.operators.portfolio import equal_weight_signals

    return equal_weight_signals(rankings(spark, sf), 5).select(
        F.lit("EW").alias("portfolio_id"), "trade_date", "symbol", "target_weight", "board", "is_st", F.lit("stock").alias("instrument_type")
    )
