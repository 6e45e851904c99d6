import math

from pyspark.sql import functions as F

from tidemark.operators import factors as W

KINDS = "symbol string, trade_date date, close double, amount double"


def odd_bars(spark):
    """Symbols of different lengths, with missing closes and amounts and a NaN."""
    rows = spark.sql("SELECT lpad(string(s), 6, '0') AS symbol, date_add(date'2024-01-01', int(d)) AS trade_date, s, d FROM (SELECT explode(array(1, 19, 20, 21, 59, 60, 61, 62, 130)) AS s) LATERAL VIEW explode(sequence(1, s)) AS d")
    k = F.pmod(F.xxhash64("s", "d"), F.lit(1000))
    return rows.select(
        "symbol", "trade_date", F.when(k % 41 != 0, 10 + k / 77).alias("close"),
        F.when((F.col("s") == 130) & (F.col("d") == 125), float("nan")).when(k % 23 != 0, 1e6 * k).alias("amount"))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_panel_equals_the_registered_windows_across_batches(spark):
    bars, w = odd_bars(spark), W.by_symbol()
    names = [f for f in W.FACTORS if f != "max_drawdown_60"]
    plain = W.rolling_drawdown(W.daily_returns(bars.withColumn("bar_no", F.row_number().over(w))).select("symbol", "trade_date", "close", "amount", "bar_no", "previous_close", "daily_return"))
    plain = plain.select("symbol", "trade_date", "close", "previous_close", "max_drawdown_60", "bar_no", F.avg("amount").over(W.trailing(w, 20)).alias("average_amount_20"), *[W._REGISTRY[n](w).alias(n) for n in names])
    want = {(r["symbol"], r["trade_date"]): r.asDict() for r in plain.collect()}
    for size in ("7", "100", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            panel = W.factor_panel(bars)
            got = {(r["symbol"], r["trade_date"]): r.asDict() for r in panel.drop("reason").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys() and len(want) == 433
        assert [(k, c, got[k][c], want[k][c]) for k in want for c in want[k] if not same(got[k][c], want[k][c])] == []
    assert "avg(" not in panel._jdf.queryExecution().executedPlan().toString()  # frames are not added up row by row


def test_one_panel_serves_all_results(spark):
    bars = odd_bars(spark).withColumn("amount", F.coalesce(F.nanvl("amount", F.lit(3e7)), F.lit(3e7)) + 3e7)
    candidates = bars.select(F.col("trade_date").alias("as_of"), "symbol", F.lit("x").alias("board"), F.lit(False).alias("is_st"))
    results = [W.factor_engine(bars)[1], *W.strict_rankings(bars, candidates)]
    for df in results:
        files = df.inputFiles()
        assert files and all("settled" in f for f in files)
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
