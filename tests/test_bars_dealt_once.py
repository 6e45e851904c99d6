"""Bars are dealt by symbol once, and dates reach the tasks without dealing the bars again."""

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.asof import panel_as_of
from tidemark.operators.portfolio import etf_snapshot
from tidemark.sources import views as V

SF = "/root/testdata/sf0.001"


def _dealt(df, column):
    """Exchanges of the plan by hash of ``column``."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"Exchange hashpartitioning\({column}#", text)), len(re.findall("Exchange hashpartitioning", text))


def test_bars_are_dealt_by_symbol_once(spark):
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    assert _dealt(V.bars(spark, SF).withColumn("before", before), "symbol") == (1, 1)


def test_bars_hold_no_row_per_key_while_adding_up(spark):
    assert "HashAggregate" not in V.bars(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_snapshot_deals_bars_once(spark):
    dates = spark.createDataFrame([(dt.date(2023, 6, 1),), (dt.date(2022, 1, 1),)], "trade_date date")
    assert _dealt(etf_snapshot(V.bars(spark, SF), dates), "symbol")[0] == 1
    assert _dealt(etf_snapshot(V.bars(spark, SF), dates), "trade_date")[0] <= 1  # the asked dates themselves


def test_bars_equal_least_and_greatest_line(spark):
    lines = V.table(spark, SF, "lineitem").selectExpr("lpad(cast(l_suppkey as string), 6, '0') symbol", "date_add(to_date(l_shipdate), 9131) trade_date", "l_extendedprice / l_quantity p", "l_orderkey * 100 + l_linenumber s")
    want = lines.groupBy("symbol", "trade_date").agg(F.min_by("p", "s").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "s").alias("close"))
    got = V.bars(spark, SF).select(*want.columns)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_panel_as_of_edges(spark):
    d = lambda n: dt.date(2024, 1, n)
    panel = spark.createDataFrame([("A", d(1), 1), ("A", d(2), 2), ("A", d(6), 3), ("A", d(20), 4), ("B", d(10), 5), ("B", d(11), 6), ("C", d(21), 7)], "symbol string, trade_date date, x int")
    dates = spark.createDataFrame([(d(5),), (d(10),), (d(12),), (d(5),)], "trade_date date")
    rows = {(r.as_of.day, r.symbol): (r.bar_date.day, r.x) for r in panel_as_of(panel, dates, ["x"]).collect()}
    assert rows == {(5, "A"): (2, 2), (10, "A"): (6, 3), (12, "A"): (6, 3), (10, "B"): (10, 5), (12, "B"): (11, 6)}
    assert panel_as_of(panel, dates.limit(0), ["x"]).isEmpty()
