import random

from helpers import business_days
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import factors as W
from tidemark.sources import tables as IO

GATES = {"min_average_amount": 0.0}


def _rows(r, symbol, days):
    out = []
    for d in days:
        close = r.uniform(5, 20)
        out.append((symbol, d, close, close * 1.01, close * 0.99, close, r.uniform(1e3, 1e5), r.uniform(1e6, 1e8)))
    return out


def _bars(spark, rows):
    names = ["symbol", "trade_date", "open", "high", "low", "close", "volume", "amount"]
    return spark.createDataFrame([tuple(dict(zip(names, r, strict=True)).get(n) for n in S.BARS.names) for r in rows], S.BARS)


def _same(got, want):
    cols = want.columns
    key = lambda r: (r["symbol"], r["trade_date"])
    a, b = (sorted((r.asDict() for r in df.select(*cols).collect()), key=key) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for c in cols:
            assert x[c] == y[c] or abs(x[c] - y[c]) <= 1e-9 * max(1.0, abs(y[c])), (c, x, y)


def test_ten_days_of_updates_equal_the_whole_panel(spark, tmp_path):
    r, days = random.Random(4), business_days("2024-01-02", 110)
    history = {"000001": days[:95], "000002": days[:61], "000003": days[:20], "000004": days[:95:2]}
    rows = [x for s, d in history.items() for x in _rows(r, s, d)]
    bars, root = str(tmp_path / "bars"), str(tmp_path / "factors")
    IO.write_bars(_bars(spark, rows), bars, buckets=3)
    IO.build_panel(spark, bars, root, **GATES)
    for k in range(95, 105):
        new = [x for s in ("000001", "000002", "000003") if k % 4 or s != "000003" for x in _rows(r, s, [days[k]])]
        if k == 97:
            new += _rows(r, "000005", [days[k]])  # a new symbol
        if k == 99:
            new += _rows(r, "000001", [days[10], days[93]])  # corrections, one far back
        if k == 101:
            new += _rows(r, "000004", [days[31]]) + _rows(r, "000002", [days[70]])  # bars that were missing
        IO.update_panel(spark, _bars(spark, new), bars, root, **GATES)
    IO.update_panel(spark, _bars(spark, new), bars, root, **GATES)  # the same day again
    stored = IO.read_bars(spark, bars)
    _same(spark.read.parquet(f"{root}/panel"), W.factor_panel(stored, **GATES))
    _same(spark.read.parquet(f"{root}/tail"), W.panel_tail(stored))


def test_only_reachable_rows_are_made_again(spark):
    r, days = random.Random(5), business_days("2024-01-02", 200)
    bars = _bars(spark, _rows(r, "000001", days))
    changed = spark.createDataFrame([("000001", days[20], False), ("000001", days[150], False)], "symbol string, trade_date date, inserted boolean")
    again = W.changed_panel(bars, changed, **GATES)
    assert {x["trade_date"] for x in again.collect()} == set(days[20:81]) | set(days[150:])
    _same(again, W.factor_panel(bars, **GATES).join(again.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_semi"))
    tail = W.panel_tail(bars.where(F.col("trade_date") < F.lit(days[190])))
    rows, after = W.extend_panel(tail, bars.where(F.col("trade_date") >= F.lit(days[190])), **GATES)
    _same(rows, W.factor_panel(bars, **GATES).where(F.col("trade_date") >= F.lit(days[190])))
    _same(after, W.panel_tail(bars))
