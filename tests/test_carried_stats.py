"""Statistics of carried rows come from one pass over blocks of days, equal to those of the rows generated day by day."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import crosssection, factors
from tidemark.operators.crosssection import carried_stats, winsorized_zscores


def spans_of(spark, days, symbols, seed=3):
    rng, rows, odd = random.Random(seed), [], [None, float("nan"), -0.0, 1e300, -1e300, 2.0]
    for s in range(symbols):
        day = rng.randrange(4)
        while day < days:
            until = min(days - 1, day + rng.choice([0, 0, 1, 3, 30]))
            value = rng.choice(odd) if rng.random() < 0.1 else rng.gauss(0, 1)
            rows.append((f"s{s}", day, until, value, float(s % 3), None))
            day = until + 1 + rng.choice([0, 0, 0, 5])
    return spark.createDataFrame(rows, "symbol string, _from int, _until int, x double, y double, none double")


def test_equal_to_rows_of_every_day(spark, monkeypatch):
    names = ["x", "y", "none"]
    spans = spans_of(spark, 90, 40)
    dense = spans.withColumn("_day", F.explode(F.sequence("_from", "_until")))
    want = {(r["_day"], r.symbol): r for r in winsorized_zscores(dense, ["_day"], names).collect()}
    for blocks in (1, 7, 200):
        monkeypatch.setattr(crosssection, "BLOCKS", blocks)
        stats = carried_stats(spans, names, 0.05, 0.95)
        got = winsorized_zscores(dense, ["_day"], names, stats=stats).collect()
        assert len(got) == len(want) and stats.count() == dense.select("_day").distinct().count()
        for r in got:
            for z in ("z_x", "z_y", "z_none"):
                a, b = r[z], want[r["_day"], r.symbol][z]
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (r, b)


def test_blocks_hold_about_as_many_rows_and_every_day():
    edges = crosssection._block_edges([0, 1, 5, 6, 7], [1, 1, 1000, 1, 1], 9)
    assert edges[0][0] == 0 and edges[-1][1] == 9 and all(a[1] + 1 == b[0] for a, b in zip(edges, edges[1:], strict=False))
    assert edges == [(0, 5), (6, 9)] and crosssection._block_edges([], [], -1) == []


def test_no_spans(spark):
    assert carried_stats(spans_of(spark, 0, 3), ["x"], 0.05, 0.95).count() == 0


def test_rows_are_dealt_by_block_not_counted_by_day(spark, monkeypatch):
    """A carried row is not taken apart into a value per day and factor."""
    import datetime as dt

    def refused(*_, **__):
        raise AssertionError("values of every day are counted")

    monkeypatch.setattr(crosssection, "quantile_columns", refused)
    day = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([(s, day + dt.timedelta(n), 10.0 + n % 7 + len(s), 1e9) for s in ("A", "BB") for n in range(70) if s == "A" or n != 65], "symbol string, trade_date date, close double, amount double")
    got = factors.historical_rankings(bars)
    assert {r["rank"] for r in got.collect()} <= {1, 2} and got.count() == 19


def test_panel_is_dealt_by_symbol_once(spark, monkeypatch):
    import datetime as dt

    seen, plain = [], factors.settled
    monkeypatch.setattr(factors, "settled", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    day = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([(s, day + dt.timedelta(n), 10.0 + n % 7 + len(s), 1e9) for s in ("A", "BB") for n in range(70) if s == "A" or n != 65], "symbol string, trade_date date, close double, amount double")
    got = factors.historical_rankings(bars)
    (spans,) = [p for p in seen if "MapInArrow" in p]
    assert spans.count("Exchange hashpartitioning(symbol") == 1
    assert sorted((r.as_of.day, r.symbol) for r in got.where("as_of >= '2024-03-06'").collect()) == [(6, "A"), (7, "A"), (7, "BB"), (8, "A"), (8, "BB"), (9, "A"), (9, "BB"), (10, "A"), (10, "BB")]
