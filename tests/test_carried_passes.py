"""Carried rows are not dealt to find quantiles, and the panel is not made a second time for its days."""

import datetime as dt

from tidemark.operators import factors
from tidemark.operators.crosssection import quantile_columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_the_wanted_ranges_without_being_dealt(spark):
    df = spark.range(2_000_000).selectExpr("id % 7 AS k", "cast(id % 1009 AS double) AS x", "cast(-id AS double) AS y")
    plan = _plan(quantile_columns(df, ["k"], ["x", "y"], [0.05, 0.95]))
    assert plan.count("SortMergeJoin") <= 1  # that of the results per key


def test_quantiles_of_null_keys_signs_and_infinities(spark):
    inf = float("inf")
    rows = [(None, x) for x in (-inf, -2.0, -0.0, 0.0, 3.0)] + [("a", x) for x in (1.0, 1.0, 4.0, None, float("nan"))] + [("b", None)]
    got = quantile_columns(spark.createDataFrame(rows, "k string, x double"), ["k"], ["x"], [0.25, 0.5, 1.0]).collect()
    assert {r.k: (r.x_q0, r.x_q1, r.x_q2) for r in got} == {None: (-2.0, 0.0, 3.0), "a": (1.0, 1.0, 4.0), "b": (None, None, None)}


def test_days_are_those_of_the_bars(spark, monkeypatch):
    seen, plain = [], factors.calendar_index
    monkeypatch.setattr(factors, "calendar_index", lambda df: seen.append(_plan(df)) or plain(df))
    day = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([(s, day + dt.timedelta(n), 10.0 + n % 7 + len(s), 1e9) for s in ("A", "BB") for n in range(70)], "symbol string, trade_date date, close double, amount double")
    assert factors.historical_rankings(bars).count() > 0
    assert seen and not any("MapInArrow" in p for p in seen)


def test_carried_rows_are_ranked_by_their_score_alone(spark, monkeypatch):
    seen, plain = [], factors.rank_min
    monkeypatch.setattr(factors, "rank_min", lambda df, *a, **k: seen.append(df) or plain(df, *a, **k))
    day = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([(s, day + dt.timedelta(n), 10.0 + n % 7 + len(s), 1e9) for s in ("A", "BB") for n in range(70) if s == "A" or n != 65], "symbol string, trade_date date, close double, amount double")
    factors.historical_rankings(bars)
    carried = [r.asDict() for r in seen[0].where("as_of IS NULL").collect()]
    assert len(carried) == 1 and {c for c, v in carried[0].items() if v is not None} == {"_day", "composite_score"}
