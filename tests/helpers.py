"""Small frames shared by the tests."""

from datetime import date, datetime, timedelta

import pandas as pd

from tidemark import schema as S


def business_days(start: str, n: int) -> list[date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def trend_bars(spark, specs, n=80, start="2024-01-02"):
    """specs: (symbol, slope, amount); close = 10 + slope * i."""
    rows = []
    for symbol, slope, amount in specs:
        for i, day in enumerate(business_days(start, n)):
            c = 10 + slope * i
            rows.append((symbol, day, c * 0.995, c * 1.01, c * 0.99, c, 2e6, amount, None, None, None, None))
    return spark.createDataFrame(rows, S.BARS)


def bars_from(spark, rows):
    """rows: (symbol, day, open, close, volume)."""
    full = [(s, d, float(o), float(max(o, c)), float(min(o, c)), float(c), float(v), 1e7, None, None, None, None) for s, d, o, c, v in rows]
    return spark.createDataFrame(full, S.BARS)


def day(text: str) -> date:
    return date.fromisoformat(text)


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows(df, *columns, order=None):
    out = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(out, key=lambda t: tuple(str(x) for x in t)) if order is None else sorted(out, key=order)


def plus(d: date, n: int) -> date:
    return d + timedelta(days=n)
