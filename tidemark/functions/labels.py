"""Clock gates, title classes and status labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Shanghai"

# Ordered title patterns, first class that matches wins.
TITLE_CLASSES = [
    ("risk_warning_remove_candidate",
     ["撤销退市风险警示", "撤销其他风险警示", "撤销风险警示", r"撤销.*\*?ST"]),
    ("risk_warning_apply_candidate",
     ["实施退市风险警示", "实施其他风险警示", "实施风险警示", "被实施退市风险警示",
      "被实施其他风险警示", "股票交易被实施.*风险警示"]),
    ("delisting_related", ["终止上市", "退市整理期"]),
]
TITLE_OTHER = "other_risk_disclosure"

DEGRADED_SOURCE_PREFIXES = ("bootstrap_", "candidate_cache_", "history_liquidity_")


def classify_title(title: Column, classes=None, other: str = TITLE_OTHER) -> Column:
    """One CASE, classes in priority order, patterns of a class as one alternation."""
    expr = F.when(F.lit(False), F.lit(""))
    for name, patterns in classes or TITLE_CLASSES:
        expr = expr.when(title.rlike("|".join(f"(?:{p})" for p in patterns)), name)
    return expr.otherwise(other)


def after_close_gate(signal_date: Column, evaluated_at: Column) -> Column:
    """reason code of an evaluation instant (UTC timestamp) for a signal day.

    Eligible from 15:10 local on the signal day until 09:15 local of the next calendar day.
    """
    local = F.from_utc_timestamp(evaluated_at, LOCAL_ZONE)
    midnight = signal_date.cast("date").cast("timestamp")
    earliest = midnight + F.expr("INTERVAL '15:10' HOUR TO MINUTE")
    expires = midnight + F.expr("INTERVAL '1 09:15' DAY TO MINUTE")
    return (
        F.when(F.weekday(signal_date) >= 5, "non_weekday_signal")
        .when(local < earliest, "before_signal_close_or_future_signal")
        .when(local >= expires, "expired_before_preopen")
        .when(local.cast("date") == signal_date.cast("date"), "eligible_after_close")
        .otherwise("eligible_overnight")
    )


def gate_open(reason: Column) -> Column:
    return reason.startswith("eligible_")


def data_quality_label(screen_source: Column, master_source: Column) -> Column:
    """X10."""
    source = F.coalesce(F.nullif(screen_source, F.lit("")), F.lit("unknown"))
    degraded = F.coalesce(master_source, F.lit("unknown")) == "degraded_current_universe"
    for prefix in DEGRADED_SOURCE_PREFIXES:
        degraded = degraded | source.startswith(prefix)
    return F.when(degraded, "degraded").otherwise("normal")


def freshness(refreshed_at: Column, now: Column, fresh_days: int = 7, stale_days: int = 30) -> Column:
    """Fresh / recent / stale by age at ``now``; missing when never refreshed."""
    if fresh_days < 0 or stale_days < fresh_days:
        raise ValueError("need 0 <= fresh_days <= stale_days")
    day = lambda n: F.expr(f"INTERVAL '{int(n)}' DAY")
    return (
        F.when(refreshed_at.isNull(), "missing")
        .when(refreshed_at >= now - day(fresh_days), "fresh")
        .when(refreshed_at >= now - day(stale_days), "recent")
        .otherwise("stale")
    )


def development_gate(c=F.col) -> Column:
    """Seven thresholds over a rolling-block summary row; missing evidence fails."""
    passed = (
        (c("block_count") >= 12)
        & (c("positive_block_rate") >= 0.50)
        & (c("median_max_drawdown") > -0.08)
        & (c("median_turnover") <= 2.0)
        & (c("median_cost_drag") <= 0.01)
        & (c("benchmark_outperformance_rate") >= 0.55)
        & (c("median_excess_return") > 0)
    )
    return F.coalesce(passed, F.lit(False))


def validation_phase(days: Column) -> Column:
    return (
        F.when(days < 20, "collecting").when(days < 60, "first_review").otherwise("rolling_validation")
    )
