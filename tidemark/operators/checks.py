"""Row rules and key uniqueness as queries: clean rows plus a violations table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    """Raised by the fail-closed variants when a gate does not hold."""


class Checked(NamedTuple):
    clean: DataFrame
    violations: DataFrame

    def require(self) -> DataFrame:
        """Fail closed: one small job that stops at the first violation found."""
        first = self.violations.take(1)
        if first:
            raise DataQualityError(f"data-quality rule failed: {first[0].asDict()}")
        return self.clean


def failed_rules(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules a row breaks; a NULL condition counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def check_rows(
    df: DataFrame, key: list[str], rules: dict[str, Column], unique: list[str] | None = None
) -> Checked:
    """Apply row rules and an optional unique key.

    The key test is one aggregation by the key itself, so copies of a hot key meet already
    combined map-side; there is no self-join and no window over a key's copies.
    """
    columns = df.columns
    ruled = df.withColumn("_broken", failed_rules(rules)) if rules else df.withColumn(
        "_broken", F.array().cast("array<string>")
    )
    row_bad = ruled.where(F.size("_broken") > 0).select(
        F.explode("_broken").alias("rule"), key_text(key).alias("key"), F.lit(1).cast("long").alias("rows")
    )
    good = ruled.where(F.size("_broken") == 0).drop("_broken")
    if not unique:
        return Checked(good, row_bad)
    others = [c for c in columns if c not in unique]
    grouped = good.groupBy(*unique).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others]
    )
    clean = grouped.where(F.col("_n") == 1).select(*columns)
    # The key rule reads all rows, broken or not, as a duplicate is a duplicate either way.
    dup = (
        df.groupBy(*unique).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
        .select(F.lit("duplicate_key").alias("rule"), key_text(unique).alias("key"), "rows")
    )
    return Checked(clean, row_bad.unionByName(dup))


def key_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns])


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``; an aggregate, so copies of a hot key combine map-side."""
    others = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*others), rank).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def require_columns(df: DataFrame, needed: list[str], what: str) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing columns: {missing}")
