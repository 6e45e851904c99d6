"""Exact ranks and quantiles inside cross-sections of any size, by one plan.

A cross-section (all symbols of one date) may hold a few names or most of the table.  Values are
counted by narrow ranges of their size, a step of the logarithm for either sign: small histograms that add
up across tasks.  A quantile is selected by counting: the histogram names the range that holds its
place, and only the different values of that range are put in order.  Ranks are ordered inside a range
and shifted by the counts of the ranges before.  No whole cross-section is ever sorted or gathered, and
only a row per key is written; a caller whose table is costly settles it first.

NaN is a missing value and is read as NULL.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import settled

#: Ranges per doubling of a value.  They decide balance, never results.
STEPS = 32
_ZERO, _LARGEST = 2000, 4000


def _known(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the keys of the left side stay."""
    other = right.toDF(*[f"_k_{c}" if c in keys else c for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys], F.lit(True))
    return left.join(other, same, how).drop(*[f"_k_{k}" for k in keys])


def _range(value: Column, steps: int) -> Column:
    """Number of a value's range, never falling as values rise; NULL for NULL."""
    size = F.abs(value)
    step = F.when(size < float("inf"), F.floor(F.log2(size) * steps) + _ZERO * steps).otherwise(_LARGEST * steps)
    return F.when(value > 0, step).when(value < 0, -step).when(value == 0, F.lit(0).cast("long"))


def rank_min(df: DataFrame, keys: list[str], value: str, out: str, *, descending: bool = True, count_out: str | None = None, steps: int | None = None) -> DataFrame:
    """Rank with ties sharing the lowest rank; NULL and NaN get neither rank nor count."""
    order = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    rows = df.withColumn("_value", _known(F.col(value))).withColumn("_range", _range(F.col("_value"), steps or STEPS))
    group = Window.partitionBy(*keys)
    # counted, then dropped: a filter on the range itself would be pushed into the scores' own expressions, once for each mention
    sizes = rows.groupBy(*keys, "_range").agg(F.count("_range").alias("_size")).where("_size > 0")
    sizes = sizes.withColumn("_before", F.sum("_size").over(group.orderBy(order("_range"))) - F.col("_size")).withColumn("_total", F.sum("_size").over(group)).drop("_size")
    ranked = _on(rows.withColumn("_in", F.rank().over(Window.partitionBy(*keys, "_range").orderBy(order("_value")))), sizes, [*keys, "_range"])
    known = F.col("_value").isNotNull()
    names = {out: F.when(known, (F.col("_before") + F.col("_in")).cast("int"))} | ({count_out: F.when(known, F.col("_total"))} if count_out else {})
    return ranked.select(*[F.col(c) for c in df.columns if c not in names], *[c.alias(n) for n, c in names.items()])


def quantile_columns(df: DataFrame, keys: list[str], factors: list[str], probs: list[float], steps: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key: columns ``<factor>_q<i>`` (NULL without values).

    One pass counts the values by range, one reads the ranges that hold a wanted place.  Those, at most
    2 x probs per key and factor, are settled: their size is known, so they go to the rows where they are
    small enough, and the rows are not dealt for them.
    """
    value = lambda j: F.col(f"_f{j}")
    rows = df.select(*keys, *[_known(F.col(f)).alias(f"_f{j}") for j, f in enumerate(factors)])
    listed = F.array(*[F.struct(F.lit(j).alias("_j"), value(j).alias("_v")) for j in range(len(factors))])
    ranged = rows.select(*keys, F.inline(listed)).where("_v IS NOT NULL").withColumn("_range", _range(F.col("_v"), steps or STEPS))
    counted = ranged.groupBy(*keys, "_j", "_range").agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy(*keys, "_j")
    counted = counted.withColumns({"_to": F.sum("_c").over(of.orderBy("_range")), "_n": F.sum("_c").over(of)}).withColumn("_from", F.col("_to") - F.col("_c"))
    places = [(i, part, (F.col("_n") - 1) * F.lit(float(p))) for i, p in enumerate(probs) for part in ("l", "h")]
    place = {(i, part): (F.floor(pos) if part == "l" else F.ceil(pos)) for i, part, pos in places}
    inside = lambda k: (F.col("_from") <= k) & (k < F.col("_to"))
    wanted = settled(counted.where(reduce(lambda a, b: a | b, [inside(k) for k in place.values()])).select(*keys, "_j", "_range", F.col("_from").alias("_first"), "_n"))
    found = _on(ranged, wanted, [*keys, "_j", "_range"], "inner").groupBy(*keys, "_j", "_first", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    found = found.withColumn("_to", F.col("_first") + F.sum("_c").over(Window.partitionBy(*keys, "_j", "_first").orderBy("_v"))).withColumn("_from", F.col("_to") - F.col("_c"))
    picked = found.groupBy(*keys, "_j").agg(F.max("_n").alias("_n"), *[F.max(F.when(inside(k), F.col("_v"))).alias(f"_{part}{i}") for (i, part), k in place.items()])
    share = lambda i, p: (F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))
    exact = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") * (1 - share(i, p)) + F.col(f"_h{i}") * share(i, p)).alias(f"_q{i}") for i, p in enumerate(probs)]
    picked = picked.select(*keys, "_j", *exact)
    by_factor = [F.max(F.when(F.col("_j") == j, F.col(f"_q{i}"))).alias(f"{f}_q{i}") for j, f in enumerate(factors) for i in range(len(probs))]
    missing = rows.select(*keys).distinct()
    return _on(missing, picked.groupBy(*keys).agg(*by_factor), keys)


PARTS = ("low", "high", "mid", "half")


def _place(value: Column, f: str) -> Column:
    """The clipped value's place between the bounds, -1 to 1."""
    low, high, mid, half = (F.col(f"_{p}_{f}") for p in PARTS)
    return F.when(value.isNotNull(), F.when(half > 0, (F.least(F.greatest(value, low), high) - mid) / half).otherwise(0.0))


def winsorized_zscores(df: DataFrame, keys: list[str], factors: list[str], lower: float = 0.05, upper: float = 0.95, *, prefix: str = "z_", stats: DataFrame | None = None) -> DataFrame:
    """S1 for several factors at once: clip to quantiles, population z-score, 0 when flat.

    Moments are taken of the clipped value's place between the bounds, -1 to 1, so neither large nor
    small values are lost, and mean and square come from one aggregate.  Bounds and moments, a row per
    key, are settled; the table itself is read three times and not written, or once where ``stats`` are known.
    """
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError("need 0 <= lower < upper <= 1")
    rows = df.withColumns({f"_v_{f}": _known(F.col(f)) for f in factors})
    stats = _stats(rows, keys, factors, lower, upper) if stats is None else stats
    z = lambda f: F.when(F.col(f"_v_{f}").isNotNull(), F.when(F.col(f"_s_{f}") > 0, (_place(F.col(f"_v_{f}"), f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(0.0))
    return _on(rows, stats, keys).select(*[F.col(c) for c in df.columns], *[z(f).alias(prefix + f) for f in factors])


def _stats(rows: DataFrame, keys: list[str], factors: list[str], lower: float, upper: float) -> DataFrame:
    """Bounds and moments of each key, settled."""
    narrow = rows.select(*keys, *[F.col(f"_v_{f}").alias(f) for f in factors])
    quantiles = quantile_columns(narrow, keys, factors, [lower, upper])
    ends = [(f, F.col(f"{f}_q0"), F.col(f"{f}_q1")) for f in factors]
    bounds = settled(quantiles.select(*keys, *[x for f, low, high in ends for x in (low.alias(f"_low_{f}"), high.alias(f"_high_{f}"), (low / 2 + high / 2).alias(f"_mid_{f}"), (high / 2 - low / 2).alias(f"_half_{f}"))]))
    # a row per value: one expression for all factors keeps the generated code small
    listed = F.array(*[F.struct(F.lit(j).alias("_j"), _place(F.col(f), f).alias("_v")) for j, f in enumerate(factors)])
    placed = _on(narrow, bounds, keys).select(*keys, F.inline(listed)).where("_v IS NOT NULL")
    moments = placed.groupBy(*keys, "_j").agg(F.avg("_v").alias("_m"), F.avg(F.col("_v") * F.col("_v")).alias("_p"))
    # where the bounds differ, some value lies at either one; where they don't, all places are 0 and so is the spread
    moments = moments.select(*keys, "_j", "_m", F.sqrt(F.greatest(F.lit(0.0), F.col("_p") - F.col("_m") * F.col("_m"))).alias("_s"))
    moments = moments.groupBy(*keys).agg(*[F.max(F.when(F.col("_j") == j, F.col(c))).alias(f"{c}_{f}") for j, f in enumerate(factors) for c in ("_m", "_s")])
    return settled(_on(bounds, moments, keys))


# --- rows that stand in the cross-sections of many days in a row -------------------------------------

#: Blocks of days, and the rows that begin in one, at least.
BLOCKS, BLOCK_ROWS = 64, 1 << 19


def carried_stats(spans: DataFrame, factors: list[str], lower: float, upper: float) -> DataFrame:
    """Bounds and moments of each ``_day``, as ``winsorized_zscores`` takes them, of rows that stand in the cross-sections
    of the days ``_from`` to ``_until``.

    A row is dealt once to each block of days that it reaches, not once a day.  A block is one day at least, so a task
    holds the rows of a day's cross-section; ``spans`` are read twice.
    """
    spark = spans.sparkSession
    begun = spans.groupBy("_from").agg(F.count(F.lit(1)).alias("n"), F.max("_until").alias("last")).orderBy("_from").collect()
    edges = _block_edges([r["_from"] for r in begun], [r.n for r in begun], max((r["last"] for r in begun), default=-1))
    of_day = [(day, k) for k, (low, high) in enumerate(edges) for day in range(low, high + 1)]
    calendar = F.broadcast(spark.createDataFrame(pa.table({c: pa.array([x[i] for x in of_day], pa.int32()) for i, c in enumerate(("_day", "_block"))})))
    table = spans.select("_from", "_until", *[_known(F.col(f)).alias(f"_f{j}") for j, f in enumerate(factors)])
    for day, block in (("_from", "_first"), ("_until", "_last")):
        table = table.join(calendar.toDF(day, block), day)
    dealt = table.withColumn("_block", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    columns = [f"{p}_{f}" for f in factors for p in ("_low", "_high", "_mid", "_half", "_m", "_s")]

    def run(block: pa.Table) -> pa.Table:
        of = lambda c: block.column(c).to_numpy()
        start, end, values = of("_from"), of("_until"), [(of(f"_f{j}"), block.column(f"_f{j}").is_valid().to_numpy()) for j in range(len(factors))]
        made = []
        low, high = edges[block.column("_block")[0].as_py()]
        for day in range(low, high + 1):
            here = np.flatnonzero((start <= day) & (day <= end))
            if len(here):
                made.append([day, *[x for v, known in values for x in _bounds_and_moments(v[here][known[here]], lower, upper)]])
        cols = list(zip(*made, strict=True)) if made else [[]] * (1 + len(columns))
        return pa.table({"_day": pa.array(cols[0], pa.int32()), **{c: pa.array(x, pa.float64()) for c, x in zip(columns, cols[1:], strict=True)}})

    return settled(dealt.groupBy("_block").applyInArrow(run, ", ".join(["_day int", *[f"`{c}` double" for c in columns]])))


def _block_edges(days: list[int], counts: list[int], last: int) -> list[tuple[int, int]]:
    """First and last day of contiguous blocks in which about as many rows begin; on each of ``days``, in order, some do."""
    if not days:
        return []
    counts, blocks = np.array(counts, np.int64), max(BLOCKS, sum(counts) // BLOCK_ROWS)
    block = (np.cumsum(counts) - counts) * blocks // counts.sum()
    starts = [days[i] for i in np.flatnonzero(np.diff(block, prepend=-1))]
    return list(zip(starts, [*[x - 1 for x in starts[1:]], last], strict=True))


def _bounds_and_moments(values: np.ndarray, lower: float, upper: float) -> list[float | None]:
    """low, high, mid, half, mean and spread of a day's values, by the formulas of ``quantile_columns`` and ``_stats``."""
    if not len(values):
        return [None] * 6
    with np.errstate(all="ignore"):
        places = [(len(values) - 1) * float(p) for p in (lower, upper)]
        ends = [(int(np.floor(x)), int(np.ceil(x)), x - np.floor(x)) for x in places]
        ordered = np.partition(values, sorted({i for low, high, _ in ends for i in (low, high)}))
        low, high = (ordered[a] if ordered[a] == ordered[b] else ordered[a] * (1 - share) + ordered[b] * share for a, b, share in ends)
        mid, half = low / 2 + high / 2, high / 2 - low / 2
        place = np.zeros(len(values)) if half <= 0 else (np.minimum(np.maximum(values, low), high) - mid) / half
        mean = place.mean()
        return [float(x) for x in (low, high, mid, half, mean, np.sqrt(np.maximum(0.0, (place * place).mean() - mean * mean)))]
