"""Evidence ledgers: hashes, immutability, staging, calendars, overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import after_close_gate, gate_open
from tidemark.operators.checks import Checked
from tidemark.schema import MASTER_STATE, REQUIRED_EXCHANGES
from tidemark.sources.scratch import settled


def row_digest(columns: list[str]) -> Column:
    """sha256 of the row's text; columns are separated and NULL differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def content_hash(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-independent digest of each key's rows with their count.

    Row digests are summed in four 60-bit lanes, which combine map-side in any order, so a day
    of any size never has to be collected or sorted in one place; copies still count.
    """
    digest = df.withColumn("_h", row_digest(columns))
    lanes = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    summed = digest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(lane).alias(f"_l{i}") for i, lane in enumerate(lanes)]
    )
    text = F.concat_ws(":", F.col("row_count").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(4)])
    return summed.select(*keys, "row_count", F.sha2(text, 256).alias("content_hash"))


def metadata_agreement(candidates: DataFrame, master: DataFrame, keys: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """J10 + J12: candidates absent from the master or differing from it, one row per breach.  ``on`` are the
    columns that name a master row, the symbol by default."""
    checked = ["exchange", "board", "list_date", "is_st", "is_listed"]
    keys, on = keys or [], on or ["symbol"]
    side = master.select(*on, F.lit(True).alias("_known"), *[F.col(c).alias(f"_m_{c}") for c in checked])
    both = candidates.join(side, on, "left")
    breaches = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), F.lit("symbol_absent_from_master")),
        *[F.when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_m_{c}")), F.lit(f"{c}_disagrees")) for c in checked],
    ))
    return both.select(*keys, "symbol", F.explode(breaches).alias("rule"))


EVIDENCE = ["symbol", "name", "exchange", "board", "list_date", "is_st", "is_listed", "amount", "screen_source"]


def _staged(candidates: DataFrame, breaches: DataFrame, with_master: Callable[[DataFrame], DataFrame], expected: Column | None) -> Checked:
    """Manifest rows or refusals of days whose master (columns master_*) ``with_master`` joins."""
    shape = candidates.groupBy("evidence_date").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_distinct("screen_source").alias("_sources"), F.min("screen_source").alias("screen_source"),
        F.count_distinct("symbol").alias("_symbols"),
    )
    hashes = content_hash(candidates, ["evidence_date"], EVIDENCE).select("evidence_date", F.col("content_hash").alias("candidate_hash"))
    first = breaches.groupBy("evidence_date").agg(F.min("rule").alias("_breach"))
    rows = with_master(shape.join(hashes, "evidence_date").join(first, "evidence_date", "left"))
    mismatch = F.lit(False) if expected is None else ~F.col("master_observed_at").eqNullSafe(expected)
    reason = (
        F.when(F.col("master_observed_at").isNull(), "no_master_observed").when(F.col("_breach").isNotNull(), F.col("_breach"))
        .when(F.col("_symbols") < F.col("candidate_count"), "duplicate_symbols")
        .when(F.col("_sources") != 1, "not_one_screen_source").when(mismatch, "master_not_the_one_observed")
    )
    rows = rows.withColumn("_reason", reason)
    return Checked(
        rows.where(F.col("_reason").isNull()).select(
            "evidence_date", "master_observed_at", "master_state_hash", "master_rows", "candidate_hash", "candidate_count", "screen_source"
        ),
        rows.where(F.col("_reason").isNotNull()).select(
            F.col("_reason").alias("rule"), F.col("evidence_date").cast("string").alias("key"), F.col("candidate_count").alias("rows")
        ),
    )


def stage_evidence(
    candidates: DataFrame, master: DataFrame, expected_observed_at: Column | None = None
) -> Checked:
    """One manifest row per evidence_date, or the reasons it is refused.

    ``candidates`` carries evidence_date; ``master`` is the one snapshot that was observed.
    """
    observed = master.agg(F.max("observed_at").alias("master_observed_at"))
    state = content_hash(master.withColumn("_all", F.lit(1)), ["_all"], list(MASTER_STATE)).select(
        F.col("content_hash").alias("master_state_hash"), F.col("row_count").alias("master_rows")
    )
    breaches = metadata_agreement(candidates, master, ["evidence_date"])
    return _staged(candidates, breaches, lambda rows: rows.join(F.broadcast(observed)).join(F.broadcast(state), how="left"), expected_observed_at)


def master_states(history: DataFrame) -> DataFrame:
    """E4 over a master's history: (exchange, content_hash, row_count, valid_from, valid_to), a row per state of an
    exchange and the observations [from, to) it held.  Rows are hashed per snapshot before any is put in order."""
    hashed = content_hash(history, ["exchange", "observed_at"], list(MASTER_STATE))
    spans = state_intervals(hashed, "observed_at", "content_hash", ["exchange"])
    sizes = hashed.select("exchange", F.col("observed_at").alias("valid_from"), "row_count")
    return spans.join(sizes, ["exchange", "valid_from"]).select("exchange", "content_hash", "row_count", "valid_from", "valid_to")


def observed_masters(days: DataFrame, history: DataFrame) -> DataFrame:
    """(evidence_date, exchange, observed_at): the exchange's last snapshot on or before each day, in one ordered
    pass per exchange over its snapshots and the days; days before its first one have no row."""
    times = history.select("exchange", "observed_at").distinct()
    listed = history.agg(F.collect_set("exchange").alias("_exchanges"))  # the exchanges of a master: a few
    asks = days.select("evidence_date").distinct().join(F.broadcast(listed)).select("evidence_date", F.explode("_exchanges").alias("exchange"))
    marks = times.select("exchange", F.to_date("observed_at").alias("_t"), F.lit(0).alias("_ask"), "observed_at").unionByName(
        asks.select("exchange", F.col("evidence_date").alias("_t"), F.lit(1).alias("_ask"), F.lit(None).cast("timestamp").alias("observed_at")))
    w = Window.partitionBy("exchange").orderBy("_t", "_ask", "observed_at").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("observed_at", F.last("observed_at", ignorenulls=True).over(w))
    return seen.where("_ask = 1 AND observed_at IS NOT NULL").select(F.col("_t").alias("evidence_date"), "exchange", "observed_at")


def stage_evidence_days(candidates: DataFrame, history: DataFrame, expected: DataFrame | None = None) -> Checked:
    """E1 for many days: each evidence_date against the master that had been observed by then.

    ``history`` holds master snapshots; ``expected`` (evidence_date, master_observed_at) names the one a
    day's run used.  A day's master hash is that of its exchanges' states, so an unchanged exchange
    doesn't change with a new snapshot.  A candidate is looked up in its own exchange's snapshot, one of
    an unknown exchange in the day's newest.
    """
    chosen = observed_masters(candidates, history)
    hashed = content_hash(history, ["exchange", "observed_at"], list(MASTER_STATE))
    masters = chosen.join(hashed, ["exchange", "observed_at"]).groupBy("evidence_date").agg(
        F.max("observed_at").alias("master_observed_at"), F.sum("row_count").alias("master_rows"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "exchange", "content_hash"))), ","), 256).alias("master_state_hash"),
    )
    looked = candidates.join(chosen, ["evidence_date", "exchange"], "left").join(masters.select("evidence_date", "master_observed_at"), "evidence_date", "left")
    looked = looked.withColumn("observed_at", F.coalesce("observed_at", "master_observed_at")).drop("master_observed_at")
    breaches = metadata_agreement(looked, history, ["evidence_date"], ["symbol", "observed_at"])
    wanted = None if expected is None else F.col("_expected")

    def with_master(rows: DataFrame) -> DataFrame:
        rows = rows.join(masters, "evidence_date", "left")
        return rows if expected is None else rows.join(expected.select("evidence_date", F.col("master_observed_at").alias("_expected")), "evidence_date", "left")

    return _staged(candidates, breaches, with_master, wanted)


def append_plan(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str = "content_hash") -> DataFrame:
    """What an immutable append would do per key: insert, idempotent or conflict."""
    have = stored.select(*keys, F.col(hash_column).alias("_have"))
    return incoming.join(have, keys, "left").withColumn(
        "action", F.when(F.col("_have").isNull(), "insert").when(F.col("_have") == F.col(hash_column), "idempotent").otherwise("conflict"),
    ).drop("_have")


def gated_append_plan(stored: DataFrame, incoming: DataFrame, now: Column, keys: list[str] | None = None) -> DataFrame:
    """E3 behind F12: days outside the clock window are skipped before anything is compared."""
    keys = keys or ["evidence_date"]
    reason = after_close_gate(F.col(keys[0]), now)
    planned = append_plan(stored, incoming.withColumn("clock", reason), keys)
    return planned.withColumn("action", F.when(gate_open(F.col("clock")), F.col("action")).otherwise("skipped_market_clock"))


def state_intervals(days: DataFrame, day: str = "evidence_date", hash_column: str = "master_state_hash", keys: list[str] | None = None) -> DataFrame:
    """A state is stored when its hash changes; days become validity intervals [from, to) per key.

    What is put in order are the distinct days of a key, never the rows that they were told by.
    """
    keys = keys or []
    one = days.groupBy(*keys, day).agg(F.max(hash_column).alias(hash_column))
    w = Window.partitionBy(*keys).orderBy(day)
    changed = one.withColumn("_new", ~F.lag(hash_column).over(w).eqNullSafe(F.col(hash_column))).where("_new")
    return changed.select(*keys, hash_column, F.col(day).alias("valid_from"), F.lead(day).over(w).alias("valid_to"))


def new_states(stored_hashes: DataFrame, days: DataFrame, hash_column: str = "master_state_hash") -> DataFrame:
    """E4 append form: hashes that are not stored yet."""
    return days.select(hash_column).distinct().join(stored_hashes.select(hash_column), hash_column, "left_anti")


def compare_snapshots(
    stored: DataFrame, fresh: DataFrame, keys: list[str], numbers: list[str], others: list[str], *, rtol: float = 1e-12, atol: float = 1e-12
) -> DataFrame:
    """E5: rows that differ between two snapshots beyond the tolerance, with the reason."""
    payload = [*numbers, *others]
    left = stored.select(*keys, F.lit(True).alias("_in_a"), *[F.col(c).alias(f"_a_{c}") for c in payload])
    right = fresh.select(*keys, F.lit(True).alias("_in_b"), *[F.col(c).alias(f"_b_{c}") for c in payload])
    both = left.join(right, keys, "full_outer")

    def same_number(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))

    differs = F.array_compact(F.array(
        *[F.when(~same_number(c), F.lit(c)) for c in numbers],
        *[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in others],
    ))
    verdict = (
        F.when(F.col("_in_b").isNull(), "missing_in_new").when(F.col("_in_a").isNull(), "missing_in_stored")
        .when(F.size("_diff") > 0, F.concat(F.lit("differs:"), F.array_join("_diff", ",")))
    )
    return both.withColumn("_diff", differs).select(*keys, verdict.alias("verdict")).where(F.col("verdict").isNotNull())


FAN, DEPTH = 16, 2


def key_leaf(keys: list[str], fan: int = FAN, depth: int = DEPTH) -> Column:
    """The leaf of a row in a tree of ``fan`` ** ``depth`` key ranges: a part of the keys' hash space."""
    return F.pmod(F.xxhash64(*keys), F.lit(fan**depth)).cast("int")


def hash_tree(rows: DataFrame, keys: list[str], columns: list[str], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(level, node, row_count, content_hash): digests of a table's key ranges and of their unions up to level 0.

    Leaves come from one aggregate over the rows; each level above from ``fan`` times fewer rows below.
    Ranges without rows have no node.
    """
    level = content_hash(rows.withColumn("node", key_leaf(keys, fan, depth)), ["node"], [*keys, *columns])
    out = level.withColumn("level", F.lit(depth))
    for above in range(depth - 1, -1, -1):
        child = F.concat_ws("=", F.col("node").cast("string"), "content_hash")
        level = level.groupBy(F.floor(F.col("node") / fan).cast("int").alias("_up")).agg(
            F.sum("row_count").alias("row_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ","), 256).alias("content_hash")
        ).withColumnRenamed("_up", "node")
        out = out.unionByName(level.withColumn("level", F.lit(above)))
    return out.select("level", "node", "row_count", "content_hash")


def differing_leaves(a: DataFrame, b: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[int]:
    """Leaves whose rows are not the same in both trees, found from the root down: a level is read only below
    nodes that differ.  At most ``fan`` ** ``depth`` numbers."""
    open_nodes = [0]
    for level in range(depth + 1):
        at = [x.where((F.col("level") == level) & F.col("node").isin(open_nodes)).select("node", F.col("content_hash").alias(n)) for x, n in ((a, "_a"), (b, "_b"))]
        nodes = sorted(r["node"] for r in at[0].join(at[1], "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).collect())
        if level == depth or not nodes:
            return nodes
        open_nodes = [n * fan + k for n in nodes for k in range(fan)]
    return []


def compare_by_ranges(
    stored: DataFrame, fresh: DataFrame, keys: list[str], numbers: list[str], others: list[str], *, fan: int = FAN, depth: int = DEPTH, **tolerance
) -> DataFrame:
    """E5 for large snapshots that mostly agree: only rows of key ranges with different digests are joined.

    Equal digests mean equal rows; in the others ``compare_snapshots`` decides, tolerance included.  Each
    snapshot is read once for its tree, whose levels are then read one by one, and once for what differs.
    """
    trees = [settled(hash_tree(x, keys, [*numbers, *others], fan, depth)) for x in (stored, fresh)]
    leaves = differing_leaves(*trees, fan, depth)
    some = key_leaf(keys, fan, depth).isin(leaves) if leaves else F.lit(False)
    return compare_snapshots(stored.where(some), fresh.where(some), keys, numbers, others, **tolerance)


def archive_manifest(master: DataFrame, required=REQUIRED_EXCHANGES) -> DataFrame:
    """E6 + U7: one row per snapshot: size, exchanges, missing ones, hash."""
    digest = content_hash(master, ["observed_at"], list(MASTER_STATE))
    shape = master.groupBy("observed_at").agg(F.array_sort(F.collect_set("exchange")).alias("_seen"))
    need = F.array(*[F.lit(e) for e in sorted(required)])
    return digest.join(shape, "observed_at").select(
        "observed_at", "row_count", F.array_join("_seen", ",").alias("exchanges"),
        F.array_join(F.array_except(need, F.col("_seen")), ",").alias("missing_exchanges"), "content_hash",
    ).withColumn("complete", F.col("missing_exchanges") == "")


def evidence_calendar(evidence: DataFrame, calendar: DataFrame) -> DataFrame:
    """J15 + U4: one audit row: every trading day inside the evidence span has evidence, no other day has.

    Both sides are distinct dates (calendar-sized) before they meet.
    """
    have = evidence.select("evidence_date").distinct().select(F.col("evidence_date").alias("day"), F.lit(True).alias("_have"))
    span = have.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    due = calendar.select(F.col("trade_date").alias("day")).distinct().join(F.broadcast(span)).where(
        (F.col("day") >= F.col("_first")) & (F.col("day") <= F.col("_last"))
    ).select("day", F.lit(True).alias("_due"))
    both = have.join(due, "day", "full_outer")
    listing = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("day").cast("string")))), ",")
    missing, extra = F.col("_have").isNull(), F.col("_due").isNull()
    return both.agg(
        F.count("_have").alias("available_dates"), F.count("_due").alias("expected_trading_dates"),
        F.min(F.when(F.col("_have"), F.col("day"))).alias("first_evidence_date"), F.max(F.when(F.col("_have"), F.col("day"))).alias("last_evidence_date"),
        F.count_if(missing).alias("missing_count"), F.count_if(extra).alias("extra_count"),
        listing(missing).alias("missing_dates"), listing(extra).alias("extra_nontrading_dates"),
    ).withColumn(
        "status",
        F.when(F.col("available_dates") == 0, "no_evidence").when(F.col("extra_count") > 0, "invalid_nontrading_evidence")
        .when(F.col("missing_count") > 0, "gap").otherwise("complete"),
    )


def walk_forward_status(
    audit: DataFrame, candidates: DataFrame, bars: DataFrame, days: DataFrame, *, block_days: int = 20
) -> DataFrame:
    """P14 (+ U6, J10): one status row: no_evidence / evidence_gap / collecting / history_gap / complete."""
    union = candidates.select("symbol").distinct()
    gap = union.join(bars.select("symbol").distinct(), "symbol", "left_anti").agg(F.count(F.lit(1)).alias("missing_history_symbols"))
    names = union.agg(F.count(F.lit(1)).alias("candidate_union_count"))
    degraded = days.agg(F.array_join(F.array_sort(F.collect_set(
        F.when(F.col("degraded_mode"), F.col("evidence_date").cast("string")))), ",").alias("degraded_evidence_dates"))
    need = block_days + 1
    return audit.select("status", "available_dates").join(F.broadcast(gap)).join(F.broadcast(names)).join(F.broadcast(degraded)).select(
        F.when(F.col("status") == "no_evidence", "no_evidence").when(F.col("status") != "complete", "evidence_gap")
        .when(F.col("available_dates") < need, "collecting").when(F.col("missing_history_symbols") > 0, "history_gap")
        .otherwise("complete").alias("status"),
        F.col("available_dates").alias("evidence_dates"), F.greatest(F.lit(0), F.lit(need) - F.col("available_dates")).alias("remaining_dates"),
        "candidate_union_count", "missing_history_symbols", "degraded_evidence_dates",
    )


def guarded_override(table: DataFrame, corrections: DataFrame, key: str = "symbol", column: str = "delist_date") -> Checked:
    """Apply reviewed corrections (key, expected, new, published) only where the stored value is the expected one.

    The original value stays in ``original_<column>``; a correction that does not fit exactly one
    row, or whose dates are out of order, is a violation and changes nothing.
    """
    fix = corrections.select(key, F.col("expected").alias("_old"), F.col("new").alias("_new"), F.col("published").alias("_pub"), F.lit(True).alias("_fix"))
    # Copies are counted on the corrected keys only; they combine map-side.
    copies = table.join(fix.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    joined = table.join(fix.join(copies, key, "left"), key, "left")
    stale = ~F.col(column).eqNullSafe(F.col("_old"))
    order = ~F.coalesce((F.col("list_date") < F.col("_new")) & (F.col("_pub") <= F.col("_new")), F.lit(False))
    reason = F.when(F.col("_copies") > 1, "key_not_unique").when(stale, "stored_value_not_expected").when(order, "evidence_out_of_order")
    apply = F.coalesce(F.col("_fix") & reason.isNull(), F.lit(False))
    clean = joined.select(
        *[F.when(apply, F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns],
        F.when(apply, F.col(column)).alias(f"original_{column}"), apply.alias("corrected"),
    )
    bad = joined.where(F.col("_fix") & reason.isNotNull()).groupBy(reason.alias("rule"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    absent = fix.join(table.select(key).distinct(), key, "left_anti").select(
        F.lit("no_such_row").alias("rule"), F.col(key).alias("key"), F.lit(0).cast("long").alias("rows")
    )
    return Checked(clean, bad.unionByName(absent))


def ledger_day(candidates: DataFrame, days: DataFrame, evidence_date: str, columns: list[str]) -> Checked:
    """IO17: exactly one day's candidates, only if their hash equals the manifest's."""
    day = F.lit(evidence_date).cast("date")
    rows = candidates.where(F.col("evidence_date") == day)
    now = content_hash(rows, ["evidence_date"], columns)
    verified = days.where(F.col("evidence_date") == day).join(now, "evidence_date", "left").withColumn(
        "_ok", F.col("candidate_hash").eqNullSafe(F.col("content_hash"))
    )
    bad = verified.where(~F.col("_ok")).select(
        F.lit("candidate_hash_mismatch").alias("rule"), F.col("evidence_date").cast("string").alias("key"), F.coalesce("row_count", F.lit(0)).alias("rows")
    )
    return Checked(rows.join(verified.where("_ok").select("evidence_date"), "evidence_date", "left_semi"), bad)


def ledger_master_as_of(states: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """IO18: the master state of the last ledger day at or before the cutoff."""
    last = days.where(F.col("evidence_date") <= F.lit(as_of).cast("date")).agg(
        F.max_by("master_state_hash", "evidence_date").alias("master_state_hash")
    )
    return states.join(F.broadcast(last), "master_state_hash")
