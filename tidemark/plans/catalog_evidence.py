"""Queries over evidence ledgers, archives, reconstruction and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators import evidence as E
from tidemark.operators import normalize as N
from tidemark.operators import reconstruct as K
from tidemark.plans.catalog_market import GATES
from tidemark.plans.oracle_views import V1, scored, with_views
from tidemark.plans.registry import query, r, rounded
from tidemark.sources import views as V
from tidemark.sources.scratch import settled

LIMIT, FLOOR = 3, 100000.0


# --- hashes and immutable days ----------------------------------------------------------------


def _digest(cols: list[str]) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in cols) + "))"


def _content_hash(source: str, key: str, cols: list[str]) -> str:
    lanes = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    return f"SELECT {key}, count(*) AS row_count, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {lanes})) AS content_hash FROM (SELECT *, {_digest(cols)} AS h FROM {source}) GROUP BY {key}"


@query("content_hash", with_views(["states_daily"], _content_hash("states_daily", "trade_date", ["symbol", "is_st", "trade_status"])))
def _(spark, sf):
    return E.content_hash(V.states_daily(spark, sf), ["trade_date"], ["symbol", "is_st", "trade_status"])


def state_days(spark, sf):
    return E.content_hash(V.states_daily(spark, sf), ["trade_date"], ["symbol", "is_st", "trade_status"]).withColumnRenamed("trade_date", "evidence_date")


_DAYS = {"hashed": _content_hash("states_daily", "trade_date", ["symbol", "is_st", "trade_status"])}


@query("append_immutable", with_views(["states_daily"], "SELECT trade_date AS evidence_date, CASE WHEN day(trade_date) % 3 = 0 THEN 'conflict' WHEN day(trade_date) % 2 = 0 THEN 'idempotent' ELSE 'insert' END AS action FROM hashed", _DAYS))
def _(spark, sf):
    days = state_days(spark, sf)
    d = F.day("evidence_date")
    stored = days.where((d % 2 == 0) | (d % 3 == 0)).withColumn("content_hash", F.when(d % 3 == 0, F.lit("x")).otherwise(F.col("content_hash")))
    return E.append_plan(stored, days, ["evidence_date"]).select("evidence_date", "action")


@query("append_immutable_gated", with_views(["states_daily"], """SELECT trade_date AS evidence_date, CASE WHEN isodow(trade_date) > 5 THEN 'skipped_market_clock' WHEN day(trade_date) % 2 = 0 THEN 'idempotent' ELSE 'insert' END AS action FROM hashed
    WHERE day(trade_date) % 5 <> 0 UNION ALL SELECT trade_date, 'skipped_market_clock' FROM hashed WHERE day(trade_date) % 5 = 0""", _DAYS))
def _(spark, sf):
    days = state_days(spark, sf)
    stored = days.where(F.day("evidence_date") % 2 == 0)
    at = F.col("evidence_date").cast("timestamp") + F.when(F.day("evidence_date") % 5 == 0, F.expr("INTERVAL '30' HOUR")).otherwise(F.expr("INTERVAL '10' HOUR"))
    return E.gated_append_plan(stored, days, at).select("evidence_date", "action")


@query("dedup_states", with_views(["states_daily"], """SELECT state, valid_from, lead(valid_from) OVER (ORDER BY valid_from) AS valid_to FROM (SELECT state, trade_date AS valid_from, lag(state) OVER (ORDER BY trade_date) AS before
    FROM (SELECT trade_date, CAST(row_count % 2 AS VARCHAR) AS state FROM hashed)) WHERE before IS NULL OR before <> state""", _DAYS))
def _(spark, sf):
    days = state_days(spark, sf).withColumn("state", (F.col("row_count") % 2).cast("string"))
    return E.state_intervals(days, hash_column="state")


@query("new_states", with_views(["states_daily"], "SELECT DISTINCT content_hash FROM hashed WHERE day(trade_date) % 2 = 1", _DAYS))
def _(spark, sf):
    days = state_days(spark, sf)
    return E.new_states(days.where(F.day("evidence_date") % 2 == 0), days, "content_hash")


_COMPARED = with_views(["spot"], """SELECT symbol, CASE WHEN k % 7 = 0 THEN 'missing_in_new' WHEN k % 7 = 1 THEN 'missing_in_stored' WHEN k % 7 = 2 THEN 'differs:amount' WHEN k % 7 = 3 THEN 'differs:name' END AS verdict
    FROM (SELECT symbol, CAST(symbol AS BIGINT) AS k FROM spot) WHERE k % 7 < 4""")


def _two_snapshots(s):
    k = F.col("symbol").cast("long") % 7
    stored = s.where(k != 1)
    fresh = s.where(k != 0).withColumns({
        "amount": F.when(k == 2, F.col("amount") * 1.0001).when(k == 4, F.col("amount") * (1 + 1e-14)).otherwise(F.col("amount")),
        "name": F.when(k == 3, F.lit("other")).otherwise(F.col("name")),
    })
    return stored, fresh, ["symbol"], ["last", "amount", "float_market_cap"], ["name"]


@query("compare_snapshots", _COMPARED)
def _(spark, sf):
    return E.compare_snapshots(*_two_snapshots(V.spot(spark, sf)))


@query("compare_snapshots_by_ranges", _COMPARED)
def _(spark, sf):
    return E.compare_by_ranges(*_two_snapshots(settled(V.spot(spark, sf))))


@query("archive_manifest", with_views(["master_history"], """SELECT CAST(observed_at AS DATE) AS observed_day, row_count, exchanges, array_to_string(list_sort(list_filter(['BSE', 'SSE', 'SZSE'], lambda e: NOT contains(exchanges, e))), ',') AS missing_exchanges, content_hash, n = 3 AS complete
    FROM hashed JOIN (SELECT observed_at, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges, count(DISTINCT exchange) AS n FROM master_history GROUP BY 1) USING (observed_at)""",
    {"hashed": _content_hash("master_history", "observed_at", ["symbol", "name", "exchange", "board", "list_date", "industry", "is_st", "is_listed"])}))
def _(spark, sf):
    m = E.archive_manifest(V.master_history(spark, sf))
    return m.withColumn("observed_day", F.to_date("observed_at")).drop("observed_at")


@query("archive_manifest_hash", with_views(["master_history"], "SELECT CAST(observed_at AS DATE) AS observed_day, content_hash FROM (" + _content_hash("master_history", "observed_at", ["symbol", "name", "exchange", "board", "list_date", "industry", "is_st", "is_listed"]) + ")"))
def _(spark, sf):
    m = E.archive_manifest(V.master_history(spark, sf))
    return m.select(F.to_date("observed_at").alias("observed_day"), "content_hash")


@query("master_counts", with_views(["master"], "SELECT exchange, count(*) AS rows, count(*) FILTER (WHERE is_st) AS st_count, count(*) FILTER (WHERE is_listed) AS listed_count FROM master GROUP BY 1"))
def _(spark, sf):
    return A.master_counts(V.master(spark, sf))


@query("project_master_state", with_views(["master"], "SELECT symbol, name, exchange, board, list_date, coalesce(industry, '') AS industry, is_st, is_listed FROM master"))
def _(spark, sf):
    return N.project_master_state(V.master(spark, sf))


# --- candidates against the master ------------------------------------------------------------


def evidence_candidates(spark, sf):
    """Quarter archive rows as observed candidates; a few disagree with the master."""
    m = V.master(spark, sf).select("symbol", "name", "exchange", "board", "list_date", "is_st", "is_listed")
    k, d = F.col("symbol").cast("long"), F.quarter("trade_date")
    rows = V.archive_amounts(spark, sf).where(F.col("amount") >= FLOOR).join(m, "symbol")
    return rows.select(
        F.col("trade_date").alias("evidence_date"), "symbol", "name", "exchange", F.when((k % 50 == 3) & (d == 2), "x").otherwise(F.col("board")).alias("board"), "list_date",
        F.when((k % 10 == 4) & (d == 3), ~F.col("is_st")).otherwise(F.col("is_st")).alias("is_st"), "is_listed", "amount",
        F.when((k % 10 == 5) & (F.year("trade_date") == 2022), "other").otherwise("spot").alias("screen_source"),
    )


_CAND = """SELECT trade_date AS evidence_date, a.symbol, m.name, m.exchange, CASE WHEN CAST(a.symbol AS BIGINT) % 50 = 3 AND quarter(trade_date) = 2 THEN 'x' ELSE m.board END AS board, m.list_date,
    CASE WHEN CAST(a.symbol AS BIGINT) % 10 = 4 AND quarter(trade_date) = 3 THEN NOT m.is_st ELSE m.is_st END AS is_st, m.is_listed, amount, CASE WHEN CAST(a.symbol AS BIGINT) % 10 = 5 AND year(trade_date) = 2022 THEN 'other' ELSE 'spot' END AS screen_source,
    m.board AS mboard, m.is_st AS mst FROM archive_amounts a JOIN master m USING (symbol) WHERE amount >= 100000"""
_C = {"cand": _CAND}


@query("validate_candidates", with_views(["archive_amounts", "master"], f"SELECT evidence_date, symbol, is_st, is_listed, {r('amount', 2)} AS amount FROM cand", _C))
def _(spark, sf):
    raw = evidence_candidates(spark, sf).withColumns({"is_st": F.upper(F.col("is_st").cast("string")), "is_listed": F.col("is_listed").cast("int").cast("string")})
    return rounded(N.validate_candidates(raw).clean.select("evidence_date", "symbol", "is_st", "is_listed", "amount"), 2)


@query("metadata_agreement", with_views(["archive_amounts", "master"], "SELECT evidence_date, symbol, 'board_disagrees' AS rule FROM cand WHERE board <> mboard UNION ALL SELECT evidence_date, symbol, 'is_st_disagrees' FROM cand WHERE is_st <> mst", _C))
def _(spark, sf):
    return E.metadata_agreement(evidence_candidates(spark, sf), V.master(spark, sf), ["evidence_date"])


_BAD_DAY = "count(*) FILTER (WHERE board <> mboard OR is_st <> mst) > 0 OR count(DISTINCT screen_source) <> 1"


_STATE = ["symbol", "name", "exchange", "board", "list_date", "industry", "is_st", "is_listed"]
_DEC = {"cent": "SELECT * REPLACE (CAST(amount AS DECIMAL(18,2)) AS amount) FROM cand"}
_MANIFEST = "evidence_date, CAST(master_observed_at AS DATE) AS master_observed_at, master_state_hash, master_rows, candidate_hash, candidate_count, screen_source"


def _in_cents(candidates):
    return candidates.withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@query("stage_evidence", with_views(["archive_amounts", "master"], f"""SELECT evidence_date, DATE '2027-01-01' AS master_observed_at, (SELECT content_hash FROM whole) AS master_state_hash, (SELECT row_count FROM whole) AS master_rows,
    content_hash AS candidate_hash, count(*) AS candidate_count, min(screen_source) AS screen_source FROM cent JOIN days USING (evidence_date) GROUP BY ALL HAVING NOT ({_BAD_DAY})""",
    {**_C, **_DEC, "days": _content_hash("cent", "evidence_date", E.EVIDENCE), "whole": _content_hash("(SELECT *, 1 AS k FROM master)", "k", _STATE)}))
def _(spark, sf):
    staged = E.stage_evidence(_in_cents(evidence_candidates(spark, sf)), V.master(spark, sf), F.lit("2027-01-01 08:00:00").cast("timestamp"))
    return staged.clean.withColumn("master_observed_at", F.to_date("master_observed_at"))


@query("stage_evidence_refused", with_views(["archive_amounts", "master"], """SELECT CASE WHEN count(*) FILTER (WHERE board <> mboard) > 0 THEN 'board_disagrees' WHEN count(*) FILTER (WHERE is_st <> mst) > 0 THEN 'is_st_disagrees' ELSE 'not_one_screen_source' END AS rule,
    CAST(evidence_date AS VARCHAR) AS key, count(*) AS rows FROM cand GROUP BY evidence_date HAVING """ + _BAD_DAY, _C))
def _(spark, sf):
    return E.stage_evidence(evidence_candidates(spark, sf), V.master(spark, sf)).violations


# Three master snapshots, moved back into the span of the archive; candidates come from the one of their day, with faults.
_BACK = 1500
_OLD = {
    "hist": f"SELECT * REPLACE (observed_at - INTERVAL {_BACK} DAY AS observed_at) FROM master_history",
    "due": f"SELECT DISTINCT trade_date AS evidence_date FROM archive_amounts WHERE amount >= {FLOOR}",
    "chosen": "SELECT evidence_date, exchange, max(observed_at) AS observed_at FROM due JOIN (SELECT DISTINCT exchange, observed_at FROM hist) ON CAST(observed_at AS DATE) <= evidence_date GROUP BY 1, 2",
    "cand": f"""SELECT a.trade_date AS evidence_date, h.symbol, h.name, h.exchange, h.board, h.list_date, CASE WHEN CAST(a.symbol AS BIGINT) % 10 = 4 AND quarter(trade_date) = 3 THEN NOT h.is_st ELSE h.is_st END AS is_st, h.is_listed,
        CAST(amount AS DECIMAL(18,2)) AS amount, CASE WHEN CAST(a.symbol AS BIGINT) % 10 = 5 AND year(trade_date) = 2022 THEN 'other' ELSE 'spot' END AS screen_source, h.is_st AS mst, h.board AS mboard
        FROM archive_amounts a JOIN hist h USING (symbol) JOIN chosen c ON c.evidence_date = trade_date AND c.exchange = h.exchange AND c.observed_at = h.observed_at WHERE amount >= {FLOOR}""",
    "states": _content_hash("hist", "exchange, observed_at", _STATE),
    "masters": """SELECT evidence_date, max(observed_at) AS master_observed_at, CAST(sum(row_count) AS BIGINT) AS master_rows, sha256(string_agg(exchange || '=' || content_hash, ',' ORDER BY exchange)) AS master_state_hash
        FROM chosen JOIN states USING (exchange, observed_at) GROUP BY 1""",
    "days": _content_hash("cand", "evidence_date", E.EVIDENCE),
}


def _old_masters(spark, sf):
    return V.master_history(spark, sf).withColumn("observed_at", F.col("observed_at") - F.expr(f"INTERVAL '{_BACK}' DAY"))


def _old_candidates(spark, sf):
    hist = _old_masters(spark, sf)
    rows = V.archive_amounts(spark, sf).where(F.col("amount") >= FLOOR).withColumnRenamed("trade_date", "evidence_date")
    chosen = E.observed_masters(rows, hist)
    k, d = F.col("symbol").cast("long"), F.quarter("evidence_date")
    return rows.join(hist, "symbol").join(chosen, ["evidence_date", "exchange", "observed_at"]).select(
        "evidence_date", "symbol", "name", "exchange", "board", "list_date", F.when((k % 10 == 4) & (d == 3), ~F.col("is_st")).otherwise(F.col("is_st")).alias("is_st"), "is_listed",
        F.col("amount").cast("decimal(18,2)").alias("amount"), F.when((k % 10 == 5) & (F.year("evidence_date") == 2022), "other").otherwise("spot").alias("screen_source"))


@query("stage_evidence_days", with_views(["archive_amounts", "master_history"], f"""SELECT {_MANIFEST} FROM (SELECT evidence_date, content_hash AS candidate_hash, count(*) AS candidate_count, min(screen_source) AS screen_source FROM cand JOIN days USING (evidence_date)
    GROUP BY ALL HAVING NOT ({_BAD_DAY})) JOIN masters USING (evidence_date)""", _OLD))
def _(spark, sf):
    return E.stage_evidence_days(_old_candidates(spark, sf), _old_masters(spark, sf)).clean.withColumn("master_observed_at", F.to_date("master_observed_at"))


@query("stage_evidence_days_refused", with_views(["archive_amounts", "master_history"], f"""SELECT CASE WHEN count(*) FILTER (WHERE is_st <> mst) > 0 THEN 'is_st_disagrees' WHEN count(DISTINCT screen_source) <> 1 THEN 'not_one_screen_source' ELSE 'master_not_the_one_observed' END AS rule,
    CAST(evidence_date AS VARCHAR) AS key, count(*) AS rows FROM cand JOIN masters USING (evidence_date) GROUP BY evidence_date, master_observed_at HAVING {_BAD_DAY} OR year(evidence_date) = 2023""", _OLD))
def _(spark, sf):
    hist, cands = _old_masters(spark, sf), _old_candidates(spark, sf)
    used = E.observed_masters(cands, hist).groupBy("evidence_date").agg(F.max("observed_at").alias("master_observed_at"))
    late = F.when(F.year("evidence_date") == 2023, F.col("master_observed_at") - F.expr("INTERVAL '1' DAY")).otherwise(F.col("master_observed_at"))
    return E.stage_evidence_days(cands, hist, used.withColumn("master_observed_at", late)).violations


@query("master_states", with_views(["master_history"], """SELECT exchange, content_hash, row_count, CAST(observed_at AS DATE) AS valid_from, CAST(lead(observed_at) OVER (PARTITION BY exchange ORDER BY observed_at) AS DATE) AS valid_to
    FROM (SELECT *, lag(content_hash) OVER (PARTITION BY exchange ORDER BY observed_at) AS before FROM states) WHERE before IS DISTINCT FROM content_hash""", _OLD))
def _(spark, sf):
    return E.master_states(_old_masters(spark, sf)).withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})


_LEDGER_COLS = ["symbol", "board", "amount"]


@query("ledger_day", with_views(["archive_amounts", "master"], f"SELECT symbol, board, {r('amount', 2)} AS amount FROM cand WHERE evidence_date = DATE '2023-04-01'", _C))
def _(spark, sf):
    cands = evidence_candidates(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    days = E.content_hash(cands, ["evidence_date"], _LEDGER_COLS).select("evidence_date", F.col("content_hash").alias("candidate_hash"))
    return E.ledger_day(cands, days, "2023-04-01", _LEDGER_COLS).clean.select("symbol", "board", (F.round(F.col("amount").cast("double"), 2) + 0.0).alias("amount"))


@query("ledger_master_as_of", with_views(["master_history"], "SELECT symbol, is_st FROM master_history WHERE observed_at = TIMESTAMP '2025-06-30 08:00:00'"))
def _(spark, sf):
    states = V.master_history(spark, sf).withColumn("master_state_hash", F.sha2(F.col("observed_at").cast("string"), 256))
    days = states.select(F.to_date("observed_at").alias("evidence_date"), "master_state_hash").distinct()
    return E.ledger_master_as_of(states, days, "2026-01-15").select("symbol", "is_st")


# --- calendars --------------------------------------------------------------------------------


def _evidence_days(spark, sf):
    return V.states_daily(spark, sf).where(F.day("trade_date") % 7 != 3).select(F.col("trade_date").alias("evidence_date"))


def _trading_days(spark, sf):
    return V.states_daily(spark, sf).where(F.day("trade_date") % 11 != 5).select("trade_date")


_CAL = {"ev": "SELECT DISTINCT trade_date AS d FROM states_daily WHERE day(trade_date) % 7 <> 3",
        "due": "SELECT DISTINCT trade_date AS d FROM states_daily WHERE day(trade_date) % 11 <> 5 AND trade_date BETWEEN (SELECT min(d) FROM ev) AND (SELECT max(d) FROM ev)",
        "miss": "SELECT d FROM due EXCEPT SELECT d FROM ev", "more": "SELECT d FROM ev EXCEPT SELECT d FROM due"}


@query("calendar_audit", with_views(["states_daily"], """SELECT (SELECT count(*) FROM ev) AS available_dates, (SELECT count(*) FROM due) AS expected_trading_dates, (SELECT min(d) FROM ev) AS first_evidence_date, (SELECT max(d) FROM ev) AS last_evidence_date,
    (SELECT count(*) FROM miss) AS missing_count, (SELECT count(*) FROM more) AS extra_count, (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM miss) AS missing_dates,
    (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM more) AS extra_nontrading_dates, CASE WHEN (SELECT count(*) FROM more) > 0 THEN 'invalid_nontrading_evidence' WHEN (SELECT count(*) FROM miss) > 0 THEN 'gap' ELSE 'complete' END AS status""", _CAL))
def _(spark, sf):
    return E.evidence_calendar(_evidence_days(spark, sf), _trading_days(spark, sf))


@query("date_set_diff", with_views(["states_daily"], "SELECT d AS day, 'missing' AS side FROM miss UNION ALL SELECT d, 'extra' FROM more", _CAL))
def _(spark, sf):
    ev = _evidence_days(spark, sf).select(F.col("evidence_date").alias("day"))
    span = ev.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    due = _trading_days(spark, sf).select(F.col("trade_date").alias("day")).join(F.broadcast(span)).where(F.col("day").between(F.col("a"), F.col("b"))).select("day")
    return due.subtract(ev).withColumn("side", F.lit("missing")).unionByName(ev.subtract(due).withColumn("side", F.lit("extra")))


@query("walk_forward_status", with_views(["states_daily", "bars"], """SELECT CASE WHEN (SELECT count(*) FROM ev) < 21 THEN 'collecting' WHEN (SELECT count(*) FROM gone) > 0 THEN 'history_gap' ELSE 'complete' END AS status, (SELECT count(*) FROM ev) AS evidence_dates,
    greatest(0, 21 - (SELECT count(*) FROM ev)) AS remaining_dates, (SELECT count(DISTINCT symbol) FROM states_daily) AS candidate_union_count, (SELECT count(*) FROM gone) AS missing_history_symbols""",
    {"ev": "SELECT DISTINCT trade_date FROM states_daily", "gone": "SELECT DISTINCT symbol FROM states_daily WHERE symbol NOT IN (SELECT symbol FROM bars)"}))
def _(spark, sf):
    s = V.states_daily(spark, sf)
    days = s.select(F.col("trade_date").alias("evidence_date")).distinct().withColumn("degraded_mode", F.day("evidence_date") % 10 == 0)
    audit = E.evidence_calendar(days, s.select("trade_date"))
    return E.walk_forward_status(audit, s, V.bars(spark, sf), days).drop("degraded_evidence_dates")


@query("archive_calendar", with_views(["gap_amounts", "gap_states", "order_calendar"], """SELECT coalesce(a.d, s.d, c.d) AS trade_date, a.d IS NOT NULL AS in_amounts, s.d IS NOT NULL AS in_states, CASE WHEN c.d IS NULL THEN 'not_in_calendar' WHEN a.d IS NULL AND s.d IS NULL THEN 'missing_amount_and_state'
    WHEN a.d IS NULL THEN 'missing_amount' WHEN s.d IS NULL THEN 'missing_state' ELSE 'present' END AS status FROM (SELECT DISTINCT trade_date AS d FROM gap_amounts) a FULL JOIN (SELECT DISTINCT trade_date AS d FROM gap_states) s ON a.d = s.d
    FULL JOIN (SELECT DISTINCT trade_date AS d FROM order_calendar) c ON c.d = coalesce(a.d, s.d)"""))
def _(spark, sf):
    cal = V.order_calendar(spark, sf)
    return K.archive_calendar(V.gap_amounts(spark, sf), V.gap_states(spark, sf), cal)


# --- reconstruction ---------------------------------------------------------------------------

_REC = {
    "life": "SELECT * FROM lifecycle WHERE exchange IN ('SSE','SZSE')",
    "dates": "SELECT DISTINCT trade_date FROM (SELECT trade_date FROM gap_amounts UNION ALL SELECT trade_date FROM gap_states)",
    "members": "SELECT d.trade_date, l.* FROM dates d JOIN life l ON l.list_date <= d.trade_date - 120 AND (l.delist_date IS NULL OR l.delist_date > d.trade_date)",
    "full_rows": """SELECT m.trade_date, m.symbol, m.name, m.board, a.amount, a.symbol IS NOT NULL AS has_a, s.symbol IS NOT NULL AS has_s, coalesce(NOT s.is_st AND s.trade_status AND s.close > 0, false) AS can_rank
        FROM members m LEFT JOIN gap_amounts a USING (trade_date, symbol) LEFT JOIN gap_states s USING (trade_date, symbol)""",
    "judged": f"""SELECT d.trade_date, count(f.symbol) AS members, count(*) FILTER (WHERE f.symbol IS NOT NULL AND NOT has_a) AS missing_amount, count(*) FILTER (WHERE f.symbol IS NOT NULL AND NOT has_s) AS missing_state, count(*) FILTER (WHERE can_rank AND NOT has_a) AS missing_rankable_amount,
        count(*) FILTER (WHERE can_rank AND has_a AND amount >= {FLOOR}) AS liquid_count FROM dates d LEFT JOIN full_rows f USING (trade_date) GROUP BY 1""",
    "reasons": f"""SELECT *, CASE WHEN members = 0 THEN 'no_listed_members' WHEN missing_state > 0 THEN 'state_archive_incomplete' WHEN missing_rankable_amount > 0 THEN 'amount_archive_incomplete' WHEN liquid_count < {LIMIT} THEN 'too_few_liquid_members' END AS reason FROM judged""",
    "ok_rows": f"SELECT f.*, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS rn FROM full_rows f JOIN (SELECT trade_date FROM reasons WHERE reason IS NULL) USING (trade_date) WHERE can_rank AND has_a AND amount >= {FLOOR}",
}
_RV = ["lifecycle", "gap_amounts", "gap_states"]


def reconstruction(spark, sf):
    return K.reconstruct_candidates(V.lifecycle(spark, sf), V.gap_amounts(spark, sf), V.gap_states(spark, sf), limit=LIMIT, min_amount=FLOOR)


@query("reconstruct_candidates", with_views(_RV, f"SELECT trade_date, symbol, name, board, {r('amount', 2)} AS amount, CAST(rn AS INTEGER) AS rank_by_amount FROM ok_rows WHERE rn <= {LIMIT}", _REC))
def _(spark, sf):
    return rounded(reconstruction(spark, sf).candidates.select("trade_date", "symbol", "name", "board", "amount", "rank_by_amount"), 2)


@query("day_audit", with_views(_RV, f"""SELECT j.trade_date, members, {r('1 - missing_amount / members')} AS amount_coverage, {r('1 - missing_state / members')} AS state_coverage, missing_amount, liquid_count, {r('c.amount', 2)} AS cutoff_amount,
    (SELECT count(*) FROM ok_rows o WHERE o.trade_date = j.trade_date AND o.amount = c.amount) AS cutoff_tie_count FROM reasons j JOIN ok_rows c ON c.trade_date = j.trade_date AND c.rn = {LIMIT} WHERE reason IS NULL""", _REC))
def _(spark, sf):
    a = reconstruction(spark, sf).audit.select("trade_date", "members", "amount_coverage", "state_coverage", "missing_amount", "liquid_count", F.round("cutoff_amount", 2).alias("cutoff_amount"), "cutoff_tie_count")
    return rounded(a)


@query("reconstruction_failures", with_views(_RV, "SELECT trade_date, reason, members, missing_state, missing_rankable_amount, liquid_count FROM reasons WHERE reason IS NOT NULL", _REC))
def _(spark, sf):
    return reconstruction(spark, sf).failures


@query("calendar_summary", with_views(_RV, f"""SELECT count(*) FILTER (WHERE reason IS NULL) AS successful_dates, count(*) FILTER (WHERE reason IS NOT NULL) AS failed_dates, {r('count(*) FILTER (WHERE reason IS NULL) / count(*)')} AS success_rate, min(trade_date) AS first_date, max(trade_date) AS last_date,
    CASE WHEN count(reason) = 0 THEN 'complete' ELSE 'incomplete' END AS status, false AS candidate_calendar_complete FROM reasons""", _REC))
def _(spark, sf):
    return rounded(K.calendar_summary(reconstruction(spark, sf), external_calendar=False))


@query("missing_rankable_examples", with_views(_RV, """SELECT trade_date, string_agg(symbol, ',' ORDER BY symbol) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY symbol) AS n FROM full_rows WHERE can_rank AND NOT has_a) WHERE n <= 10 GROUP BY 1""", _REC))
def _(spark, sf):
    return K.missing_rankable_examples(V.lifecycle(spark, sf), V.gap_amounts(spark, sf), V.gap_states(spark, sf))


@query("rank_by_amount", with_views(["archive_amounts"], f"SELECT trade_date, symbol, {r('amount', 2)} AS amount, CAST(rn AS INTEGER) AS rank_by_amount FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS rn FROM archive_amounts) WHERE rn <= 7"))
def _(spark, sf):
    return rounded(K.rank_by_amount(V.archive_amounts(spark, sf), 7).select("trade_date", "symbol", "amount", "rank_by_amount"), 2)


@query("missing_symbols", with_views(["gap_amounts", "gap_states"], "SELECT trade_date, symbol FROM gap_states s WHERE NOT EXISTS (SELECT 1 FROM gap_amounts a WHERE a.symbol = s.symbol AND a.trade_date = s.trade_date)"))
def _(spark, sf):
    return V.gap_states(spark, sf).join(V.gap_amounts(spark, sf), ["trade_date", "symbol"], "left_anti").select("trade_date", "symbol")


@query("restrict_symbols", with_views(["archive_states", "archive_amounts"], "SELECT symbol, count(*) AS states FROM archive_states WHERE symbol IN (SELECT symbol FROM archive_amounts WHERE amount >= 1500000) GROUP BY 1"))
def _(spark, sf):
    big = V.archive_amounts(spark, sf).where(F.col("amount") >= 1500000).select("symbol").distinct()
    return V.archive_states(spark, sf).join(big, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("states"))


# --- recovery ---------------------------------------------------------------------------------


def raw_recovery(spark, sf):
    """Quarter states with gaps sent back by a provider as text, with faults that depend on the symbol."""
    return _sent(V.gap_states(spark, sf), V.gap_amounts(spark, sf))


def _sent(states, amounts):
    k = F.col("symbol").cast("long") % 10
    base = states.join(amounts, ["symbol", "trade_date"], "left")
    st = F.when((k == 3) & (F.quarter("trade_date") == 2), ~F.col("is_st")).otherwise(F.col("is_st"))
    rows = base.select(
        "symbol", F.col("trade_date").cast("string").alias("date"), F.concat(F.lit("sh."), F.when(k == 4, "999999").otherwise(F.col("symbol"))).alias("code"),
        F.when(k == 5, F.lit("-1")).otherwise(F.col("amount").cast("string")).alias("amount"), F.col("trade_status").cast("int").cast("string").alias("tradestatus"),
        F.when(k == 6, "?").otherwise(st.cast("int").cast("string")).alias("isST"),
    )
    return rows.unionByName(rows.where(F.col("symbol").cast("long") % 10 == 7))


_RECOV = {
    "faults": """SELECT symbol, CASE WHEN k = 7 THEN 'invalid_or_duplicate_dates' WHEN k = 4 THEN 'symbol_mismatch' WHEN k = 6 THEN 'invalid_flags' WHEN k = 5 THEN 'negative_amount' WHEN k = 3 THEN 'status_mismatch' END AS rule, n
        FROM (SELECT symbol, CAST(symbol AS BIGINT) % 10 AS k, count(*) AS n FROM gap_states GROUP BY 1)""",
    "sa": "SELECT s.*, a.amount, NOT s.is_st AND s.trade_status AND s.close > 0 AS can_rank FROM gap_states s LEFT JOIN gap_amounts a USING (symbol, trade_date)",
    "det": """SELECT f.symbol, f.rule, CASE WHEN f.rule IS NOT NULL THEN 'error' WHEN count(*) FILTER (WHERE can_rank AND amount IS NULL) = 0 THEN 'complete' ELSE 'incomplete' END AS status,
        CASE WHEN f.rule IS NULL THEN count(amount) ELSE 0 END AS recovered_rows, count(*) AS state_dates, count(*) FILTER (WHERE can_rank) AS rankable_dates,
        CASE WHEN f.rule IS NULL THEN count(*) FILTER (WHERE can_rank AND amount IS NULL) ELSE count(*) FILTER (WHERE can_rank) END AS unresolved_dates FROM faults f JOIN sa USING (symbol) GROUP BY 1, 2""",
}
_RSV = ["gap_states", "gap_amounts"]


@query("recover_amounts", with_views(_RSV, f"SELECT symbol, trade_date, {r('amount', 2)} AS amount FROM sa JOIN faults USING (symbol) WHERE rule IS NULL AND amount IS NOT NULL", _RECOV))
def _(spark, sf):
    return rounded(K.recover_amounts(raw_recovery(spark, sf), V.gap_states(spark, sf)).amounts, 2)


_OPEN = "SELECT symbol, string_agg(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) AS unresolved_examples FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn FROM sa WHERE can_rank AND amount IS NULL) WHERE rn <= 10 GROUP BY 1"


@query("recovery_detail", with_views(_RSV, """SELECT symbol, status, CASE WHEN rule IS NULL THEN state_dates END AS returned_dates, recovered_rows, state_dates, rankable_dates, unresolved_dates, CASE WHEN rule IS NULL THEN coalesce(unresolved_examples, '') ELSE '' END AS unresolved_examples
    FROM det LEFT JOIN opened USING (symbol)""", {**_RECOV, "opened": _OPEN}))
def _(spark, sf):
    return K.recover_amounts(raw_recovery(spark, sf), V.gap_states(spark, sf)).detail


@query("recovery_violations", with_views(_RSV, "SELECT rule, symbol AS key FROM faults WHERE rule IS NOT NULL", _RECOV))
def _(spark, sf):
    return K.recover_amounts(raw_recovery(spark, sf), V.gap_states(spark, sf)).violations.select("rule", "key")


@query("recovery_summary", with_views(_RSV, """SELECT count(*) AS target_symbols, count(*) FILTER (WHERE rule IS NULL) AS recovered_symbols, CAST(sum(recovered_rows) AS BIGINT) AS recovered_rows, CAST(sum(unresolved_dates) AS BIGINT) AS unresolved_symbol_days, count(rule) AS error_symbols,
    CASE WHEN sum(unresolved_dates) = 0 AND count(rule) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM det""", _RECOV))
def _(spark, sf):
    return K.recovery_summary(K.recover_amounts(raw_recovery(spark, sf), V.gap_states(spark, sf)).detail)


@query("status_overlap_check", with_views(["archive_states"], "SELECT symbol, count(*) AS mismatches FROM archive_states WHERE CAST(symbol AS BIGINT) % 10 = 3 AND quarter(trade_date) = 2 GROUP BY 1"))
def _(spark, sf):
    return K.status_overlap(_sent(V.archive_states(spark, sf), V.archive_amounts(spark, sf)), V.archive_states(spark, sf))


# --- archives and shards ----------------------------------------------------------------------

PERIOD = ("2021-01-01", "2024-06-30")
_MEMB = f"""SELECT *, CAST(CAST('0x' || substr(sha256(symbol), 1, 16) AS HUGEINT) % 8 AS INTEGER) AS shard FROM lifecycle WHERE list_date <= DATE '{PERIOD[1]}' AND (delist_date IS NULL OR delist_date >= DATE '{PERIOD[0]}')"""
_GAPPY = "SELECT symbol, trade_date, CASE WHEN CAST(symbol AS BIGINT) % 6 = 1 AND quarter(trade_date) = 1 THEN NULL ELSE amount END AS amount FROM gap_amounts WHERE CAST(symbol AS BIGINT) % 13 <> 2"
_COV = {"memb": _MEMB, "gappy": _GAPPY, "cov": """SELECT m.symbol, m.shard, count(g.symbol) AS row_count, coalesce(count(g.amount) / nullif(count(g.symbol), 0), 0) AS amount_coverage, min(g.trade_date) AS first_bar, max(g.trade_date) AS last_bar,
    count(g.symbol) > 0 AND count(g.amount) = count(g.symbol) AS success FROM memb m LEFT JOIN gappy g USING (symbol) GROUP BY 1, 2"""}


def gappy_amounts(spark, sf):
    k = F.col("symbol").cast("long")
    return _blanked(V.gap_amounts(spark, sf).where(k % 13 != 2))


def _blanked(amounts):
    """Amounts that some symbols never report for a first quarter."""
    return amounts.withColumn("amount", F.when(~((F.col("symbol").cast("long") % 6 == 1) & (F.quarter("trade_date") == 1)), F.col("amount")))


def _coverage(spark, sf):
    return A.amount_coverage(A.shard_lifecycle(V.lifecycle(spark, sf), 8, *PERIOD), gappy_amounts(spark, sf))


@query("shard_lifecycle", with_views(["lifecycle"], "SELECT symbol, shard FROM memb", {"memb": _MEMB}))
def _(spark, sf):
    return A.shard_lifecycle(V.lifecycle(spark, sf), 8, *PERIOD).select("symbol", "shard")


@query("amount_coverage", with_views(["lifecycle", "gap_amounts"], f"SELECT symbol, shard, row_count, {r('amount_coverage')} AS amount_coverage, first_bar, last_bar, success FROM cov", _COV))
def _(spark, sf):
    return rounded(_coverage(spark, sf).drop("exchange"))


@query("archive_summary", with_views(["lifecycle", "gap_amounts"], f"""SELECT shard, count(*) AS symbol_count, count(*) FILTER (WHERE success) AS success_count, CAST(sum(row_count) AS BIGINT) AS amount_row_count, count(*) FILTER (WHERE NOT success) AS failed_count,
    {r('count(*) FILTER (WHERE success) / count(*)')} AS success_rate, count(*) FILTER (WHERE success) / count(*) >= 0.95 AS passed FROM cov GROUP BY 1""", _COV))
def _(spark, sf):
    return rounded(A.archive_summary(_coverage(spark, sf)))


@query("failed_symbols", with_views(["lifecycle", "gap_amounts"], "SELECT symbol FROM cov WHERE NOT success", _COV))
def _(spark, sf):
    return A.failed_symbols(_coverage(spark, sf))


@query("state_coverage", with_views(["lifecycle", "gap_states"], """SELECT l.symbol, count(s.symbol) AS row_count, min(s.trade_date) AS first_state_date, max(s.trade_date) AS last_state_date, count(*) FILTER (WHERE s.is_st) AS st_day_count,
    count(*) FILTER (WHERE NOT s.trade_status) AS suspended_day_count, count(s.symbol) > 0 AS success FROM lifecycle l LEFT JOIN gap_states s USING (symbol) GROUP BY 1"""))
def _(spark, sf):
    return A.state_coverage(V.lifecycle(spark, sf), V.gap_states(spark, sf))


@query("state_transitions", with_views(["states_daily"], "SELECT symbol, count(*) FILTER (WHERE before IS NOT NULL AND before <> is_st) AS st_transition_count FROM (SELECT *, lag(is_st) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM states_daily) GROUP BY 1"))
def _(spark, sf):
    return A.state_transitions(V.states_daily(spark, sf))


_COHORT = f"""SELECT *, lower(exchange) || CASE WHEN currently_listed AND list_date <= DATE '{PERIOD[1]}' THEN '_current' WHEN NOT currently_listed AND delist_date >= DATE '{PERIOD[0]}' AND list_date <= DATE '{PERIOD[1]}' THEN '_delisted_in_period' END AS cohort FROM lifecycle"""
_SAMPLE = {"coh": _COHORT, "sample": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sha256(symbol)) AS rn FROM coh WHERE cohort IS NOT NULL) WHERE rn <= 12"}


def _sample(spark, sf):
    return A.stable_sample(A.lifecycle_cohorts(V.lifecycle(spark, sf), *PERIOD), 12, F.col("symbol"))


@query("stable_sample", with_views(["lifecycle"], "SELECT cohort, symbol FROM sample", _SAMPLE))
def _(spark, sf):
    return _sample(spark, sf).select("cohort", "symbol")


_PROBE = {**_SAMPLE, "gappy": _GAPPY, "pc": "SELECT s.cohort, s.symbol, count(g.symbol) > 0 AND count(g.amount) = count(g.symbol) AS success, coalesce(count(g.amount) / nullif(count(g.symbol), 0), 0) AS coverage FROM sample s LEFT JOIN gappy g USING (symbol) GROUP BY 1, 2"}


@query("cohort_rates", with_views(["lifecycle", "gap_amounts"], f"SELECT cohort, count(*) AS sample_count, count(*) FILTER (WHERE success) AS success_count, {r('avg(CAST(success AS INTEGER))')} AS success_rate, {r('coalesce(avg(coverage) FILTER (WHERE success), 0)')} AS mean_amount_coverage FROM pc GROUP BY 1", _PROBE))
def _(spark, sf):
    return rounded(A.cohort_rates(A.amount_coverage(_sample(spark, sf), gappy_amounts(spark, sf))))


@query("scale_recommendation", with_views(["lifecycle", "gap_amounts"], f"""SELECT {r('c')} AS current_success_rate, {r('d')} AS delisted_success_rate, CASE WHEN d >= 0.80 AND c >= 0.90 THEN 'proceed_to_sharded_archive' ELSE 'do_not_scale_yet' END AS recommendation
    FROM (SELECT coalesce(avg(CAST(success AS INTEGER)) FILTER (WHERE contains(cohort, 'current')), 0) AS c, coalesce(avg(CAST(success AS INTEGER)) FILTER (WHERE contains(cohort, 'delisted')), 0) AS d FROM pc)""", _PROBE))
def _(spark, sf):
    return rounded(A.scale_recommendation(A.amount_coverage(_sample(spark, sf), gappy_amounts(spark, sf))))


_PROBED = {**_PROBE,
    "probed": """SELECT s.symbol, count(t.symbol) AS n, coalesce(count(g.amount) / nullif(count(t.symbol), 0), 0) AS a, coalesce(count(t.is_st) / nullif(count(t.symbol), 0), 0) AS st, coalesce(count(t.trade_status) / nullif(count(t.symbol), 0), 0) AS ts
        FROM sample s LEFT JOIN gap_states t USING (symbol) LEFT JOIN gappy g ON g.symbol = t.symbol AND g.trade_date = t.trade_date GROUP BY 1""",
    "seen": "SELECT trade_date, count(DISTINCT symbol) AS o FROM gap_states GROUP BY 1",
    "due": """SELECT c.trade_date, count(l.symbol) AS m FROM seen c LEFT JOIN (SELECT * FROM lifecycle WHERE exchange IN ('SSE','SZSE')) l ON l.list_date <= c.trade_date AND (l.delist_date IS NULL OR l.delist_date > c.trade_date) GROUP BY 1""",
    "told": """SELECT count(*) AS sample_count, count(*) FILTER (WHERE n > 0) AS success_count, avg(CAST(n > 0 AS INTEGER)) AS success_rate, coalesce(avg(st) FILTER (WHERE n > 0), 0) AS mean_is_st_coverage, coalesce(avg(a) FILTER (WHERE n > 0), 0) AS mean_amount_coverage,
        coalesce(avg(ts) FILTER (WHERE n > 0), 0) AS mean_trade_status_coverage, (SELECT max(abs((o - m) / nullif(m, 0))) FROM seen JOIN due USING (trade_date)) AS max_membership_gap, (SELECT count(*) FROM seen) AS membership_dates FROM probed""",
}


@query("state_probe_summary", with_views(["lifecycle", "gap_amounts", "gap_states"], f"""SELECT sample_count, success_count, {", ".join(f"{r(c)} AS {c}" for c in ("success_rate", "mean_is_st_coverage", "mean_amount_coverage", "mean_trade_status_coverage", "max_membership_gap"))}, membership_dates,
    CASE WHEN success_rate >= 0.95 AND mean_is_st_coverage >= 0.99 AND max_membership_gap <= 0.05 THEN 'promising_independent_state_source' ELSE 'needs_more_validation' END AS recommendation FROM told""", _PROBED))
def _(spark, sf):
    from tidemark.operators.universe import membership_calendar, membership_crosscheck

    history = V.gap_states(spark, sf).join(gappy_amounts(spark, sf), ["symbol", "trade_date"], "left")
    counts = V.gap_states(spark, sf).groupBy("trade_date").agg(F.count_distinct("symbol").alias("observed_count"))
    gap = membership_crosscheck(counts, membership_calendar(V.lifecycle(spark, sf), counts))
    return rounded(A.state_probe_summary(A.probe_detail(_sample(spark, sf), history), gap))


@query("provider_counts", with_views(["lifecycle", "archive_amounts"], """SELECT shard, CASE WHEN k < 5 THEN 'p' || CAST(k AS VARCHAR) ELSE 'unknown' END AS provider, count(*) AS symbols FROM (SELECT symbol, shard, CAST(symbol AS BIGINT) % 6 AS k FROM memb
    WHERE symbol IN (SELECT symbol FROM archive_amounts WHERE amount IS NOT NULL)) GROUP BY 1, 2""", {"memb": _MEMB}))
def _(spark, sf):
    k = F.col("symbol").cast("long") % 6
    sent = V.archive_amounts(spark, sf).withColumn("provider", F.when(k < 5, F.concat(F.lit("p"), k.cast("string"))))
    return A.provider_counts(A.amount_coverage(A.shard_lifecycle(V.lifecycle(spark, sf), 8, *PERIOD), sent))


@query("transition_counts", with_views(["name_changes"], "SELECT source, count(*) AS name_change_rows, count(*) FILTER (WHERE st_transition) AS st_transition_rows, count(DISTINCT symbol) FILTER (WHERE st_transition) AS st_transition_symbols FROM name_changes GROUP BY 1"))
def _(spark, sf):
    return A.transition_counts(V.name_changes(spark, sf))


@query("lifecycle_inventory", with_views(["lifecycle"], f"""SELECT exchange, count(*) AS symbol_count, count(*) FILTER (WHERE currently_listed) AS current_count, count(*) FILTER (WHERE NOT currently_listed) AS delisted_count, {r('avg(CAST(list_date IS NOT NULL AS INTEGER))')} AS list_date_coverage,
    {r('coalesce(avg(CAST(delist_date IS NOT NULL AS INTEGER)) FILTER (WHERE NOT currently_listed), 1)')} AS delist_date_coverage FROM lifecycle GROUP BY 1"""))
def _(spark, sf):
    return rounded(A.lifecycle_inventory(V.lifecycle(spark, sf)))


@query("selection_summary", with_views(["panel", "bars"], """SELECT (SELECT count(*) FROM scored) AS ranked_count, least((SELECT count(*) FROM scored), 10) AS selected_count, (SELECT count(DISTINCT symbol) FROM bars) - (SELECT count(*) FROM scored) AS excluded_count,
    (SELECT count(*) FROM (SELECT symbol FROM bars GROUP BY symbol HAVING max(trade_date) < (SELECT max(trade_date) FROM bars))) AS fetch_failure_count""",
    {"latest": "SELECT *, 1 AS run FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM panel) WHERE rn = 1 AND bar_no >= 61 AND average_amount_20 >= 35000", **scored("latest", "run", V1)}))
def _(spark, sf):
    from tidemark.operators.factors import factor_engine
    from tidemark.operators.universe import drop_stale

    b = V.bars(spark, sf)
    ranking, exclusions = factor_engine(b, **GATES)
    return A.selection_summary(ranking, exclusions, drop_stale(b)[1], 10)


def sharded_rows(spark, sf):
    """Quarter amounts split over 8 shards; a few symbols sit in two shards."""
    return _sharded(_blanked(V.archive_amounts(spark, sf)))


def _sharded(rows):
    from tidemark.functions.symbols import hash_shard

    a = rows.withColumn("shard_index", hash_shard(F.col("symbol"), 8))
    twice = a.where(F.col("symbol").cast("long") % 29 == 5).withColumn("shard_index", (F.col("shard_index") + 1) % 8)
    return a.unionByName(twice)


def shard_summaries(spark, sf):
    s = A.archive_summary(_coverage(spark, sf))
    end = F.when(F.col("shard") == 3, "2024-06-29").otherwise(PERIOD[1])
    return s.select(F.col("shard").alias("shard_index"), F.lit(8).alias("shard_count"), "symbol_count", "success_count", "success_rate", F.lit(PERIOD[0]).alias("period_start"), end.alias("period_end"))


_BLANK = "SELECT symbol, trade_date, CASE WHEN NOT (CAST(symbol AS BIGINT) % 6 = 1 AND quarter(trade_date) = 1) THEN amount END AS amount FROM archive_amounts"
_SHARD = {**_COV, "blank": _BLANK, "rows_": "SELECT *, CAST(CAST('0x' || substr(sha256(symbol), 1, 16) AS HUGEINT) % 8 AS INTEGER) AS sh FROM blank",
          "summ": "SELECT shard, count(*) AS n, count(*) FILTER (WHERE success) AS ok FROM cov GROUP BY 1"}


@query("merge_shards_violations", with_views(["lifecycle", "archive_amounts", "gap_amounts"], """SELECT 'symbol_in_two_shards' AS rule, count(DISTINCT symbol) AS keys FROM rows_ WHERE CAST(symbol AS BIGINT) % 29 = 5 HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_symbol_date', count(*) FROM rows_ WHERE CAST(symbol AS BIGINT) % 29 = 5 HAVING count(*) > 0
    UNION ALL SELECT 'null_amount', count(*) FROM (SELECT DISTINCT sh FROM (SELECT sh FROM rows_ WHERE amount IS NULL UNION ALL SELECT (sh + 1) % 8 FROM rows_ WHERE amount IS NULL AND CAST(symbol AS BIGINT) % 29 = 5)) HAVING count(*) > 0
    UNION ALL SELECT 'shard_below_success_rate', count(*) FROM summ WHERE ok / n < 0.95 HAVING count(*) > 0 UNION ALL SELECT 'shard_set_incomplete', 1 FROM summ HAVING count(*) <> 8
    UNION ALL SELECT 'periods_inconsistent', 1 FROM summ HAVING count(*) FILTER (WHERE shard = 3) > 0 AND count(*) FILTER (WHERE shard <> 3) > 0 UNION ALL SELECT 'total_below_success_rate', 1 FROM summ HAVING sum(ok) / sum(n) < 0.95""", _SHARD))
def _(spark, sf):
    bad = A.merge_shards(sharded_rows(spark, sf), shard_summaries(spark, sf), 8).violations
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


@query("merge_shards", with_views(["archive_amounts"], "SELECT symbol, count(*) * CASE WHEN CAST(symbol AS BIGINT) % 29 = 5 THEN 2 ELSE 1 END AS rows FROM archive_amounts GROUP BY 1"))
def _(spark, sf):
    merged = A.merge_shards(sharded_rows(spark, sf), shard_summaries(spark, sf), 8).clean
    return merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("shard_overlap", with_views(["archive_amounts"], "SELECT DISTINCT symbol, CAST(2 AS BIGINT) AS shards FROM archive_amounts WHERE CAST(symbol AS BIGINT) % 29 = 5"))
def _(spark, sf):
    return A.shard_overlap(sharded_rows(spark, sf))


def _state_shards(spark, sf):
    """State rows over 8 shards (IO15); some closes are missing."""
    states = V.archive_states(spark, sf).withColumn("close", F.when(F.col("symbol").cast("long") % 17 != 6, F.col("close")))
    return A.merge_shards(_sharded(states), shard_summaries(spark, sf), 8, value="close")


@query("merge_state_shards", with_views(["archive_states"], """SELECT symbol, m * count(*) AS rows, m * count(*) FILTER (WHERE is_st) AS st_rows, m * count(*) FILTER (WHERE NOT trade_status) AS suspended_rows, m * count(close) AS closes
    FROM (SELECT symbol, is_st, trade_status, CASE WHEN CAST(symbol AS BIGINT) % 17 <> 6 THEN close END AS close, CASE WHEN CAST(symbol AS BIGINT) % 29 = 5 THEN 2 ELSE 1 END AS m FROM archive_states) GROUP BY symbol, m"""))
def _(spark, sf):
    return _state_shards(spark, sf).clean.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_st").alias("st_rows"), F.count_if(~F.col("trade_status")).alias("suspended_rows"), F.count("close").alias("closes"))


@query("merge_state_shards_violations", with_views(["archive_states"], """SELECT 'null_close' AS rule, CAST(sh AS VARCHAR) AS key, count(*) AS rows FROM (SELECT unnest(CASE WHEN CAST(symbol AS BIGINT) % 29 = 5 THEN [sh, (sh + 1) % 8] ELSE [sh] END) AS sh
        FROM (SELECT symbol, CAST(CAST('0x' || substr(sha256(symbol), 1, 16) AS HUGEINT) % 8 AS INTEGER) AS sh FROM archive_states WHERE CAST(symbol AS BIGINT) % 17 = 6)) GROUP BY 1, 2
    UNION ALL SELECT 'symbol_in_two_shards', symbol, 2 FROM archive_states WHERE CAST(symbol AS BIGINT) % 29 = 5 GROUP BY symbol
    UNION ALL SELECT 'duplicate_symbol_date', symbol || '|' || CAST(trade_date AS VARCHAR), 2 FROM archive_states WHERE CAST(symbol AS BIGINT) % 29 = 5"""))
def _(spark, sf):
    return _state_shards(spark, sf).violations.where(F.col("rule").isin("null_close", "symbol_in_two_shards", "duplicate_symbol_date"))


def _lists(spark, sf):
    life, k = V.lifecycle(spark, sf), F.col("symbol").cast("long")
    current = life.where(F.col("currently_listed") | (k % 27 == 4)).select("symbol", "name", "exchange", "board", "list_date", F.lit(True).alias("currently_listed"))
    return current, life.where(~F.col("currently_listed"))


@query("build_lifecycle", with_views(["lifecycle"], "SELECT symbol, list_date, delist_date, currently_listed FROM lifecycle UNION ALL SELECT symbol, list_date, NULL, true FROM lifecycle WHERE NOT currently_listed AND CAST(symbol AS BIGINT) % 27 = 4"))
def _(spark, sf):
    return A.build_lifecycle(*_lists(spark, sf)).clean.select("symbol", "list_date", "delist_date", "currently_listed")


@query("build_lifecycle_violations", with_views(["lifecycle"], "SELECT 'current_and_delisted' AS rule, symbol AS key, CAST(2 AS BIGINT) AS rows FROM lifecycle WHERE NOT currently_listed AND CAST(symbol AS BIGINT) % 27 = 4"))
def _(spark, sf):
    return A.build_lifecycle(*_lists(spark, sf)).violations


def _corrections(spark, sf):
    """Every delisted name gets a correction five days earlier; some expect a wrong old value."""
    life, k = V.lifecycle(spark, sf), F.col("symbol").cast("long")
    return life.where(~F.col("currently_listed")).select(
        "symbol", F.when(k % 4 == 0, F.date_add("delist_date", 1)).otherwise(F.col("delist_date")).alias("expected"), F.date_sub("delist_date", 3).alias("new"), F.date_sub("delist_date", 10).alias("published"))


@query("guarded_override", with_views(["lifecycle"], "SELECT symbol, CASE WHEN fits THEN delist_date - 3 ELSE delist_date END AS delist_date, CASE WHEN fits THEN delist_date END AS original_delist_date, fits AS corrected FROM (SELECT *, NOT currently_listed AND CAST(symbol AS BIGINT) % 4 <> 0 AS fits FROM lifecycle)"))
def _(spark, sf):
    return E.guarded_override(V.lifecycle(spark, sf), _corrections(spark, sf)).clean.select("symbol", "delist_date", "original_delist_date", "corrected")


@query("guarded_override_violations", with_views(["lifecycle"], "SELECT 'stored_value_not_expected' AS rule, symbol AS key, CAST(1 AS BIGINT) AS rows FROM lifecycle WHERE NOT currently_listed AND CAST(symbol AS BIGINT) % 4 = 0"))
def _(spark, sf):
    return E.guarded_override(V.lifecycle(spark, sf), _corrections(spark, sf)).violations


# --- listing normalisers ----------------------------------------------------------------------


@query("validate_lifecycle", with_views(["lifecycle"], "SELECT symbol, list_date, delist_date FROM lifecycle WHERE CAST(symbol AS BIGINT) % 8 <> 3"))
def _(spark, sf):
    raw = V.lifecycle(spark, sf).withColumn("list_date", F.when(F.col("symbol").cast("long") % 8 == 3, "soon").otherwise(F.col("list_date").cast("string")))
    return N.validate_lifecycle(raw).clean.select("symbol", "list_date", "delist_date")


@query("validate_amounts", with_views(["archive_amounts"], f"SELECT symbol, trade_date, {r('amount', 2)} AS amount FROM archive_amounts WHERE amount IS NOT NULL AND NOT (CAST(symbol AS BIGINT) % 6 = 1 AND quarter(trade_date) = 1)"))
def _(spark, sf):
    return rounded(N.validate_amounts(_blanked(V.archive_amounts(spark, sf))).clean, 2)


@query("normalize_listings", """SELECT lpad(CAST(c_custkey % 1000 + 600000 AS VARCHAR), 6, '0') AS symbol, arg_min(c_mktsegment, c_custkey) AS name, 'SSE' AS exchange, DATE '2020-01-01' + CAST(any_value(c_custkey % 1000) AS INTEGER) AS list_date, '上证主板' AS board, true AS currently_listed FROM customer GROUP BY 1""")
def _(spark, sf):
    k = F.col("c_custkey") % 1000
    raw = V.table(spark, sf, "customer").select(
        F.concat(F.lit("code "), (k + 600000).cast("string")).alias("A股代码"), F.col("c_mktsegment").alias("证券简称"), F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).cast("string").alias(" 上市日期 "), "c_custkey")
    return N.normalize_listings(raw, "SSE", "c_custkey").select("symbol", "name", "exchange", "list_date", "board", "currently_listed")


@query("normalize_delisted", """SELECT symbol, DATE '2020-01-01' AS list_date, max(d) AS delist_date FROM (SELECT lpad(CAST((c_custkey % 5) * 100000 + c_custkey % 300 AS VARCHAR), 6, '0') AS symbol, DATE '2021-01-01' + CAST(c_custkey AS INTEGER) AS d FROM customer)
    WHERE left(symbol, 1) IN ('0','3') GROUP BY 1""")
def _(spark, sf):
    k = F.col("c_custkey")
    raw = V.table(spark, sf, "customer").select(
        F.lpad(((k % 5) * 100000 + k % 300).cast("string"), 6, "0").alias("证券代码"), F.col("c_name").alias("证券简称"), F.lit("2020-01-01").alias("上市日期"),
        F.date_add(F.lit("2021-01-01").cast("date"), k.cast("int")).cast("string").alias("终止上市日期"))
    return N.normalize_delisted(raw, "SZSE").select("symbol", "list_date", "delist_date")
