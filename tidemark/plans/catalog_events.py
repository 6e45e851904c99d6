"""Queries over announcements, extracted events and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators import events as X
from tidemark.operators import normalize as N
from tidemark.operators.asof import state_around
from tidemark.plans.oracle_views import with_views
from tidemark.plans.registry import query, r, rounded
from tidemark.sources import views as V

_ANN = """ann AS (SELECT *, CASE n_chars % 6 WHEN 0 THEN 'risk_warning_remove_candidate' WHEN 1 THEN 'risk_warning_apply_candidate' WHEN 2 THEN 'delisting_related' WHEN 3 THEN 'risk_warning_remove_candidate' WHEN 4 THEN 'risk_warning_apply_candidate' ELSE 'other_risk_disclosure' END AS event_candidate
    FROM (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '900' END || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS symbol, CASE n_chars % 6 WHEN 0 THEN '关于撤销退市风险警示的公告' WHEN 1 THEN '关于股票交易被实施其他风险警示的公告'
        WHEN 2 THEN '终止上市提示' WHEN 3 THEN '撤销公司股票*ST标识' WHEN 4 THEN '实施风险警示' ELSE '' END || text AS title, TIMESTAMP '2024-01-01 08:00:00' + INTERVAL 1 HOUR * doc_id AS local_time,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id, lang AS org, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'http://files/finalpage/' || CAST(doc_id AS VARCHAR) || '.PDF' END AS pdf_url FROM documents) WHERE doc_id % 41 <> 0 AND left(symbol, 1) IN ('0','3','6'))"""


def announcements(spark, sf):
    return N.normalize_announcements(V.raw_announcements(spark, sf), "risk", file_base="http://files/", detail_base="http://detail")


@query("normalize_announcements", f"""WITH {_ANN} SELECT symbol, title AS announcement_title, CAST(local_time AS VARCHAR) AS announcement_time, id AS announcement_id, pdf_url,
    'http://detail?stockCode=' || symbol || '&announcementId=' || id || '&orgId=' || org || '&announcementTime=' || CAST(local_time AS VARCHAR) AS announcement_link, event_candidate FROM ann""")
def _(spark, sf):
    a = announcements(spark, sf).withColumn("announcement_time", F.col("announcement_time").cast("string"))
    return a.select("symbol", "announcement_title", "announcement_time", "announcement_id", "pdf_url", "announcement_link", "event_candidate")


@query("dedup_announcements", f"WITH {_ANN} SELECT symbol, count(*) AS rows FROM (SELECT DISTINCT symbol, title, local_time, id, org FROM ann) GROUP BY 1")
def _(spark, sf):
    a = announcements(spark, sf)
    again = a.withColumn("category", F.lit("other"))
    return N.dedup_announcements(a.unionByName(again)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("event_counts", f"WITH {_ANN} SELECT event_candidate, count(*) AS announcements, count(*) FILTER (WHERE left(symbol, 1) = '6') AS sse_guess, count(*) FILTER (WHERE left(symbol, 1) IN ('0','3')) AS szse_guess FROM ann GROUP BY 1")
def _(spark, sf):
    return A.event_counts(announcements(spark, sf))


@query("classify_title", f"WITH {_ANN} SELECT announcement_id, event_candidate FROM (SELECT id AS announcement_id, event_candidate FROM ann)")
def _(spark, sf):
    return announcements(spark, sf).select("announcement_id", "event_candidate")


@query("cohort_sample", f"""WITH {_ANN} SELECT cohort, symbol, announcement_id FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sha256(k)) AS rn FROM (
    SELECT CASE WHEN left(symbol, 1) = '6' THEN 'SSE' ELSE 'SZSE' END || CASE event_candidate WHEN 'risk_warning_apply_candidate' THEN '_apply' WHEN 'risk_warning_remove_candidate' THEN '_remove' END AS cohort, symbol, id AS announcement_id,
    CASE WHEN id <> '' THEN id ELSE symbol || '|' || CAST(local_time AS VARCHAR) || '|' || title END AS k FROM ann WHERE pdf_url LIKE 'http%') WHERE cohort IS NOT NULL) WHERE rn <= 10""")
def _(spark, sf):
    sample = A.stable_sample(A.announcement_cohorts(announcements(spark, sf)), 10, A.announcement_key())
    return sample.select("cohort", "symbol", "announcement_id")


@query("month_windows", """SELECT symbol, greatest(s, m) AS window_start, least(e, CAST(m + INTERVAL 1 MONTH AS DATE) - 1) AS window_end FROM (SELECT symbol, s, e, CAST(unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS DATE) AS m FROM (
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(min(l_shipdate) AS DATE) + 9131 AS s, CAST(max(l_shipdate) AS DATE) + 9131 AS e FROM lineitem GROUP BY 1))""")
def _(spark, sf):
    spans = V.table(spark, sf, "lineitem").groupBy(V.code("l_suppkey").alias("symbol")).agg(F.min(V.shifted("l_shipdate")).alias("start"), F.max(V.shifted("l_shipdate")).alias("end"))
    return X.month_windows(spans).select("symbol", "window_start", "window_end")


# The notice behind each document has a known form, so the expected verdict follows from the form
# and the calendar; the extraction itself reads the whole text and knows nothing of the form.
_TXT = """docs AS (SELECT doc_id, n_chars % 8 AS form, '甲' || CAST(n_chars % 7 AS VARCHAR) AS a, 'ST乙' || CAST(n_chars % 5 AS VARCHAR) AS b, DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER) AS ann,
    CAST(doc_id % 12 + 1 AS INTEGER) AS mo, CAST(doc_id % 28 + 1 AS INTEGER) AS da, length(regexp_replace(text, '\\s', '', 'g')) AS size FROM documents),
    dated AS (SELECT *, CASE WHEN make_date(2024, mo, da) - ann BETWEEN -60 AND 30 THEN make_date(2024, mo, da) END AS stated,
        (SELECT arg_min(make_date(y, mo, da), abs(make_date(y, mo, da) - ann) * 10 + (y - 2023)) FROM (VALUES (2023), (2024), (2025)) v(y) WHERE make_date(y, mo, da) - ann BETWEEN -730 AND 30) AS nearest FROM docs)"""


@query("extract_status_events", f"""WITH {_TXT} SELECT doc_id, CASE form WHEN 0 THEN CASE WHEN stated IS NULL THEN 'no_explicit_effective_date' ELSE 'verified' END WHEN 1 THEN CASE WHEN nearest IS NULL THEN 'no_explicit_effective_date' ELSE 'verified' END
    WHEN 2 THEN CASE WHEN nearest IS NULL THEN 'no_explicit_effective_date' ELSE 'no_consistent_action_date_pair' END WHEN 4 THEN 'no_explicit_effective_date'
    WHEN 5 THEN CASE WHEN stated IS NULL THEN 'no_explicit_effective_date' ELSE 'ambiguous_multiple_verified_events' END WHEN 6 THEN CASE WHEN nearest IS NULL THEN 'no_explicit_effective_date' ELSE 'verified' END ELSE 'no_boolean_name_transition' END AS parse_status,
    CASE form WHEN 0 THEN stated WHEN 1 THEN nearest WHEN 6 THEN nearest END AS effective_date, CASE WHEN (form = 0 AND stated IS NOT NULL) OR (form = 6 AND nearest IS NOT NULL) THEN a WHEN form = 1 AND nearest IS NOT NULL THEN b END AS before_name, CASE WHEN (form = 0 AND stated IS NOT NULL) OR (form = 6 AND nearest IS NOT NULL) THEN b WHEN form = 1 AND nearest IS NOT NULL THEN a END AS after_name,
    CASE WHEN (form = 0 AND stated IS NOT NULL) OR (form = 6 AND nearest IS NOT NULL) THEN 'apply_st' WHEN form = 1 AND nearest IS NOT NULL THEN 'remove_st' END AS action FROM dated""")
def _(spark, sf):
    texts = V.announcement_texts(spark, sf).repartition(spark.sparkContext.defaultParallelism)  # one small file is one task
    return X.extract_status_events(texts).select("doc_id", "parse_status", "effective_date", "before_name", "after_name", "action")


@query("parser_rates", f"""WITH {_TXT} SELECT CASE WHEN doc_id % 2 = 0 THEN 'SSE_apply' ELSE 'SZSE_apply' END AS cohort, count(*) AS sample_count, count(*) FILTER (WHERE v) AS verified_count, {r('avg(CAST(v AS INTEGER))')} AS verified_rate
    FROM (SELECT doc_id, coalesce((form = 0 AND stated IS NOT NULL) OR (form IN (1, 6) AND nearest IS NOT NULL), false) AS v FROM dated) GROUP BY 1""")
def _(spark, sf):
    t = V.announcement_texts(spark, sf).withColumn("cohort", F.when(F.col("doc_id") % 2 == 0, "SSE_apply").otherwise("SZSE_apply"))
    return rounded(A.parser_rates(X.extract_status_events(t)))


# --- states around events ---------------------------------------------------------------------


@query("validate_states", """SELECT symbol, trade_date, any_value(is_st) AS is_st, any_value(trade_status) AS trade_status, any_value(close) AS close FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS trade_date, event_type = 'error' AS is_st, event_type <> 'signup' AS trade_status,
    CASE WHEN event_id % 29 <> 0 THEN value END AS close, event_type FROM events) WHERE event_type <> 'view' AND (NOT trade_status OR coalesce(close > 0, false)) GROUP BY 1, 2 HAVING count(*) = 1""")
def _(spark, sf):
    return N.validate_states(V.raw_states(spark, sf)).clean


@query("validate_states_violations", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, CASE WHEN event_id % 29 <> 0 THEN value END AS close FROM events) SELECT 'is_st_unknown' AS rule, count(*) AS keys FROM s WHERE event_type = 'view'
    UNION ALL SELECT 'tradable_without_close', count(*) FROM s WHERE event_type <> 'signup' AND NOT coalesce(close > 0, false) UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT user_id, d FROM s GROUP BY 1, 2 HAVING count(*) > 1)""")
def _(spark, sf):
    return N.validate_states(V.raw_states(spark, sf)).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


_AROUND = """around AS (SELECT v.*, p.trade_date AS prior_date, p.is_st AS prior_is_st, CAST(v.effective_date - p.trade_date AS INTEGER) AS prior_age, d.is_st AS day_is_st, d.trade_status AS day_trade FROM verified_events v
    ASOF LEFT JOIN states_daily p ON v.symbol = p.symbol AND v.effective_date > p.trade_date LEFT JOIN states_daily d ON d.symbol = v.symbol AND d.trade_date = v.effective_date)"""


@query("prior_state_as_of", with_views(["verified_events", "states_daily"], "SELECT symbol, effective_date, prior_date, prior_is_st, prior_age AS prior_age_days FROM around", {"around": _AROUND[_AROUND.index("(") + 1:-1]}))
def _(spark, sf):
    return state_around(V.verified_events(spark, sf), V.states_daily(spark, sf), "effective_date").select("symbol", "effective_date", "prior_date", "prior_is_st", "prior_age_days")


@query("exact_day_state", with_views(["verified_events", "states_daily"], "SELECT symbol, effective_date, day_is_st, day_trade AS day_trade_status FROM around", {"around": _AROUND[_AROUND.index("(") + 1:-1]}))
def _(spark, sf):
    return state_around(V.verified_events(spark, sf), V.states_daily(spark, sf), "effective_date").select("symbol", "effective_date", "day_is_st", "day_trade_status")


_RECON = {
    "around": _AROUND[_AROUND.index("(") + 1:-1],
    "recon": """SELECT *, CASE WHEN published > effective_date THEN 'publication_after_effective_date' WHEN published = effective_date THEN 'same_day_disclosure_timing_unverified' WHEN (CASE WHEN cohort LIKE '%\\_apply' ESCAPE '\\' THEN 'apply_st' ELSE 'remove_st' END) <> action
        OR action <> (CASE WHEN is_st_after THEN 'apply_st' ELSE 'remove_st' END) THEN 'pdf_direction_conflicts_with_announcement_cohort' WHEN day_is_st IS NULL THEN 'missing_effective_date_state' WHEN prior_is_st IS NULL OR prior_age > 20 THEN 'missing_or_stale_prior_state'
        WHEN prior_is_st <> is_st_before OR day_is_st <> is_st_after THEN 'independent_state_conflict' ELSE 'sample_match' END AS verdict FROM around WHERE pdf_sha256 <> 'bad' AND pdf_url LIKE 'http%'""",
}


@query("reconcile_events", with_views(["verified_events", "states_daily"], "SELECT symbol, effective_date, prior_date AS archived_previous_date, prior_is_st AS archived_previous_st, day_is_st AS archived_effective_st, verdict FROM recon", _RECON))
def _(spark, sf):
    return X.reconcile_events(V.verified_events(spark, sf), V.states_daily(spark, sf)).clean.select("symbol", "effective_date", "archived_previous_date", "archived_previous_st", "archived_effective_st", "verdict")


@query("reconcile_events_violations", with_views(["verified_events"], "SELECT 'digest_invalid' AS rule, count(*) AS keys FROM verified_events WHERE pdf_sha256 = 'bad' HAVING count(*) > 0 UNION ALL SELECT 'url_invalid', count(*) FROM verified_events WHERE pdf_url NOT LIKE 'http%' HAVING count(*) > 0"))
def _(spark, sf):
    return X.reconcile_events(V.verified_events(spark, sf), V.states_daily(spark, sf)).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


@query("verdict_counts", with_views(["verified_events", "states_daily"], "SELECT verdict, count(*) AS events, count(DISTINCT symbol) AS symbols FROM recon GROUP BY 1", _RECON))
def _(spark, sf):
    return A.verdict_counts(X.reconcile_events(V.verified_events(spark, sf), V.states_daily(spark, sf)).clean)


FIRST, LAST = "2024-01-03", "2024-01-28"
_NAMES = {"audit": f"""SELECT c.*, p.trade_date AS pd, p.is_st AS ps, d.is_st AS ds, d.trade_status AS dt, CASE WHEN contains(new_name, '退') AND is_st_before AND NOT is_st_after THEN 'delisting_rename_not_st_removal_evidence' WHEN d.is_st IS NULL THEN 'missing_exact_change_day_state'
    WHEN p.is_st IS NULL OR c.change_date - p.trade_date > 20 THEN 'missing_or_stale_previous_state' WHEN NOT d.trade_status THEN 'status_on_suspended_day_requires_review' WHEN p.is_st <> is_st_before OR d.is_st <> is_st_after THEN 'official_vs_archive_state_conflict'
    ELSE 'historical_state_matches_official_change' END AS verdict FROM name_changes c ASOF LEFT JOIN states_daily p ON c.symbol = p.symbol AND c.change_date > p.trade_date LEFT JOIN states_daily d ON d.symbol = c.symbol AND d.trade_date = c.change_date
    WHERE change_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND st_transition AND source <> 'other'"""}


def name_audit(spark, sf):
    return X.audit_name_transitions(V.name_changes(spark, sf), V.states_daily(spark, sf), first=FIRST, last=LAST)


@query("audit_name_transitions", with_views(["name_changes", "states_daily"], "SELECT symbol, change_date, old_name, new_name, pd AS previous_state_date, ps AS previous_state_st, ds AS change_day_state_st, verdict FROM audit", _NAMES))
def _(spark, sf):
    return name_audit(spark, sf).clean.select("symbol", "change_date", "old_name", "new_name", "previous_state_date", "previous_state_st", "change_day_state_st", "verdict")


@query("audit_name_transitions_violations", with_views(["name_changes"], f"SELECT 'unexpected_source' AS rule, count(*) AS keys FROM name_changes WHERE source = 'other' AND st_transition AND change_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' HAVING count(*) > 0"))
def _(spark, sf):
    return name_audit(spark, sf).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


@query("name_changes_to_transitions", with_views(["name_changes"], "SELECT symbol, change_date, contains(old_name, 'ST') AS is_st_before, contains(new_name, 'ST') AS is_st_after, st_transition FROM name_changes"))
def _(spark, sf):
    raw = V.name_changes(spark, sf).select(F.col("symbol").alias("证券代码"), F.col("change_date").cast("string").alias("变更日期"), F.col("old_name").alias("变更前证券简称"), F.col("new_name").alias("变更后简称"))
    out, _ = N.name_changes_to_transitions(raw)
    return out.select("symbol", "change_date", "is_st_before", "is_st_after", "st_transition")


_CROSS = {"around": _AROUND[_AROUND.index("(") + 1:-1], "near": "SELECT *, CASE WHEN prior_age <= 15 THEN prior_is_st END AS pst FROM around",
          "crossed": """SELECT *, CASE WHEN day_is_st IS NULL AND pst IS NULL THEN 'error:no_history' WHEN day_is_st IS NULL THEN 'missing_effective_date_row' WHEN pst IS NULL THEN 'missing_prior_state' WHEN pst = is_st_before AND day_is_st = is_st_after THEN 'matched' ELSE 'state_mismatch' END AS status FROM near"""}


@query("crosscheck_events", with_views(["verified_events", "states_daily"], "SELECT symbol, effective_date, status, status = 'matched' AS match FROM crossed", _CROSS))
def _(spark, sf):
    return X.crosscheck_events(V.verified_events(spark, sf), V.states_daily(spark, sf)).select("symbol", "effective_date", "status", "match")


@query("crosscheck_gate", with_views(["verified_events", "states_daily"], f"""SELECT count(*) AS event_count, count(*) FILTER (WHERE status = 'matched') AS matched_count, {r("avg(CAST(status = 'matched' AS INTEGER))")} AS match_rate, count(*) FILTER (WHERE status <> 'error:no_history') AS comparable_count,
    CASE WHEN count(*) >= 10 AND avg(CAST(status = 'matched' AS INTEGER)) >= 0.9 THEN 'pass' ELSE 'fail' END AS gate FROM crossed""", _CROSS))
def _(spark, sf):
    return rounded(A.crosscheck_gate(X.crosscheck_events(V.verified_events(spark, sf), V.states_daily(spark, sf))))


_SCOPE = {**_NAMES, "scoped": """SELECT *, symbol IN (SELECT symbol FROM lifecycle) AS member, CASE verdict WHEN 'delisting_rename_not_st_removal_evidence' THEN 'delisting_rename' WHEN 'status_on_suspended_day_requires_review' THEN 'suspended_effective_day' END AS scope
    FROM audit WHERE verdict <> 'historical_state_matches_official_change'"""}
_SV = ["name_changes", "states_daily", "lifecycle"]


@query("exception_scope", with_views(_SV, "SELECT symbol, change_date, verdict, scope, member AS is_a_share_member FROM scoped WHERE scope IS NOT NULL", _SCOPE))
def _(spark, sf):
    return X.exception_scope(name_audit(spark, sf).clean, V.lifecycle(spark, sf)).clean.select("symbol", "change_date", "verdict", "scope", "is_a_share_member")


@query("exception_scope_violations", with_views(_SV, "SELECT CASE WHEN verdict = 'missing_exact_change_day_state' THEN 'missing_state_of_a_share' ELSE 'unexpected_exception_class' END AS rule, count(*) AS keys FROM scoped WHERE scope IS NULL GROUP BY 1", _SCOPE))
def _(spark, sf):
    return X.exception_scope(name_audit(spark, sf).clean, V.lifecycle(spark, sf)).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


def _impact(spark, sf):
    events = X.exception_scope(name_audit(spark, sf).clean, V.lifecycle(spark, sf)).clean
    return X.exception_membership(events, V.states_daily(spark, sf).where(F.col("trade_status")))


@query("exception_membership", with_views(_SV, "SELECT symbol, change_date, scope, (SELECT count(*) FROM states_daily c WHERE c.symbol = s.symbol AND c.trade_status AND c.trade_date >= s.change_date) AS candidate_days_on_or_after FROM scoped s WHERE scope IS NOT NULL", _SCOPE))
def _(spark, sf):
    return _impact(spark, sf).select("symbol", "change_date", "scope", "candidate_days_on_or_after")


@query("exception_summary", with_views(_SV, """SELECT count(*) AS exception_events, CAST(0 AS BIGINT) AS b_share_events, count(*) FILTER (WHERE scope = 'delisting_rename') AS delisting_events, count(*) FILTER (WHERE scope = 'suspended_effective_day') AS suspended_events,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS membership_hits, coalesce(sum(n), 0) = 0 AS no_overlap FROM (SELECT s.*, (SELECT count(*) FROM states_daily c WHERE c.symbol = s.symbol AND c.trade_status AND c.trade_date >= s.change_date) AS n FROM scoped s WHERE scope IS NOT NULL)""", _SCOPE))
def _(spark, sf):
    return X.exception_summary(_impact(spark, sf))


@query("bad_candidate_days", with_views(["states_daily"], "SELECT trade_date, count(*) AS rows, count(DISTINCT symbol) AS names FROM states_daily GROUP BY 1 HAVING count(*) <> 60"))
def _(spark, sf):
    return X.bad_candidate_days(V.states_daily(spark, sf))
