"""Dated status events from announcement text and their audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import cohort_action, parse_flag
from tidemark.operators.asof import state_around
from tidemark.operators.checks import Checked, check_rows
from tidemark.operators.normalize import TRANSITION_SOURCE


def month_windows(periods: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Split each [start, end] into calendar-month windows."""
    months = periods.withColumn("_m", F.explode(F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("INTERVAL 1 MONTH"))))
    return months.withColumns({
        "window_start": F.greatest(F.col(start), F.col("_m").cast("date")), "window_end": F.least(F.col(end), F.last_day("_m")),
    }).drop("_m")


@dataclass(frozen=True)
class ExtractPatterns:
    """What X3 looks for. Name patterns give (before, after), dates (year, month, day)."""

    names: tuple[str, ...] = (
        "(?:股票|证券)?简称(?:将)?由[“\"]([^”\"]{1,20})[”\"](?:变更为|变为)[“\"]([^”\"]{1,20})[”\"]",
        "(?:股票|证券)?简称(?:将)?由([*A-Za-z0-9\\u4e00-\\u9fff]{2,16})(?:变更为|变为)([*A-Za-z0-9\\u4e00-\\u9fff]{2,16})",
    )
    dates: tuple[str, ...] = (
        "(?:(20[0-9]{2})年)?([0-9]{1,2})月([0-9]{1,2})日(?:开市|开盘|交易)?起",
        "(?:撤销|实施)?(?:其他|退市)?风险警示(?:的)?(?:起始日|实施日)(?:为|[:：])(?:(20[0-9]{2})年)?([0-9]{1,2})月([0-9]{1,2})日",
        "(?:撤销|实施)?(?:起始日|实施日)(?:为|[:：])(?:(20[0-9]{2})年)?([0-9]{1,2})月([0-9]{1,2})日",
    )
    risk: str = "风险警示"
    apply: str = "(?:实施|被实施)"
    remove: str = "撤销"
    continued: str = "继续(?:被)?实施.{0,30}风险警示"
    # A text without one of these literals cannot hold a match, so no pattern is run on it.
    names_need: tuple[str, ...] = ("变更为", "变为")
    dates_need: tuple[str, ...] = ("月",)
    max_distance: int = 500
    before_window: int = 220
    after_window: int = 300


def squeeze(text: Column) -> Column:
    """Remove all whitespace, the Unicode kinds included."""
    return F.regexp_replace(
        text, r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", ""
    )


def ascii_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones, which patterns and numbers read alike."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def _spans(hits: str, gaps: str) -> str:
    """SQL: (start, end, hit) of every match, from the matches and the pieces between them."""
    return f"""aggregate(
        zip_with({hits}, slice({gaps}, 1, size({hits})), (h, g) -> named_struct('hit', h, 'gap', g)),
        named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int,hit:string>>)),
        (acc, m) -> named_struct('at', acc.at + length(m.gap) + length(m.hit),
            'out', concat(acc.out, array(named_struct('s', acc.at + length(m.gap), 'e', acc.at + length(m.gap) + length(m.hit), 'hit', m.hit)))),
        acc -> acc.out)"""


def resolve_date(year: Column, month: Column, day: Column, announced: Column) -> Column:
    """A stated year must lie -60..+30 days from the announcement; without one the nearest of
    the three years around it within -730..+30 days."""
    def at(y: Column) -> Column:
        text = F.concat_ws("-", y.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return text.try_cast("date")

    base = announced.cast("date")
    stated = at(year)
    gap = F.datediff(stated, base)
    named = F.when((gap >= -60) & (gap <= 30), stated)
    around = F.array(*[
        F.struct(F.abs(F.datediff(at(F.year(base) + o), base)).alias("d"), F.lit(o).alias("o"), at(F.year(base) + o).alias("v")) for o in (-1, 0, 1)
    ])
    ok = F.filter(around, lambda c: c["v"].isNotNull() & F.datediff(c["v"], base).between(-730, 30))
    return F.when(F.coalesce(year, F.lit("")) != "", named).otherwise(F.array_min(ok)["v"])


def extract_status_events(announcements: DataFrame, patterns: ExtractPatterns = ExtractPatterns()) -> DataFrame:
    """Parse each announcement text to a status and at most one verified event.

    A document stays one row throughout: matches, positions and pairings are arrays inside the
    row, so a document with many matches never multiplies rows.  Input needs ``text`` and
    ``announcement_time`` (local); all columns are kept.
    """
    p = patterns
    df = announcements.withColumn("_text", ascii_digits(squeeze(F.coalesce("text", F.lit("")))))
    # Each pattern scans a text twice (matches, and the pieces between); groups are read from the
    # short matches afterwards, which is the same as no pattern looks around its match.
    nothing = F.array().cast("array<string>")
    for kind, regexes, needs in (("name", p.names, p.names_need), ("date", p.dates, p.dates_need)):
        may = F.lit(False)
        for literal in needs:
            may = may | F.contains(F.col("_text"), F.lit(literal))
        for i, rx in enumerate(regexes):
            df = df.withColumns({
                f"_{kind}{i}h": F.when(may, F.regexp_extract_all("_text", F.lit(rx), F.lit(0))).otherwise(nothing),
                f"_{kind}{i}g": F.when(may, F.split("_text", rx, -1)).otherwise(nothing),
            })
    for kind, regexes in (("name", p.names), ("date", p.dates)):
        df = df.withColumns({f"_{kind}{i}": F.expr(_spans(f"_{kind}{i}h", f"_{kind}{i}g")) for i in range(len(regexes))})
    clean = lambda c: F.regexp_replace(c, "^[“”\"' ]+|[“”\"' ]+$", "")
    st = lambda c: F.contains(F.upper(c), F.lit("ST"))

    def name_rows(i: int) -> Column:
        group = lambda m, g: clean(F.regexp_extract(m["hit"], p.names[i], g))
        return F.transform(f"_name{i}", lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"), group(m, 1).alias("before"), group(m, 2).alias("after"),
        ))

    def unseen(rows: Column, earlier: Column) -> Column:
        return F.filter(rows, lambda r: ~F.exists(earlier, lambda q: (q["s"] == r["s"]) & (q["e"] == r["e"])))

    changes = name_rows(0)
    for i in range(1, len(p.names)):
        changes = F.concat(changes, unseen(name_rows(i), changes))
    df = df.withColumn("_changes", changes).withColumn("_changes", F.filter("_changes", lambda c: st(c["before"]) != st(c["after"])))

    def date_rows(i: int) -> Column:
        group = lambda m, g: F.regexp_extract(m["hit"], p.dates[i], g)
        return F.transform(f"_date{i}", lambda m: F.struct(
            F.lit(i).alias("rank"), m["s"].alias("s"), m["e"].alias("e"),
            resolve_date(group(m, 1), group(m, 2), group(m, 3), F.col("announcement_time")).alias("value"),
        ))

    found = [date_rows(i) for i in range(len(p.dates))]
    df = df.withColumn("_dates", F.filter(F.concat(*found), lambda d: d["value"].isNotNull()))

    def pair(c: Column) -> Column:
        near = F.array_min(F.transform("_dates", lambda d: F.struct(
            F.least(F.abs(d["s"] - c["s"]), F.abs(d["e"] - c["e"])).alias("dist"), d["rank"].alias("rank"), d["s"].alias("s"), d["e"].alias("e"), d["value"].alias("value"),
        )))
        return F.struct(c.alias("c"), near.alias("d"))

    def judge(x: Column) -> Column:
        low = F.greatest(F.lit(0), F.least(x["c"]["s"], x["d"]["s"]) - p.before_window)
        high = F.least(F.length("_text"), F.greatest(x["c"]["e"], x["d"]["e"]) + p.after_window)
        window = F.substring(F.col("_text"), low + 1, high - low)
        after_st = st(x["c"]["after"])
        action = F.when(after_st & window.rlike(p.apply), "apply_st").when(
            ~after_st & window.rlike(p.remove) & ~window.rlike(p.continued), "remove_st"
        )
        action = F.when((x["d"]["dist"] <= p.max_distance) & window.rlike(p.risk), action)
        s_low = F.greatest(F.lit(0), F.least(x["c"]["s"], x["d"]["s"]) - 120)
        s_high = F.least(F.length("_text"), F.greatest(x["c"]["e"], x["d"]["e"]) + 180)
        return F.struct(
            F.struct(x["d"]["value"].alias("effective_date"), x["c"]["before"].alias("before_name"), x["c"]["after"].alias("after_name"), action.alias("action")).alias("key"),
            F.substring(F.col("_text"), s_low + 1, s_high - s_low).alias("snippet"),
        )

    df = df.withColumn("_pairs", F.transform("_changes", pair)).withColumn("_events", F.filter(F.transform("_pairs", judge), lambda e: e["key"]["action"].isNotNull()))
    distinct = F.size(F.array_distinct(F.transform("_events", lambda e: e["key"])))
    status = (
        F.when(F.length("_text") == 0, "no_text").when(F.size("_changes") == 0, "no_boolean_name_transition")
        .when(F.size("_dates") == 0, "no_explicit_effective_date").when(distinct == 0, "no_consistent_action_date_pair")
        .when(distinct > 1, "ambiguous_multiple_verified_events").otherwise("verified")
    )
    df = df.withColumn("parse_status", status).withColumn("_event", F.when(F.col("parse_status") == "verified", F.try_element_at("_events", F.lit(-1))))
    return df.select(
        *announcements.columns, "parse_status", F.col("_event.key.effective_date").alias("effective_date"), F.col("_event.key.before_name").alias("before_name"),
        F.col("_event.key.after_name").alias("after_name"), st(F.col("_event.key.before_name")).alias("is_st_before"),
        st(F.col("_event.key.after_name")).alias("is_st_after"), F.col("_event.key.action").alias("action"), F.col("_event.snippet").alias("evidence_snippet"),
    )


def reconcile_events(events: DataFrame, states: DataFrame, *, max_prior_age_days: int = 20) -> Checked:
    """Verified events against the state archive; verdicts in a fixed order."""
    if max_prior_age_days <= 0:
        raise ValueError("max_prior_age_days must be positive")
    typed = events.withColumns({
        "is_st_before": parse_flag(F.col("is_st_before")), "is_st_after": parse_flag(F.col("is_st_after")), "effective_date": F.col("effective_date").cast("date"),
    })
    checked = check_rows(typed, ["symbol", "effective_date"], {
        "effective_date_invalid": F.col("effective_date").isNotNull(), "publication_invalid": F.col("announcement_time").isNotNull(),
        "no_transition": F.col("is_st_before") != F.col("is_st_after"), "digest_invalid": F.col("pdf_sha256").rlike("^[0-9a-f]{64}$"),
        "url_invalid": F.col("pdf_url").startswith("http"),
    }, unique=["symbol", "effective_date", "pdf_sha256"])
    seen = state_around(checked.clean, states, "effective_date")
    published = F.col("announcement_time").cast("date")
    expected = F.when(F.col("is_st_after"), "apply_st").otherwise("remove_st")
    said = cohort_action(F.col("cohort"))
    verdict = (
        F.when(published > F.col("effective_date"), "publication_after_effective_date")
        .when(published == F.col("effective_date"), "same_day_disclosure_timing_unverified")
        .when((said != expected) | (F.col("action") != expected), "pdf_direction_conflicts_with_announcement_cohort")
        .when(F.col("day_is_st").isNull(), "missing_effective_date_state")
        .when(F.col("prior_is_st").isNull() | (F.col("prior_age_days") > max_prior_age_days), "missing_or_stale_prior_state")
        .when((F.col("prior_is_st") != F.col("is_st_before")) | (F.col("day_is_st") != F.col("is_st_after")), "independent_state_conflict")
        .otherwise("sample_match")
    )
    detail = seen.select(
        "symbol", "cohort", "announcement_time", "effective_date", "pdf_url", "pdf_sha256", said.alias("announcement_action"), F.col("action").alias("parsed_action"),
        F.col("is_st_before").alias("expected_before"), F.col("is_st_after").alias("expected_after"), F.col("prior_date").alias("archived_previous_date"),
        F.col("prior_is_st").alias("archived_previous_st"), F.col("day_is_st").alias("archived_effective_st"),
        F.col("prior_age_days").alias("previous_state_age_days"), verdict.alias("verdict"),
    )
    return Checked(detail, checked.violations)


def audit_name_transitions(
    changes: DataFrame, states: DataFrame, *, first: str, last: str, max_prior_age_days: int = 20
) -> Checked:
    """Official name transitions of a period against the state archive."""
    if max_prior_age_days <= 0 or first > last:
        raise ValueError("bad period or age")
    due = changes.where(F.col("change_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("st_transition"))
    checked = check_rows(due, ["symbol", "change_date"], {
        "unexpected_source": F.col("source") == TRANSITION_SOURCE, "no_transition": F.col("is_st_before") != F.col("is_st_after"),
    }, unique=["symbol", "change_date"])
    seen = state_around(checked.clean, states, "change_date")
    renamed = F.contains(F.col("new_name"), F.lit("退")) & F.col("is_st_before") & ~F.col("is_st_after")
    verdict = (
        F.when(renamed, "delisting_rename_not_st_removal_evidence").when(F.col("day_is_st").isNull(), "missing_exact_change_day_state")
        .when(F.col("prior_is_st").isNull() | (F.col("prior_age_days") > max_prior_age_days), "missing_or_stale_previous_state")
        .when(~F.col("day_trade_status"), "status_on_suspended_day_requires_review")
        .when((F.col("prior_is_st") != F.col("is_st_before")) | (F.col("day_is_st") != F.col("is_st_after")), "official_vs_archive_state_conflict")
        .otherwise("historical_state_matches_official_change")
    )
    detail = seen.select(
        "symbol", "change_date", "old_name", "new_name", F.col("is_st_before").alias("official_previous_st"), F.col("is_st_after").alias("official_effective_st"),
        F.col("prior_date").alias("previous_state_date"), F.col("prior_is_st").alias("previous_state_st"), F.col("day_is_st").alias("change_day_state_st"),
        F.col("day_trade_status").alias("change_day_trade_status"), F.col("prior_age_days").alias("previous_state_age_days"),
        renamed.alias("delisting_rename"), verdict.alias("verdict"),
    )
    return Checked(detail, checked.violations)


def crosscheck_events(events: DataFrame, states: DataFrame, *, before_days: int = 15) -> DataFrame:
    """Flags before and on the effective day, looking back a bounded number of days."""
    typed = events.withColumns({
        "is_st_before": parse_flag(F.col("is_st_before"), lenient=True), "is_st_after": parse_flag(F.col("is_st_after"), lenient=True),
    })
    seen = state_around(typed, states, "effective_date", max_age_days=before_days)
    match = (F.col("prior_is_st") == F.col("is_st_before")) & (F.col("day_is_st") == F.col("is_st_after"))
    status = (
        F.when(F.col("day_is_st").isNull() & F.col("prior_is_st").isNull(), "error:no_history").when(F.col("day_is_st").isNull(), "missing_effective_date_row")
        .when(F.col("prior_is_st").isNull(), "missing_prior_state").when(match, "matched").otherwise("state_mismatch")
    )
    return seen.select(
        "symbol", "effective_date", "action", F.col("is_st_before").alias("event_is_st_before"), F.col("is_st_after").alias("event_is_st_after"),
        F.when(F.col("day_is_st").isNotNull(), F.col("prior_date")).alias("archive_prior_date"),
        F.when(F.col("day_is_st").isNotNull(), F.col("prior_is_st")).alias("archive_is_st_before"), F.col("day_is_st").alias("archive_is_st_after"),
        status.alias("status"), F.coalesce(match, F.lit(False)).alias("match"),
    )


VERDICT_MATCH = "historical_state_matches_official_change"
VERDICT_MISSING = "missing_exact_change_day_state"
VERDICT_DELISTING = "delisting_rename_not_st_removal_evidence"
VERDICT_SUSPENDED = "status_on_suspended_day_requires_review"


def exception_scope(verdicts: DataFrame, lifecycle: DataFrame) -> Checked:
    """Non-matching verdicts with their scope; a missing state is only excused for B shares."""
    known = lifecycle.select("symbol").distinct().withColumn("is_a_share_member", F.lit(True))
    events = verdicts.where(F.col("verdict") != VERDICT_MATCH).join(known, "symbol", "left").withColumn(
        "is_a_share_member", F.coalesce("is_a_share_member", F.lit(False))
    )
    b_share = F.col("symbol").startswith("200") & ~F.col("is_a_share_member")
    scope = (
        F.when(F.col("verdict") == VERDICT_MISSING, F.when(b_share, "b_share_out_of_scope"))
        .when(F.col("verdict") == VERDICT_DELISTING, "delisting_rename").when(F.col("verdict") == VERDICT_SUSPENDED, "suspended_effective_day")
    )
    scoped = events.withColumn("scope", scope)
    rule = F.when(F.col("verdict") == VERDICT_MISSING, "missing_state_of_a_share").otherwise("unexpected_exception_class")
    bad = scoped.where(F.col("scope").isNull()).select(
        rule.alias("rule"), F.concat_ws("|", "symbol", F.col("change_date").cast("string")).alias("key"), F.lit(1).cast("long").alias("rows")
    )
    return Checked(scoped.where(F.col("scope").isNotNull()), bad)


def exception_membership(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate days of the same symbol on or after each exception.

    Both sides count per (symbol, day) first, then one ordered pass per symbol carries the number
    of later candidate days; event-by-day pairs are never formed.
    """
    days = candidates.select("symbol", "trade_date").distinct().join(events.select("symbol").distinct(), "symbol", "left_semi")
    asks = events.select("symbol", F.col("change_date").alias("_t")).distinct().select("symbol", "_t", F.lit(1).alias("_k"), F.lit(0).alias("_n"))
    marks = days.select("symbol", F.col("trade_date").alias("_t"), F.lit(0).alias("_k"), F.lit(1).alias("_n"))
    back = Window.partitionBy("symbol").orderBy(F.col("_t").desc(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(asks).withColumn("candidate_days_on_or_after", F.sum("_n").over(back)).where(F.col("_k") == 1).select(
        "symbol", F.col("_t").alias("change_date"), "candidate_days_on_or_after"
    )
    return events.join(counted, ["symbol", "change_date"], "left")


def bad_candidate_days(candidates: DataFrame, size: int = 60) -> DataFrame:
    """Days whose candidate list does not have exactly ``size`` distinct names."""
    per_day = candidates.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("names"))
    return per_day.where((F.col("rows") != size) | (F.col("names") != size))


def exception_summary(impact: DataFrame) -> DataFrame:
    """A26."""
    n = lambda scope: F.count_if(F.col("scope") == scope)
    return impact.agg(
        F.count(F.lit(1)).alias("exception_events"), n("b_share_out_of_scope").alias("b_share_events"), n("delisting_rename").alias("delisting_events"),
        n("suspended_effective_day").alias("suspended_events"), F.coalesce(F.sum("candidate_days_on_or_after"), F.lit(0)).alias("membership_hits"),
    ).withColumn("no_overlap", F.col("membership_hits") == 0)
