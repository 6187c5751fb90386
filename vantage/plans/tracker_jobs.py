"""Tracker jobs: readers, status rules and dashboard / analysis aggregates.

Every job reads the fixture tracker *as text* (rendered pipe lines parsed
back by the reader under test), so the whole chain a user runs is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import status as S
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import cadence as C
from ..operators import filters as F_
from ..operators import quality as DQ
from ..operators import sinks as SK
from ..operators import versions as VS
from ..operators import views as V
from ..operators.prefix import row_number_global
from ..session import once
from ..sources import tracker as TR
from ..sources.bindings import AS_OF_TRACKER, view
from . import sqlrules as Q
from .registry import register


def dashboard_apps(spark: SparkSession, sf: str, auto_number: bool = False) -> DataFrame:
    """Dashboard view of the tracker: mixed reader + ``contains`` status policy."""
    apps = TR.src_pipe_table_mixed(TR.render_tracker(view(spark, sf, "trk")), auto_number)
    return apps.withColumn("status", S.status_contains("status_raw"))


def script_apps(spark: SparkSession, sf: str, num_policy: str = "any") -> DataFrame:
    """Script view of the tracker: pipe reader + alias status policy + outcome + parseFloat score."""
    apps = TR.tracker_from_fixture(view(spark, sf, "trk"), num_policy)
    return (apps.withColumn("status", S.status_alias("status_raw"))
            .withColumn("outcome", S.outcome("status"))
            .withColumn("score", T.score_js("score_raw")))


DASH_STATUS = Q.status_contains("status_raw")
ALIAS_STATUS = Q.status_alias("status_raw")


# --- readers -----------------------------------------------------------------

@register("src_pipe_table", ("trk",), """
SELECT pos, num, date, company, role, score_raw, status_raw,
  CASE WHEN pdf = 'yes' THEN '✅' ELSE '❌' END AS pdf, report, notes
FROM trk
""")
def src_pipe_table(spark, sf):
    return TR.tracker_from_fixture(view(spark, sf, "trk"))


@register("src_pipe_table_mixed", ("trk",), f"""
SELECT pos, num, date, company, role, score_raw, {Q.score_strict('score_raw')} AS score, status_raw,
  pdf = 'yes' AS has_pdf,
  nullif(regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 1), '') AS report_num,
  CASE WHEN regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 1) <> ''
       THEN regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 2) END AS report_path,
  notes
FROM trk
""")
def src_pipe_table_mixed(spark, sf):
    return TR.src_pipe_table_mixed(TR.render_tracker(view(spark, sf, "trk")))


# --- status rules -------------------------------------------------------------

@register("cls_status_contains", ("trk",), f"SELECT pos, status_raw, {DASH_STATUS} AS status FROM trk")
def cls_status_contains(spark, sf):
    return dashboard_apps(spark, sf).select("pos", "status_raw", "status")


@register("cls_status_alias", ("trk",), f"SELECT pos, status_raw, {ALIAS_STATUS} AS status FROM trk")
def cls_status_alias(spark, sf):
    return script_apps(spark, sf).select("pos", "status_raw", "status")


@register("cls_status_priority", ("trk",), f"SELECT pos, {Q.status_priority('status_raw')} AS priority FROM trk")
def cls_status_priority(spark, sf):
    return dashboard_apps(spark, sf).select("pos", S.status_priority("status_raw").alias("priority"))


@register("cls_outcome", ("trk",), f"SELECT pos, {ALIAS_STATUS} AS status, {Q.outcome(ALIAS_STATUS)} AS outcome FROM trk")
def cls_outcome(spark, sf):
    return script_apps(spark, sf).select("pos", "status", "outcome")


# --- dashboard aggregates -------------------------------------------------------

@register("agg_cumulative_funnel", ("trk",), f"""
WITH a AS (SELECT {DASH_STATUS} AS s FROM trk),
c AS (SELECT count(*) AS total,
  count(*) FILTER (WHERE s IN ('applied','responded','interview','offer','rejected')) AS applied,
  count(*) FILTER (WHERE s IN ('responded','interview','offer')) AS responded,
  count(*) FILTER (WHERE s IN ('interview','offer')) AS interview,
  count(*) FILTER (WHERE s = 'offer') AS offer FROM a)
SELECT 1 AS stage_order, 'Evaluated' AS stage, total AS count, 100.0::DOUBLE AS pct FROM c
UNION ALL SELECT 2, 'Applied', applied, CASE WHEN total = 0 THEN 0.0 ELSE applied::DOUBLE / total::DOUBLE * 100.0 END FROM c
UNION ALL SELECT 3, 'Responded', responded, CASE WHEN applied = 0 THEN 0.0 ELSE responded::DOUBLE / applied::DOUBLE * 100.0 END FROM c
UNION ALL SELECT 4, 'Interview', interview, CASE WHEN applied = 0 THEN 0.0 ELSE interview::DOUBLE / applied::DOUBLE * 100.0 END FROM c
UNION ALL SELECT 5, 'Offer', offer, CASE WHEN applied = 0 THEN 0.0 ELSE offer::DOUBLE / applied::DOUBLE * 100.0 END FROM c
""")
def agg_cumulative_funnel(spark, sf):
    return A.cumulative_funnel(dashboard_apps(spark, sf))


@register("cls_status_strict", ("trk",), f"""
SELECT pos, status_raw, {Q.status_strict('status_raw')} AS status,
  {Q.status_strict('status_raw')} <> 'Evaluated' OR lower(trim(regexp_replace(replace(status_raw, '**', ''), '\\s+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*$', ''))) IN ('evaluated', 'evaluada', 'condicional', 'hold', 'evaluar', 'verificar') AS known
FROM trk
""")
def cls_status_strict(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", "status_raw", S.status_strict("status_raw").alias("status"),
                       S.status_strict_known("status_raw").alias("known"))


@register("cls_status_repair", ("trk",), f"""
SELECT pos, status_raw, {Q.status_repair('status_raw')} AS status, {Q.status_repair_note('status_raw')} AS note FROM trk
""")
def cls_status_repair(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", "status_raw", S.status_repair("status_raw").alias("status"),
                       S.status_repair_note("status_raw").alias("note"))


_REPAIR_SQL = f"""
b AS (SELECT pos, CAST(num AS VARCHAR) AS num, date, company, role, score_raw AS score, trim(status_raw) AS status,
  CASE WHEN pdf = 'yes' THEN '✅' ELSE '❌' END AS pdf, report, notes FROM trk),
r AS (SELECT *, {Q.status_repair('status')} AS fixed, {Q.status_repair_note('status')} AS moved FROM b),
a AS (SELECT pos, num, date, company, role, CASE WHEN hit THEN replace(score, '**', '') ELSE score END AS score,
  CASE WHEN hit THEN fixed ELSE status END AS status, pdf, report,
  CASE WHEN NOT hit OR moved IS NULL OR strpos(notes, moved) > 0 THEN notes WHEN notes = '' THEN moved ELSE moved || '. ' || notes END AS notes,
  fixed IS NULL AS unknown FROM (SELECT *, fixed IS NOT NULL AND fixed <> status AS hit FROM r))"""


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The tracker as it is and as the repair leaves it, each written as a version and read back."""
    base = SK.scratch_dir(spark, "tracker")
    old = SK.write_tracker_version(TR.render_tracker(view(spark, sf, "trk")), base, "1")
    new = SK.write_tracker_version(VS.repaired(spark.read.parquet(old)), base, "2")
    return spark.read.parquet(old), spark.read.parquet(new)


@register("cls_status_repair_tracker", ("trk",), f"""WITH {_REPAIR_SQL.strip()}
SELECT pos, '| ' || concat_ws(' | ', num, date, company, role, score, status, pdf, report, notes) || ' |' AS line, unknown FROM a""")
def cls_status_repair_tracker(spark, sf):
    """The tracker's lines after the repair, and which rows have a status that no rule knows."""
    return _versions(spark, sf)[1]


@register("cls_status_repair_log", ("trk",), f"""WITH {_REPAIR_SQL.strip()},
d AS (UNPIVOT (SELECT pos, score, status, notes FROM b) ON score, status, notes INTO NAME col VALUE before),
e AS (UNPIVOT (SELECT pos, score, status, notes FROM a) ON score, status, notes INTO NAME col VALUE after)
SELECT pos, 'update' AS change, col AS "column", before, after FROM d JOIN e USING (pos, col) WHERE before <> after""")
def cls_status_repair_log(spark, sf):
    """Every cell that the repair changed, from the difference of the two versions."""
    old, new = _versions(spark, sf)
    return VS.row_diff(VS.cell_columns(old), VS.cell_columns(new.drop("unknown")), "pos")


# --- text rules ---------------------------------------------------------------

@register("txt_parse_score", ("trk",), f"""
SELECT pos, score_raw, {Q.score_js('score_raw')} AS score_js, {Q.score_loose('score_raw')} AS score_loose,
  {Q.score_strict('score_raw')} AS score_strict FROM trk
""")
def txt_parse_score(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", "score_raw", T.score_js("score_raw").alias("score_js"),
                       T.score_loose("score_raw").alias("score_loose"),
                       T.score_strict("score_raw").alias("score_strict"))


@register("txt_report_ref", ("trk",), """
SELECT pos, TRY_CAST(nullif(regexp_extract(report, '\\[([0-9]+)\\]', 1), '') AS INTEGER) AS report_num,
  nullif(regexp_extract(report, '\\]\\(([^)]+)\\)', 1), '') AS report_path FROM trk
""")
def txt_report_ref(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", T.report_number("report").alias("report_num"), T.report_path("report").alias("report_path"))


@register("txt_company_key", ("trk",), f"""
SELECT pos, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS key_alnum,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(company), '[()]', '', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS key_spaced,
  {Q.company_key_suffix('company')} AS key_suffix,
  lower(trim(regexp_replace(company, '\\s+', ' ', 'g'))) AS key_ws
FROM trk
""")
def txt_company_key(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", T.company_key_alnum("company").alias("key_alnum"),
                       T.company_key_spaced("company").alias("key_spaced"),
                       T.company_key_suffix("company").alias("key_suffix"),
                       T.company_key_ws("company").alias("key_ws"))


@register("txt_company_key_safe", ("trk_intl",), f"""
SELECT pos, {Q.company_key_safe('company')} AS key_safe, {Q.company_key_safe_spaced('company')} AS key_safe_spaced,
  {Q.company_key_alnum('company')} AS key_alnum FROM trk_intl
""")
def txt_company_key_safe(spark, sf):
    apps = TR.tracker_from_fixture(view(spark, sf, "trk_intl"), "any")
    return apps.select("pos", T.company_key_safe("company").alias("key_safe"), T.company_key_safe_spaced("company").alias("key_safe_spaced"),
                       T.company_key_alnum("company").alias("key_alnum"))


@register("txt_slug", ("trk",), """
SELECT pos,
  regexp_replace(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  regexp_replace(regexp_replace(company, '[\\s/\\\\:*?"<>|]', '-', 'g'), '-+', '-', 'g') AS file_slug
FROM trk
""")
def txt_slug(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", T.slug("company").alias("slug"), T.file_slug("company").alias("file_slug"))


@register("txt_truncate", ("trk",), """
SELECT pos, CASE WHEN length(role) > 20 THEN substr(role, 1, 17) || '...' ELSE role END AS role_short FROM trk
""")
def txt_truncate(spark, sf):
    return dashboard_apps(spark, sf).select("pos", T.truncate_chars("role", 20).alias("role_short"))


@register("txt_contacts", ("trk",), """
WITH e AS (SELECT pos, notes, unnest(regexp_extract_all(notes, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+')) AS email FROM trk)
SELECT pos, email,
  nullif(regexp_extract(split_part(notes, email, 1),
    '(?i)(?:Emailed|emailed|contact[:\\s]+|to\\s+)([A-Z][a-z]+ ?[A-Z]?[a-z]*)\\s*(?:at|@|$)', 1), '') AS name
FROM e
""")
def txt_contacts(spark, sf):
    apps = script_apps(spark, sf)
    return T.contacts(apps, "notes").select("pos", "email", "name")


# --- date rules ---------------------------------------------------------------

@register("dat_parse", ("trk",), """
SELECT pos, CASE WHEN regexp_matches(trim(date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(trim(date) AS DATE) END AS date_d FROM trk
""")
def dat_parse(spark, sf):
    return script_apps(spark, sf).select("pos", D.parse_strict("date").alias("date_d"))


@register("dat_days_between", ("trk",), f"""
SELECT pos, date_diff('day', TRY_CAST(date AS DATE), DATE '{AS_OF_TRACKER}') AS days FROM trk
""")
def dat_days_between(spark, sf):
    apps = script_apps(spark, sf)
    return apps.select("pos", D.days_between(D.parse_strict("date"), F.lit(AS_OF_TRACKER).cast("date")).alias("days"))


# --- analysis / dashboard aggregates --------------------------------------------

@register("agg_status_funnel", ("trk",), f"""
WITH a AS (SELECT {ALIAS_STATUS} AS status FROM trk), t AS (SELECT count(*) AS total FROM a)
SELECT status, count(*) AS count, CAST(floor(count(*)::DOUBLE / any_value(t.total) * 100 + 0.5) AS BIGINT) AS pct
FROM a, t GROUP BY status
""")
def agg_status_funnel(spark, sf):
    return A.status_funnel(script_apps(spark, sf))


def _score_by_outcome_sql():
    parts = []
    for o in A.OUTCOMES:
        parts.append(f"""SELECT '{o}' AS outcome,
  coalesce(floor(avg(score) FILTER (WHERE outcome = '{o}' AND score > 0) * 100 + 0.5) / 100, 0.0) AS avg,
  coalesce(min(score) FILTER (WHERE outcome = '{o}' AND score > 0), 0.0) AS min,
  coalesce(max(score) FILTER (WHERE outcome = '{o}' AND score > 0), 0.0) AS max,
  count(*) FILTER (WHERE outcome = '{o}' AND score > 0) AS count FROM a""")
    return (f"WITH a AS (SELECT {Q.outcome(ALIAS_STATUS)} AS outcome, {Q.score_js('score_raw')} AS score FROM trk)\n"
            + "\nUNION ALL ".join(parts))


@register("agg_score_by_outcome", ("trk",), _score_by_outcome_sql())
def agg_score_by_outcome(spark, sf):
    return A.score_by_outcome(script_apps(spark, sf))


@register("agg_analysis_meta", ("trk",), f"""
WITH a AS (SELECT date, {Q.outcome(ALIAS_STATUS)} AS outcome FROM trk)
SELECT count(*) AS total, min(nullif(date, '')) AS date_from, max(nullif(date, '')) AS date_to,
  count(*) FILTER (WHERE outcome = 'positive') AS positive, count(*) FILTER (WHERE outcome = 'negative') AS negative,
  count(*) FILTER (WHERE outcome = 'self_filtered') AS self_filtered, count(*) FILTER (WHERE outcome = 'pending') AS pending
FROM a
""")
def agg_analysis_meta(spark, sf):
    return A.analysis_meta(script_apps(spark, sf))


@register("agg_score_threshold", ("trk",), f"""
WITH a AS (SELECT {Q.outcome(ALIAS_STATUS)} AS outcome, {Q.score_js('score_raw')} AS score FROM trk),
m AS (SELECT min(score) FILTER (WHERE outcome = 'positive' AND score > 0) AS lo,
             max(score) FILTER (WHERE outcome = 'positive' AND score > 0) AS hi FROM a)
SELECT CASE WHEN lo > 0 THEN floor(lo * 10.0) / 10.0 ELSE 3.5 END AS recommended,
  coalesce(lo, 0.0) AS min_positive,
  CASE WHEN lo IS NOT NULL THEN
    (CASE WHEN lo = floor(lo) THEN CAST(CAST(lo AS BIGINT) AS VARCHAR) ELSE CAST(lo AS VARCHAR) END) || ' - ' ||
    (CASE WHEN hi = floor(hi) THEN CAST(CAST(hi AS BIGINT) AS VARCHAR) ELSE CAST(hi AS VARCHAR) END)
  ELSE 'N/A' END AS positive_range
FROM m
""")
def agg_score_threshold(spark, sf):
    return A.score_threshold(script_apps(spark, sf))


@register("agg_pipeline_metrics", ("trk",), f"""
WITH a AS (SELECT {DASH_STATUS} AS s, {Q.score_strict('score_raw')} AS score, pdf = 'yes' AS has_pdf FROM trk)
SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE 'status' END AS level, s AS status,
  count(*) AS total, round(coalesce(avg(score) FILTER (WHERE score > 0), 0.0), 9) AS avg_score,
  coalesce(max(score) FILTER (WHERE score > 0), 0.0) AS top_score,
  count(*) FILTER (WHERE has_pdf) AS with_pdf,
  count(*) FILTER (WHERE s NOT IN ('skip', 'rejected', 'discarded')) AS actionable
FROM a GROUP BY ROLLUP (s)
""")
def agg_pipeline_metrics(spark, sf):
    m = A.pipeline_metrics(dashboard_apps(spark, sf))
    return m.withColumn("avg_score", F.round("avg_score", 9))


@register("agg_rates", ("trk",), f"""
WITH a AS (SELECT {DASH_STATUS} AS s, {Q.score_strict('score_raw')} AS score FROM trk),
c AS (SELECT count(*) FILTER (WHERE s IN ('applied','responded','interview','offer','rejected')) AS applied,
  count(*) FILTER (WHERE s IN ('responded','interview','offer')) AS responded,
  count(*) FILTER (WHERE s IN ('interview','offer')) AS interview,
  count(*) FILTER (WHERE s = 'offer') AS total_offers,
  count(*) FILTER (WHERE s NOT IN ('skip','rejected','discarded')) AS active_apps,
  avg(score) FILTER (WHERE score > 0) AS avg_score, max(score) FILTER (WHERE score > 0) AS top_score FROM a)
SELECT CASE WHEN applied > 0 THEN responded::DOUBLE / applied::DOUBLE * 100.0 ELSE 0.0 END AS response_rate,
  CASE WHEN applied > 0 THEN interview::DOUBLE / applied::DOUBLE * 100.0 ELSE 0.0 END AS interview_rate,
  CASE WHEN applied > 0 THEN total_offers::DOUBLE / applied::DOUBLE * 100.0 ELSE 0.0 END AS offer_rate,
  total_offers, active_apps, round(coalesce(avg_score, 0.0), 9) AS avg_score, coalesce(top_score, 0.0) AS top_score
FROM c
""")
def agg_rates(spark, sf):
    return A.rates(dashboard_apps(spark, sf)).withColumn("avg_score", F.round("avg_score", 9))


@register("agg_score_buckets", ("trk",), f"""
WITH a AS (SELECT {Q.score_strict('score_raw')} AS score FROM trk)
SELECT 1 AS band_order, '4.5-5.0' AS band, count(*) FILTER (WHERE score >= 4.5) AS count FROM a
UNION ALL SELECT 2, '4.0-4.4', count(*) FILTER (WHERE score >= 4.0 AND score < 4.5) FROM a
UNION ALL SELECT 3, '3.5-3.9', count(*) FILTER (WHERE score >= 3.5 AND score < 4.0) FROM a
UNION ALL SELECT 4, '3.0-3.4', count(*) FILTER (WHERE score >= 3.0 AND score < 3.5) FROM a
UNION ALL SELECT 5, '  <3.0', count(*) FILTER (WHERE score > 0 AND score < 3.0) FROM a
""")
def agg_score_buckets(spark, sf):
    return A.score_buckets(dashboard_apps(spark, sf))


@register("agg_weekly_activity", ("trk",), """
WITH w AS (SELECT CAST(isoyear(TRY_CAST(date AS DATE)) AS VARCHAR) || '-W' || lpad(CAST(week(TRY_CAST(date AS DATE)) AS VARCHAR), 2, '0') AS week
           FROM trk WHERE regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(date AS DATE) IS NOT NULL)
SELECT week, count(*) AS count FROM w GROUP BY week ORDER BY week DESC LIMIT 8
""")
def agg_weekly_activity(spark, sf):
    return A.weekly_activity(dashboard_apps(spark, sf))


@register("agg_tracker_summary", ("trk",), f"""
WITH a AS (SELECT {DASH_STATUS} AS s, {Q.score_strict('score_raw')} AS score, pdf = 'yes' AS has_pdf,
  regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 1) <> '' AS has_report FROM trk)
SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE 'status' END AS level, s AS status,
  count(*) AS total, round(coalesce(avg(score) FILTER (WHERE score > 0), 0.0), 9) AS avg_score,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) FILTER (WHERE has_pdf))::DOUBLE / count(*)::DOUBLE * 100.0 END AS pdf_pct,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) FILTER (WHERE has_report))::DOUBLE / count(*)::DOUBLE * 100.0 END AS report_pct
FROM a GROUP BY ROLLUP (s)
""")
def agg_tracker_summary(spark, sf):
    return A.tracker_summary(dashboard_apps(spark, sf))


@register("agg_tab_counts", ("trk",), f"""
WITH a AS (SELECT {DASH_STATUS} AS s, {Q.score_strict('score_raw')} AS score FROM trk)
SELECT 0 AS tab_order, 'all' AS tab, 'ALL' AS label, count(*) AS count FROM a
UNION ALL SELECT 1, 'evaluated', 'EVALUATED', count(*) FILTER (WHERE s = 'evaluated') FROM a
UNION ALL SELECT 2, 'applied', 'APPLIED', count(*) FILTER (WHERE s = 'applied') FROM a
UNION ALL SELECT 3, 'interview', 'INTERVIEW', count(*) FILTER (WHERE s = 'interview') FROM a
UNION ALL SELECT 4, 'top', 'TOP ≥4', count(*) FILTER (WHERE score >= 4.0 AND s <> 'skip') FROM a
UNION ALL SELECT 5, 'skip', 'SKIP', count(*) FILTER (WHERE s = 'skip') FROM a
UNION ALL SELECT 6, 'rejected', 'REJECTED', count(*) FILTER (WHERE s = 'rejected') FROM a
UNION ALL SELECT 7, 'discarded', 'DISCARDED', count(*) FILTER (WHERE s = 'discarded') FROM a
""")
def agg_tab_counts(spark, sf):
    return V.tab_counts(dashboard_apps(spark, sf))


# --- filters, sorts, ranking ------------------------------------------------------

def _tab_sql():
    parts = []
    for t in V.TABS:
        cond = "TRUE" if t == "all" else ("score >= 4.0 AND s <> 'skip'" if t == "top" else f"s = '{t}'")
        parts.append(f"SELECT '{t}' AS tab, pos FROM a WHERE {cond}")
    return (f"WITH a AS (SELECT pos, {DASH_STATUS} AS s, {Q.score_strict('score_raw')} AS score FROM trk)\n"
            + "\nUNION ALL ".join(parts))


@register("flt_view_tab", ("trk",), _tab_sql())
def flt_view_tab(spark, sf):
    return V.flt_view_tab(dashboard_apps(spark, sf)).select("tab", "pos")


@register("flt_actionable", ("trk",), f"""
SELECT pos, num, {ALIAS_STATUS} AS status FROM trk
WHERE {ALIAS_STATUS} IN ('applied', 'responded', 'interview')
  AND regexp_matches(trim(date), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(trim(date) AS DATE) IS NOT NULL
""")
def flt_actionable(spark, sf):
    apps = script_apps(spark, sf)
    return apps.where(F.col("status").isin(*C.ACTIONABLE) & D.parse_strict("date").isNotNull()) \
        .select("pos", "num", "status")


@register("flt_min_evidence", ("trk",), f"""
SELECT count(*) FILTER (WHERE {ALIAS_STATUS} <> 'evaluated') AS current, 5 AS threshold,
  count(*) FILTER (WHERE {ALIAS_STATUS} <> 'evaluated') >= 5 AS enough FROM trk
""")
def flt_min_evidence(spark, sf):
    return F_.min_evidence(script_apps(spark, sf), threshold=5)


def _sort_sql():
    pri = Q.status_priority("status_raw")
    modes = {
        "score": "score DESC", "date": "date DESC", "company": "lower(company) ASC", "status": f"{pri} ASC",
    }
    parts = []
    for mode, key in modes.items():
        parts.append(f"SELECT '{mode}' AS mode, FALSE AS grouped, pos, row_number() OVER (ORDER BY {key}, pos) AS rank FROM a")
        inner = key if mode != "status" else "score DESC"
        parts.append(f"SELECT '{mode}' AS mode, TRUE AS grouped, pos, row_number() OVER (ORDER BY {pri} ASC, {inner}, pos) AS rank FROM a")
    return (f"WITH a AS (SELECT pos, date, company, status_raw, {Q.score_strict('score_raw')} AS score FROM trk)\n"
            + "\nUNION ALL ".join(parts))


@register("srt_view", ("trk",), _sort_sql())
def srt_view(spark, sf):
    return V.srt_view(dashboard_apps(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


# Offer dimensions (1-5) derived from the order row, one per scoring-matrix dimension.
_DIMS_SQL = ",\n  ".join(
    f"CAST(1 + (o_orderkey * {p} + o_custkey) % 5 AS INT) AS {d}"
    for d, p in zip(["target", "match", "level", "pay", "growth", "remote", "reputation", "stack", "speed", "culture"],
                    [3, 7, 11, 13, 17, 19, 23, 29, 31, 37])
)


@register("top_weighted_rank", ("orders",), f"""
WITH d AS (SELECT o_orderkey AS pos, {_DIMS_SQL} FROM orders),
w AS (SELECT pos, round((target * 25.0 + match * 15.0 + level * 15.0 + pay * 10.0 + growth * 10.0 + remote * 5.0
   + reputation * 5.0 + stack * 5.0 + speed * 5.0 + culture * 5.0) / 100.0, 2) AS weighted FROM d)
SELECT pos, weighted, row_number() OVER (ORDER BY weighted DESC, pos) AS rank FROM w
""")
def top_weighted_rank(spark, sf):
    o = view(spark, sf, "orders")
    dims = o.select(F.col("o_orderkey").alias("pos"), *[
        (1 + (F.col("o_orderkey") * p + F.col("o_custkey")) % 5).cast("int").alias(d)
        for d, p in zip(V.OFFER_WEIGHTS, [3, 7, 11, 13, 17, 19, 23, 29, 31, 37])
    ])
    return V.top_weighted_rank(dims, V.OFFER_WEIGHTS).select("pos", "weighted", F.col("rank").cast("long"))


_PROJECT_PRIMES = dict(zip(V.PROJECT_WEIGHTS, [3, 7, 11, 13, 17, 19]))


@register("top_project_rank", ("part",), f"""
WITH d AS (SELECT p_partkey AS pos, {", ".join(f"CAST(1 + (p_partkey * {k} + p_size) % 5 AS INT) AS {d}" for d, k in _PROJECT_PRIMES.items())} FROM part),
w AS (SELECT pos, round(({" + ".join(f"{d} * {w}.0" for d, w in V.PROJECT_WEIGHTS.items())}) / 100.0, 2) AS weighted FROM d)
SELECT pos, weighted, row_number() OVER (ORDER BY weighted DESC, pos) AS rank FROM w
""")
def top_project_rank(spark, sf):
    """Project ideas ranked by the six project weights."""
    dims = view(spark, sf, "part").select(F.col("p_partkey").alias("pos"), *[
        (1 + (F.col("p_partkey") * k + F.col("p_size")) % 5).cast("int").alias(d) for d, k in _PROJECT_PRIMES.items()])
    return V.top_weighted_rank(dims, V.PROJECT_WEIGHTS).select("pos", "weighted", F.col("rank").cast("long"))


# --- data-quality checks -----------------------------------------------------------

_DQ_STATUS_SQL = f"""
SELECT 'status' AS "check", 'error' AS severity, CAST(num AS VARCHAR) AS key, flag || ': ' || status_raw AS detail FROM (
  SELECT num, status_raw, 'non_canonical' AS flag FROM trk
   WHERE {Q.status_clean('status_raw')} NOT IN ('evaluated','applied','responded','interview','offer','rejected','discarded','skip')
     AND {Q.status_clean('status_raw')} NOT IN {Q.in_list(S.ALIASES.keys())}
  UNION ALL SELECT num, status_raw, 'bold' FROM trk WHERE strpos(status_raw, '**') > 0
  UNION ALL SELECT num, status_raw, 'date' FROM trk WHERE regexp_matches(status_raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
) f"""

_DUP_KEYS = """(SELECT num, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') || '::' || regexp_replace(lower(role), '[^a-z0-9 ]', '', 'g') AS dup_key FROM trk)"""
_DQ_DUP_SQL = f"""
SELECT 'duplicates' AS "check", 'warning' AS severity, dup_key AS key,
  CAST(count(*) AS VARCHAR) || ' rows, #' || CAST(min(num) AS VARCHAR) || ' to #' || CAST(max(num) AS VARCHAR) AS detail
FROM {_DUP_KEYS} k GROUP BY dup_key HAVING count(*) > 1"""

_DQ_SCORE_SQL = """
SELECT 'score_format' AS "check", 'error' AS severity, CAST(num AS VARCHAR) AS key, score_raw AS detail FROM trk
WHERE NOT regexp_matches(trim(replace(score_raw, '**', '')), '^[0-9]+\\.?[0-9]*/5$')
  AND trim(replace(score_raw, '**', '')) NOT IN ('N/A', 'DUP')"""

_DQ_BOLD_SQL = """
SELECT 'bold_score' AS "check", 'warning' AS severity, CAST(num AS VARCHAR) AS key, score_raw AS detail FROM trk
WHERE strpos(score_raw, '**') > 0"""

_DQ_LINKS_SQL = """
SELECT 'report_links' AS "check", 'error' AS severity, CAST(num AS VARCHAR) AS key, p AS detail FROM (
  SELECT num, nullif(regexp_extract(report, '\\]\\(([^)]+)\\)', 1), '') AS p FROM trk) t
WHERE p IS NOT NULL AND p NOT IN (SELECT path FROM rep)"""


@register("dq_status", ("trk",), _DQ_STATUS_SQL)
def dq_status(spark, sf):
    return DQ.dq_status(script_apps(spark, sf))


@register("dq_duplicates", ("trk",), _DQ_DUP_SQL)
def dq_duplicates(spark, sf):
    return DQ.dq_duplicates(script_apps(spark, sf))


@register("dq_duplicate_members", ("trk",), f"""
WITH k AS (SELECT dup_key, num FROM {_DUP_KEYS})
SELECT dup_key, num FROM k WHERE dup_key IN (SELECT dup_key FROM k GROUP BY dup_key HAVING count(*) > 1)""")
def dq_duplicate_members(spark, sf):
    """Every row of the groups that ``dq_duplicates`` counts (``verify-pipeline.mjs:119-123`` prints them)."""
    return DQ.duplicate_members(script_apps(spark, sf))


@register("dq_score_format", ("trk",), _DQ_SCORE_SQL)
def dq_score_format(spark, sf):
    return DQ.dq_score_format(script_apps(spark, sf))


@register("dq_bold_score", ("trk",), _DQ_BOLD_SQL)
def dq_bold_score(spark, sf):
    return DQ.dq_bold_score(script_apps(spark, sf))


@register("dq_report_links", ("trk", "rep"), _DQ_LINKS_SQL)
def dq_report_links(spark, sf):
    return DQ.dq_report_links(script_apps(spark, sf), view(spark, sf, "rep"))


_DQ_ROWS_SQL = """
SELECT 'row_format' AS "check", 'error' AS severity, CAST(pos AS VARCHAR) AS key, line AS detail FROM (
  SELECT pos, '| ' || CAST(num AS VARCHAR) || ' | ' || date || ' | ' || company || ' | ' || role || ' |' AS line FROM trk WHERE pos % 10 = 3
  UNION ALL SELECT pos, '| ' || CAST(num AS VARCHAR) || ' | ' || date || ' | ' || company || ' | ' || role || ' | ' || score_raw || ' | ' || status_raw || ' | x | ' || report || ' | ' || notes || ' |' FROM trk WHERE pos % 10 <> 3) l
WHERE line LIKE '|%' AND strpos(line, '---') = 0 AND strpos(line, 'Empresa') = 0 AND len(string_split(line, '|')) < 9"""


@register("dq_row_format", ("trk",), _DQ_ROWS_SQL)
def dq_row_format(spark, sf):
    return DQ.dq_row_format(_damaged_lines(spark, sf))


def _damaged_lines(spark, sf):
    """Tracker text where every tenth row lost its trailing cells (the malformed-row case)."""
    trk = view(spark, sf, "trk")
    short = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("num").cast("string"), "date", "company", "role"), F.lit(" |"))
    full = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("num").cast("string"), "date", "company", "role", "score_raw",
                                             "status_raw", F.lit("x"), "report", "notes"), F.lit(" |"))
    return trk.select("pos", once(F.when(F.col("pos") % 10 == 3, short).otherwise(full)).alias("line"))


@register("dq_pending_files", ("adds",), """
SELECT 'pending_files' AS "check", 'warning' AS severity, 'tracker-additions' AS key,
  CAST(count(*) AS VARCHAR) || ' pending TSVs' AS detail FROM adds WHERE suffix(file, '.tsv') HAVING count(*) > 0
""")
def dq_pending_files(spark, sf):
    return DQ.dq_pending_files(view(spark, sf, "adds"))


@register("dq_summary", ("trk", "rep", "adds"), f"""
WITH f AS ({_DQ_STATUS_SQL} UNION ALL {_DQ_DUP_SQL} UNION ALL {_DQ_SCORE_SQL} UNION ALL {_DQ_BOLD_SQL} UNION ALL {_DQ_LINKS_SQL} UNION ALL {_DQ_ROWS_SQL}
  UNION ALL SELECT 'pending_files', 'warning', 'x', 'y' FROM (SELECT count(*) AS n FROM adds) WHERE n > 0)
SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
  CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'error'
       WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'warn' ELSE 'clean' END AS verdict
FROM f
""")
def dq_summary(spark, sf):
    apps = script_apps(spark, sf)
    return DQ.dq_summary(DQ.finding_counts(apps), [
        DQ.dq_duplicates(apps), DQ.dq_report_links(apps, view(spark, sf, "rep")), DQ.dq_row_format(_damaged_lines(spark, sf)),
        DQ.dq_pending_files(view(spark, sf, "adds"))])


# --- follow-up cadence ----------------------------------------------------------------

def followups(spark, sf):
    return TR.src_followups(TR.render_followups(view(spark, sf, "fol")))


_CADENCE_SQL = f"""
a AS (SELECT pos, num, date, company, role, {ALIAS_STATUS} AS status, TRY_CAST(date AS DATE) AS app_date FROM trk),
act AS (SELECT * FROM a WHERE status IN ('applied', 'responded', 'interview') AND app_date IS NOT NULL
        AND regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')),
fs AS (SELECT app_num, count(*) AS n, max(date) AS last_fu FROM fol GROUP BY app_num),
j AS (SELECT act.*, CAST(coalesce(fs.n, 0) AS INTEGER) AS followup_count, TRY_CAST(fs.last_fu AS DATE) AS last_d
      FROM act LEFT JOIN fs ON fs.app_num = act.num),
k AS (SELECT *, date_diff('day', app_date, DATE '{AS_OF_TRACKER}') AS days_app,
             date_diff('day', last_d, DATE '{AS_OF_TRACKER}') AS days_fu,
  CASE WHEN status = 'applied' THEN (CASE WHEN followup_count >= 2 THEN NULL
                                          WHEN followup_count = 0 THEN app_date + INTERVAL 7 DAY
                                          WHEN last_d IS NOT NULL THEN last_d + INTERVAL 7 DAY
                                          ELSE app_date + INTERVAL 7 DAY END)
       WHEN status = 'responded' THEN coalesce(last_d + INTERVAL 3 DAY, app_date + INTERVAL 3 DAY)
       WHEN status = 'interview' THEN app_date + INTERVAL 1 DAY END AS nxt FROM j),
c AS (SELECT pos, num, date, company, role, status, days_app AS days_since_application,
  days_fu AS days_since_last_followup, followup_count,
  CASE WHEN status = 'applied' THEN (CASE WHEN followup_count >= 2 THEN 'cold'
         WHEN followup_count = 0 AND days_app >= 7 THEN 'overdue'
         WHEN followup_count > 0 AND days_fu IS NOT NULL AND days_fu >= 7 THEN 'overdue' ELSE 'waiting' END)
       WHEN status = 'responded' THEN (CASE WHEN days_app < 1 THEN 'urgent' WHEN days_app >= 3 THEN 'overdue' ELSE 'waiting' END)
       WHEN status = 'interview' THEN (CASE WHEN days_app >= 1 THEN 'overdue' ELSE 'waiting' END)
       ELSE 'waiting' END AS urgency,
  CAST(nxt AS DATE) AS next_followup_date, date_diff('day', DATE '{AS_OF_TRACKER}', CAST(nxt AS DATE)) AS days_until_next FROM k)"""


def cadence_rows(spark, sf):
    return C.cadence(script_apps(spark, sf), followups(spark, sf), AS_OF_TRACKER)


@register("cls_urgency", ("trk", "fol"), f"WITH {_CADENCE_SQL} SELECT pos, status, followup_count, urgency FROM c")
def cls_urgency(spark, sf):
    return cadence_rows(spark, sf).select("pos", "status", "followup_count", "urgency")


@register("dat_next_followup", ("trk", "fol"), f"WITH {_CADENCE_SQL} SELECT pos, next_followup_date, days_until_next FROM c")
def dat_next_followup(spark, sf):
    return cadence_rows(spark, sf).select("pos", "next_followup_date", "days_until_next")


@register("join_followups", ("trk", "fol"), f"""
WITH {_CADENCE_SQL} SELECT pos, num, followup_count, days_since_last_followup FROM c""")
def join_followups(spark, sf):
    return cadence_rows(spark, sf).select("pos", "num", "followup_count", "days_since_last_followup")


@register("agg_cadence_meta", ("trk", "fol"), f"""
WITH {_CADENCE_SQL}
SELECT (SELECT count(*) FROM trk) AS tracked, count(*) AS actionable,
  count(*) FILTER (WHERE urgency = 'overdue') AS overdue, count(*) FILTER (WHERE urgency = 'urgent') AS urgent,
  count(*) FILTER (WHERE urgency = 'cold') AS cold, count(*) FILTER (WHERE urgency = 'waiting') AS waiting FROM c
""")
def agg_cadence_meta(spark, sf):
    apps = script_apps(spark, sf)
    rows = C.cadence(apps, followups(spark, sf), AS_OF_TRACKER)
    u = F.col("urgency")
    meta = rows.agg(F.count(F.lit(1)).alias("actionable"),
                    *[F.count_if(u == k).alias(k) for k in ["overdue", "urgent", "cold", "waiting"]])
    return A.with_scalars(meta, apps.agg(F.count(F.lit(1)).alias("tracked"))).select(
        "tracked", "actionable", "overdue", "urgent", "cold", "waiting")


@register("srt_urgency", ("trk", "fol"), f"""
WITH {_CADENCE_SQL}
SELECT pos, urgency, row_number() OVER (ORDER BY CASE urgency WHEN 'urgent' THEN 0 WHEN 'overdue' THEN 1
  WHEN 'waiting' THEN 2 WHEN 'cold' THEN 3 ELSE 9 END, pos) AS rank FROM c
""")
def srt_urgency(spark, sf):
    rows = cadence_rows(spark, sf).select("pos", "urgency")
    return row_number_global(rows, [C.urgency_rank(F.col("urgency")), F.col("pos")], "rank") \
        .select("pos", "urgency", F.col("rank").cast("long"))


@register("flt_overdue_only", ("trk", "fol"), f"WITH {_CADENCE_SQL} SELECT pos, urgency FROM c WHERE urgency IN ('overdue', 'urgent')")
def flt_overdue_only(spark, sf):
    return cadence_rows(spark, sf).where(F.col("urgency").isin("overdue", "urgent")).select("pos", "urgency")
