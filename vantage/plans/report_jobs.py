"""Report jobs: extraction from evaluation documents and the pattern analysis.

The analysis joins the tracker to parsed reports once (``enriched``); the
three breakdowns share one ``GROUPING SETS`` pass and gaps are exploded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..operators import aggregates as A
from ..session import once
from ..sources import reports as R
from ..sources.bindings import view
from . import sqlrules as Q
from .registry import register
from .tracker_jobs import ALIAS_STATUS, script_apps


def reports(spark, sf) -> DataFrame:
    return view(spark, sf, "rep")


PLAIN = "replace(text, '**', '')"


def _match(text: str, pat: str, trim: bool = True) -> str:
    ext = f"regexp_extract({text}, {Q.q(pat)}, 1)"
    return f"CASE WHEN regexp_matches({text}, {Q.q(pat)}) THEN {'trim(' + ext + ')' if trim else ext} END"


# --- extraction ------------------------------------------------------------------

@register("src_report_fields", ("rep",), "SELECT path, " + ", ".join(
    f"{_match(PLAIN, p)} AS {k}" for k, p in R.FIELD_PATTERNS.items()) + " FROM rep")
def src_report_fields(spark, sf):
    return R.report_fields(reports(spark, sf))


@register("src_report_scores", ("rep",), "SELECT path, " + ", ".join(
    f"TRY_CAST({_match(PLAIN, p, False)} AS DOUBLE) AS {k}" for k, p in R.SCORE_PATTERNS.items())
    + " FROM rep")
def src_report_scores(spark, sf):
    return R.report_scores(reports(spark, sf))


@register("src_report_summary", ("rep",), """
SELECT path,
  trim(rtrim(trim(coalesce(CASE WHEN regexp_matches(text, '(?i)\\*\\*Arquetipo(?:\\s+detectado)?\\*\\*\\s*\\|\\s*(.+)') THEN regexp_extract(text, '(?i)\\*\\*Arquetipo(?:\\s+detectado)?\\*\\*\\s*\\|\\s*(.+)', 1) END,
                      CASE WHEN regexp_matches(text, '(?i)\\*\\*Arquetipo:\\*\\*\\s*(.+)') THEN regexp_extract(text, '(?i)\\*\\*Arquetipo:\\*\\*\\s*(.+)', 1) END)), '|')) AS archetype,
  trim(rtrim(trim(coalesce(CASE WHEN regexp_matches(text, '(?i)\\*\\*TL;DR\\*\\*\\s*\\|\\s*(.+)') THEN regexp_extract(text, '(?i)\\*\\*TL;DR\\*\\*\\s*\\|\\s*(.+)', 1) END,
                      CASE WHEN regexp_matches(text, '(?i)\\*\\*TL;DR:\\*\\*\\s*(.+)') THEN regexp_extract(text, '(?i)\\*\\*TL;DR:\\*\\*\\s*(.+)', 1) END)), '|')) AS tldr,
  trim(rtrim(trim(CASE WHEN regexp_matches(text, '(?i)\\*\\*Remote\\*\\*\\s*\\|\\s*(.+)') THEN regexp_extract(text, '(?i)\\*\\*Remote\\*\\*\\s*\\|\\s*(.+)', 1) END), '|')) AS remote,
  trim(rtrim(trim(CASE WHEN regexp_matches(text, '(?i)\\*\\*Comp\\*\\*\\s*\\|\\s*(.+)') THEN regexp_extract(text, '(?i)\\*\\*Comp\\*\\*\\s*\\|\\s*(.+)', 1) END), '|')) AS comp
FROM rep
""")
def src_report_summary(spark, sf):
    return R.report_summary(reports(spark, sf))


_GAPS_SQL = """
g0 AS (SELECT path, CASE WHEN regexp_matches(text, '(?i)\\|\\s*Gap\\s*\\|\\s*Severity\\s*\\|.*?\\n\\|[-|\\s]+\\n([\\s\\S]*?)(?:\\n\\n|\\n##|\\n\\*\\*|\\z)')
  THEN regexp_extract(text, '(?i)\\|\\s*Gap\\s*\\|\\s*Severity\\s*\\|.*?\\n\\|[-|\\s]+\\n([\\s\\S]*?)(?:\\n\\n|\\n##|\\n\\*\\*|\\z)', 1) END AS block FROM rep),
g1 AS (SELECT path, list_filter(string_split(coalesce(block, ''), chr(10)), lambda r: r LIKE '|%') AS rows FROM g0),
g2 AS (SELECT path, list_filter(list_transform(rows, lambda r: list_filter(list_transform(string_split(r, '|'), lambda x: trim(x)), lambda x: x <> '')),
                               lambda c: len(c) >= 2) AS gaps FROM g1),
gaps AS (SELECT path, CAST(i - 1 AS INTEGER) AS gap_idx, gaps[i][1] AS description, lower(gaps[i][2]) AS severity,
                coalesce(gaps[i][3], '') AS mitigation
         FROM g2, range(1, len(gaps) + 1) t(i))"""


@register("src_report_gaps", ("rep",), f"WITH {_GAPS_SQL} SELECT * FROM gaps")
def src_report_gaps(spark, sf):
    return R.report_gaps(reports(spark, sf))


@register("src_report_header", ("rep",), """
SELECT path,
  CASE WHEN regexp_matches(text, '(?m)^\\*\\*URL:\\*\\*\\s*(https?://\\S+)') THEN regexp_extract(text, '(?m)^\\*\\*URL:\\*\\*\\s*(https?://\\S+)', 1) END AS url,
  CASE WHEN regexp_matches(text, '(?m)^\\*\\*Batch ID:\\*\\*\\s*([0-9]+)') THEN regexp_extract(text, '(?m)^\\*\\*Batch ID:\\*\\*\\s*([0-9]+)', 1) END AS batch_id
FROM rep
""")
def src_report_header(spark, sf):
    return R.report_header(reports(spark, sf))


# --- classification rules ----------------------------------------------------------

def _remote_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), {Q.q(p)}) THEN {Q.q(label)}" for p, label in K.REMOTE_RULES)
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 'unknown' {whens} ELSE 'unknown' END)"


def _size_sql(x: str) -> str:
    toks = f"regexp_extract_all(lower({x}), '[0-9,]+')"
    mx = f"list_max(list_transform({toks}, lambda t: TRY_CAST(replace(t, ',', '') AS DOUBLE)))"
    nan = f"len(list_filter({toks}, lambda t: replace(t, ',', '') = '')) > 0"
    return (f"(CASE WHEN coalesce({x}, '') = '' THEN 'unknown' WHEN len({toks}) > 0 THEN "
            f"(CASE WHEN {nan} THEN 'enterprise' WHEN {mx} <= 50 THEN 'startup' WHEN {mx} <= 500 THEN 'scaleup' ELSE 'enterprise' END) "
            f"WHEN regexp_matches(lower({x}), '\\b(small|elite|tiny|founding)\\b') THEN 'startup' "
            f"WHEN regexp_matches(lower({x}), '\\b(large|enterprise|global)\\b') THEN 'enterprise' ELSE 'unknown' END)")


def _blocker_sql(d: str, s: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({d}), {Q.q(p)}) THEN {Q.q(label)}" for p, label in K.BLOCKER_RULES)
    return (f"(CASE WHEN strpos(lower({s}), 'nice') > 0 OR strpos(lower({s}), 'soft') > 0 THEN NULL {whens} "
            f"ELSE 'other' END)")


_FIELDS_SQL = "fields AS (SELECT path, " + ", ".join(
    f"{_match(PLAIN, p)} AS {k}" for k, p in R.FIELD_PATTERNS.items()) + " FROM rep)"

_ENRICHED_SQL = f"""{_FIELDS_SQL},
e AS (SELECT t.pos, t.num, t.date, {Q.outcome(ALIAS_STATUS)} AS outcome, {Q.score_js('t.score_raw')} AS score,
  nullif(regexp_extract(t.report, '\\]\\(([^)]+)\\)', 1), '') AS report_path,
  f.path IS NOT NULL AS has_report, coalesce(nullif(f.archetype, ''), 'Unknown') AS archetype,
  coalesce(nullif(f.remote, ''), nullif(t.notes, ''), '') AS remote_src, coalesce(f.team_size, '') AS team_src
  FROM trk t LEFT JOIN fields f ON f.path = nullif(regexp_extract(t.report, '\\]\\(([^)]+)\\)', 1), '')),
en AS (SELECT *, {_remote_sql('remote_src')} AS remote_bucket, {_size_sql('team_src')} AS company_size FROM e)"""


def enriched(spark, sf) -> DataFrame:
    """Tracker ⟕ parsed report on the link path; remote falls back to notes."""
    apps = script_apps(spark, sf).withColumn("report_path", T.report_path("report"))
    fields = R.report_fields(reports(spark, sf)).withColumnRenamed("path", "report_path")
    j = apps.join(fields, "report_path", "left")
    return j.select(
        "pos", "num", "date", "outcome", "score", "report_path", "notes",
        F.col("team_size").isNotNull().alias("_t"),
        F.coalesce(F.when(F.col("archetype") != "", F.col("archetype")), F.lit("Unknown")).alias("archetype"),
        F.coalesce(F.when(F.col("remote") != "", F.col("remote")), F.when(F.col("notes") != "", F.col("notes")),
                   F.lit("")).alias("remote_src"),
        F.coalesce(F.col("team_size"), F.lit("")).alias("team_src"),
    ).withColumn("remote_bucket", K.remote_bucket("remote_src")) \
        .withColumn("company_size", K.company_size("team_src")).drop("_t")


@register("cls_remote", ("trk", "rep"), f"WITH {_ENRICHED_SQL} SELECT pos, remote_src, remote_bucket FROM en")
def cls_remote(spark, sf):
    return enriched(spark, sf).select("pos", "remote_src", "remote_bucket")


@register("cls_company_size", ("trk", "rep"), f"WITH {_ENRICHED_SQL} SELECT pos, team_src, company_size FROM en")
def cls_company_size(spark, sf):
    return enriched(spark, sf).select("pos", "team_src", "company_size")


@register("join_report", ("trk", "rep"), f"""
WITH {_ENRICHED_SQL} SELECT pos, report_path, has_report, archetype, remote_src FROM en""")
def join_report(spark, sf):
    e = enriched(spark, sf)
    present = reports(spark, sf).select(F.col("path").alias("report_path"), F.lit(True).alias("has_report"))
    return e.join(present, "report_path", "left").select(
        "pos", "report_path", F.coalesce("has_report", F.lit(False)).alias("has_report"), "archetype", "remote_src")


@register("cls_blocker", ("rep",), f"WITH {_GAPS_SQL} SELECT path, gap_idx, {_blocker_sql('description', 'severity')} AS blocker FROM gaps")
def cls_blocker(spark, sf):
    g = R.report_gaps(reports(spark, sf))
    return g.select("path", "gap_idx", K.blocker("description", "severity").alias("blocker"))


# --- analysis aggregates ---------------------------------------------------------------

def _breakdown_sql(dim: str, label: str) -> str:
    return f"""
WITH {_ENRICHED_SQL}
SELECT '{dim}' AS dimension, {dim} AS value, count(*) AS total,
  count(*) FILTER (WHERE outcome = 'positive') AS positive, count(*) FILTER (WHERE outcome = 'negative') AS negative,
  count(*) FILTER (WHERE outcome = 'self_filtered') AS self_filtered, count(*) FILTER (WHERE outcome = 'pending') AS pending,
  CAST(floor((count(*) FILTER (WHERE outcome = 'positive'))::DOUBLE / count(*)::DOUBLE * 100 + 0.5) AS BIGINT) AS conversion_rate
FROM en GROUP BY {dim}"""


def breakdown(spark, sf, dim: str) -> DataFrame:
    return A.breakdown(enriched(spark, sf), [dim])


@register("agg_breakdown_archetype", ("trk", "rep"), _breakdown_sql("archetype", "archetype"))
def agg_breakdown_archetype(spark, sf):
    return breakdown(spark, sf, "archetype")


@register("agg_breakdown_remote", ("trk", "rep"), _breakdown_sql("remote_bucket", "policy"))
def agg_breakdown_remote(spark, sf):
    return breakdown(spark, sf, "remote_bucket")


@register("agg_breakdown_size", ("trk", "rep"), _breakdown_sql("company_size", "size"))
def agg_breakdown_size(spark, sf):
    return breakdown(spark, sf, "company_size")


def gap_rows(spark, sf) -> DataFrame:
    """Gaps of every tracker row that links a report, with the row's outcome."""
    e = script_apps(spark, sf).select("pos", "outcome", T.report_path("report").alias("path"))
    g = R.report_gaps(reports(spark, sf))
    return e.join(g, "path", "inner")


@register("agg_blockers", ("trk", "rep"), f"""
WITH {_ENRICHED_SQL}, {_GAPS_SQL},
b AS (SELECT {_blocker_sql('g.description', 'g.severity')} AS blocker FROM en JOIN gaps g ON g.path = en.report_path)
SELECT blocker, count(*) AS frequency,
  CAST(floor(count(*)::DOUBLE / (SELECT count(*) FROM trk)::DOUBLE * 100 + 0.5) AS BIGINT) AS percentage
FROM b WHERE blocker IS NOT NULL GROUP BY blocker
""")
def agg_blockers(spark, sf):
    return _blockers(spark, sf)


def _blockers(spark, sf) -> DataFrame:
    g = gap_rows(spark, sf).select(once(K.blocker("description", "severity")).alias("blocker")).where("blocker IS NOT NULL")
    counts = g.groupBy("blocker").agg(F.count(F.lit(1)).alias("frequency"))
    total = script_apps(spark, sf).agg(F.count(F.lit(1)).alias("_n"))
    return A.with_scalars(counts, total).select(
        "blocker", "frequency", T.js_round(F.col("frequency") / F.col("_n") * 100).cast("long").alias("percentage"))


_TECH_DUCK = "(?i)" + K.TECH_TERMS


@register("agg_tech_gaps", ("trk", "rep"), f"""
WITH {_ENRICHED_SQL}, {_GAPS_SQL},
t AS (SELECT unnest(regexp_extract_all(g.description, {Q.q(_TECH_DUCK)}, 1)) AS tech
      FROM en JOIN gaps g ON g.path = en.report_path WHERE en.outcome IN ('negative', 'self_filtered'))
SELECT upper(substr(tech, 1, 1)) || substr(tech, 2) AS skill, count(*) AS frequency
FROM t GROUP BY 1
""")
def agg_tech_gaps(spark, sf):
    return _tech_gaps(spark, sf)


def _tech_gaps(spark, sf) -> DataFrame:
    g = gap_rows(spark, sf).where(F.col("outcome").isin("negative", "self_filtered"))
    techs = g.select(F.explode(K.tech_mentions("description")).alias("skill"))
    counts = techs.groupBy("skill").agg(F.count(F.lit(1)).alias("frequency"))
    return counts
