"""Posting jobs (rich scanner): reason-coded filters, dedup, counters, formatting, grouped listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grouped_text as GT
from ..operators import postings as P
from ..operators import sinks as SK
from ..operators.filters import title_predicate
from ..operators.prefix import row_number_global
from ..sources.bindings import AS_OF_EVENTS, view
from .registry import register
from .scan_jobs import NEGATIVE, POSITIVE, SPLIT_TS

# Fixture filter parameters (a user's portal config would supply these).
FILTER = P.PostingFilter(
    allowed_locations=["North City", "East Town"],
    excluded_locations=["West"],
    exclude_companies=["Company 13"],
    min_salary_annual=500000,
    min_monthly_salary_max=50000,
    accept_negotiable=False,
    max_age_days=20,
    include_remote=True,
    negotiable="negotiable",
)
PREFERRED = ["North City", "East Town"]


def posts(spark, sf) -> DataFrame:
    return view(spark, sf, "post")


_REASON_SQL = f"""
CASE WHEN NOT (remote_type > 0) AND NOT (strpos(lower(location), 'north city') > 0 OR strpos(lower(location), 'east town') > 0) THEN 'location'
     WHEN strpos(lower(location), 'west') > 0 THEN 'location_excluded'
     WHEN strpos(lower(company), 'company 13') > 0 THEN 'company_excluded'
     WHEN salary = 'negotiable' THEN 'salary'
     WHEN salary <> 'negotiable' AND (CASE WHEN TRY_CAST(replace(regexp_extract(salary, '([0-9][0-9,]+)', 1), ',', '') AS BIGINT) < 200000
            THEN TRY_CAST(replace(regexp_extract(salary, '([0-9][0-9,]+)', 1), ',', '') AS BIGINT) * 12
            ELSE TRY_CAST(replace(regexp_extract(salary, '([0-9][0-9,]+)', 1), ',', '') AS BIGINT) END) < 500000 THEN 'salary'
     WHEN salary <> '' AND salary <> 'negotiable'
          AND TRY_CAST(coalesce(nullif(regexp_extract(replace(salary, ',', ''), '([0-9]+)(?:~([0-9]+))?', 2), ''),
                                nullif(regexp_extract(replace(salary, ',', ''), '([0-9]+)(?:~([0-9]+))?', 1), '')) AS BIGINT) < 200000
          AND TRY_CAST(coalesce(nullif(regexp_extract(replace(salary, ',', ''), '([0-9]+)(?:~([0-9]+))?', 2), ''),
                                nullif(regexp_extract(replace(salary, ',', ''), '([0-9]+)(?:~([0-9]+))?', 1), '')) AS BIGINT) < 50000
          THEN 'salary_max_too_low'
     WHEN appear_date IS NOT NULL AND strftime(appear_date, '%Y%m%d') < strftime(DATE '{AS_OF_EVENTS}' - INTERVAL 20 DAY, '%Y%m%d') THEN 'too_old'
     ELSE 'pass' END"""

_TITLE_SQL = ("((strpos(lower(title), 'engineer') > 0 OR strpos(lower(title), 'developer') > 0) "
              "AND NOT (strpos(lower(title), 'junior') > 0 OR strpos(lower(title), 'error') > 0))")

_DEDUP_SQL = f"""
r AS (SELECT pos, job_no, 'https://www.104.com.tw/job/' || job_no AS url, {_TITLE_SQL} AS title_ok, {_REASON_SQL} AS reason FROM post),
fp AS (SELECT job_no, min(pos) AS first_pass_pos FROM r WHERE title_ok AND reason = 'pass' GROUP BY job_no),
r2 AS (SELECT r.*, fp.first_pass_pos IS NOT NULL AND fp.first_pass_pos < r.pos AS id_dup FROM r LEFT JOIN fp USING (job_no)),
seen AS (SELECT url FROM off WHERE ts < TIMESTAMP '{SPLIT_TS}'),
acc AS (SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM r2
        WHERE NOT id_dup AND title_ok AND reason = 'pass' AND url NOT IN (SELECT url FROM seen)) WHERE rn = 1),
oc AS (SELECT r2.pos, r2.job_no, r2.url, CASE WHEN id_dup THEN 'duplicate' WHEN NOT title_ok THEN 'title'
  WHEN reason <> 'pass' THEN reason WHEN acc.pos IS NOT NULL THEN 'added' ELSE 'duplicate' END AS outcome
  FROM r2 LEFT JOIN acc ON acc.pos = r2.pos)"""


def outcomes(spark, sf) -> DataFrame:
    seen = view(spark, sf, "off").where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp")).select("url")
    return P.dedup_postings(posts(spark, sf), title_predicate(F.col("title"), POSITIVE, NEGATIVE), FILTER,
                            AS_OF_EVENTS, seen)


@register("flt_posting_reason", ("post",), f"SELECT pos, {_REASON_SQL} AS reason FROM post")
def flt_posting_reason(spark, sf):
    return posts(spark, sf).select("pos", P.reason(FILTER, AS_OF_EVENTS).alias("reason"))


@register("flt_salary_annual", ("post",), """
SELECT pos, CASE WHEN TRY_CAST(replace(regexp_extract(salary, '([0-9][0-9,]+)', 1), ',', '') AS BIGINT) < 200000
  THEN TRY_CAST(replace(regexp_extract(salary, '([0-9][0-9,]+)', 1), ',', '') AS BIGINT) * 12
  ELSE TRY_CAST(replace(regexp_extract(salary, '([0-9][0-9,]+)', 1), ',', '') AS BIGINT) END AS annual FROM post""")
def flt_salary_annual(spark, sf):
    return posts(spark, sf).select("pos", P.salary_annual(F.col("salary")).alias("annual"))


@register("flt_salary_cap", ("post",), """
SELECT pos, TRY_CAST(coalesce(nullif(regexp_extract(replace(salary, ',', ''), '([0-9]+)(?:~([0-9]+))?', 2), ''),
  nullif(regexp_extract(replace(salary, ',', ''), '([0-9]+)(?:~([0-9]+))?', 1), '')) AS BIGINT) AS salary_max FROM post""")
def flt_salary_cap(spark, sf):
    return posts(spark, sf).select("pos", P.salary_cap(F.col("salary")).alias("salary_max"))


@register("flt_age", ("post",), f"""
SELECT pos FROM post WHERE NOT (appear_date IS NOT NULL AND strftime(appear_date, '%Y%m%d') < strftime(DATE '{AS_OF_EVENTS}' - INTERVAL 20 DAY, '%Y%m%d'))""")
def flt_age(spark, sf):
    age_only = P.PostingFilter(max_age_days=FILTER.max_age_days)
    return posts(spark, sf).where(P.reason(age_only, AS_OF_EVENTS) != "too_old").select("pos")


@register("ddp_postings", ("post", "off"), f"WITH {_DEDUP_SQL} SELECT pos, job_no, url, outcome FROM oc")
def ddp_postings(spark, sf):
    return outcomes(spark, sf)


@register("agg_posting_counters", ("post", "off"), f"""WITH {_DEDUP_SQL}
SELECT count(*) AS found, count(*) FILTER (WHERE outcome = 'title') AS title_filtered,
  count(*) FILTER (WHERE outcome IN ('location', 'location_excluded')) AS location_filtered,
  count(*) FILTER (WHERE outcome = 'company_excluded') AS company_filtered,
  count(*) FILTER (WHERE outcome = 'too_old') AS age_filtered,
  count(*) FILTER (WHERE outcome = 'salary_max_too_low') AS salary_filtered,
  count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'added') AS added FROM oc""")
def agg_posting_counters(spark, sf):
    return P.posting_counters(outcomes(spark, sf))


@register("txt_format_size", ("post",), """
SELECT pos, CASE WHEN employee_count IS NULL OR employee_count = 0 THEN '' WHEN employee_count < 30 THEN '<30人'
  WHEN employee_count < 100 THEN CAST(employee_count AS VARCHAR) || '人'
  WHEN employee_count < 500 THEN CAST(CAST(floor(employee_count / 100.0 + 0.5) * 100 AS BIGINT) AS VARCHAR) || '人以上'
  ELSE CAST(CAST(floor(employee_count / 500.0 + 0.5) * 500 AS BIGINT) AS VARCHAR) || '人以上' END AS size FROM post""")
def txt_format_size(spark, sf):
    return posts(spark, sf).select("pos", P.format_size(F.col("employee_count")).alias("size"))


@register("txt_format_salary", ("post",), """
WITH s AS (SELECT pos, CASE WHEN salary = 'negotiable' THEN '' ELSE salary END AS descr,
  TRY_CAST(regexp_extract(salary, '^([0-9]+)~', 1) AS BIGINT) AS lo, TRY_CAST(regexp_extract(salary, '~([0-9]+)$', 1) AS BIGINT) AS hi FROM post)
SELECT pos, CASE WHEN pos % 2 = 0 AND descr <> '' THEN descr
  WHEN coalesce(lo, 0) <> 0 AND coalesce(hi, 0) <> 0 THEN format('{:,}', lo) || '~' || format('{:,}', hi)
  WHEN coalesce(lo, 0) <> 0 THEN format('{:,}', lo) || ' 以上' ELSE '面議' END AS salary_text FROM s""")
def txt_format_salary(spark, sf):
    p = posts(spark, sf)
    descr = F.when((F.col("pos") % 2 == 0) & (F.col("salary") != "negotiable"), F.col("salary"))
    lo = F.regexp_extract("salary", r"^([0-9]+)~", 1).try_cast("long")
    hi = F.regexp_extract("salary", r"~([0-9]+)$", 1).try_cast("long")
    return p.select("pos", P.format_salary(descr, lo, hi).alias("salary_text"))


@register("txt_code_labels", ("post",), """
SELECT pos, CASE remote_type WHEN 1 THEN '混合遠端' WHEN 2 THEN '完全遠端' ELSE '' END AS remote_label,
  CASE WHEN length(strftime(appear_date, '%Y%m%d')) = 8 THEN strftime(appear_date, '%Y-%m-%d') END AS appear_iso FROM post""")
def txt_code_labels(spark, sf):
    p = posts(spark, sf)
    return p.select("pos", P.remote_label(F.col("remote_type")).alias("remote_label"),
                    P.format_date8(F.date_format("appear_date", "yyyyMMdd")).alias("appear_iso"))


@register("srt_location_groups", ("post",), """
SELECT pos, location, row_number() OVER (ORDER BY CASE WHEN starts_with(location, 'North City') THEN 0
  WHEN starts_with(location, 'East Town') THEN 1 ELSE 99 END, location, strftime(appear_date, '%Y-%m-%d') DESC, pos) AS rank FROM post""")
def srt_location_groups(spark, sf):
    p = posts(spark, sf).withColumn("_g", P.location_group_rank(F.col("location"), PREFERRED)) \
        .withColumn("_d", F.date_format("appear_date", "yyyy-MM-dd"))
    out = row_number_global(p, [F.col("_g"), F.col("location"), F.col("_d").desc(), F.col("pos")], "rank")
    return out.select("pos", "location", F.col("rank").cast("long"))


_HISTORY_HEAD = ["| 刊登日 | 公司 | 職務 | 薪水 | 遠端 | 連結 |", "|--------|------|------|------|------|------|"]


@register("snk_history_report", ("post", "off"), f"""WITH {_DEDUP_SQL},
hr AS (SELECT coalesce(nullif(p.location, ''), '其他') AS grp, strftime(appear_date, '%Y-%m-%d') AS d, pos,
  '| ' || strftime(appear_date, '%m/%d') || ' | ' || company || ' | ' || title || ' | ' || salary || ' | '
  || CASE remote_type WHEN 1 THEN '混合遠端' WHEN 2 THEN '完全遠端' ELSE '' END || ' | [104](https://www.104.com.tw/job/' || p.job_no || ') |' AS line
  FROM oc JOIN post p USING (pos) WHERE outcome = 'added'),
g AS (SELECT grp, count(*) AS n FROM hr GROUP BY grp),
o AS (SELECT grp, CASE WHEN starts_with(grp, 'North City') THEN 0 WHEN starts_with(grp, 'East Town') THEN 1 ELSE 99 END AS rank FROM g),
l AS (SELECT 0 AS s, 0 AS rank, '' AS grp, 0 AS part, '' AS d, 0 AS pos, unnest([1, 2, 3]) AS i,
    unnest(['# Scan History — {AS_OF_EVENTS}', '', '共 ' || (SELECT count(*) FROM hr) || ' 筆']) AS line
  UNION ALL SELECT 1, rank, grp, 0, '', 0, unnest([1, 2, 3, 4, 5]), unnest(['', '## ' || grp || '（' || n || ' 筆）', '', {", ".join(f"'{h}'" for h in _HISTORY_HEAD)}])
    FROM g JOIN o USING (grp)
  UNION ALL SELECT 1, rank, grp, 1, d, pos, 0, line FROM hr JOIN o USING (grp))
SELECT row_number() OVER (ORDER BY s, rank, grp, part, d DESC, pos, i) AS line_no, line FROM l""")
def snk_history_report(spark, sf):
    """The history listing by location with counts and total, written as a text and read back."""
    added = outcomes(spark, sf).where(F.col("outcome") == "added").select("pos")
    p = posts(spark, sf).join(added, "pos")
    cells = [F.date_format("appear_date", "MM/dd"), F.col("company"), F.col("title"), F.col("salary"), P.remote_label(F.col("remote_type")),
             F.concat(F.lit("[104](https://www.104.com.tw/job/"), "job_no", F.lit(")"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    rows = p.select(F.col("location").alias("group"), F.date_format("appear_date", "yyyy-MM-dd").alias("date"), F.col("pos").alias("tie"), line.alias("line"))
    n = F.col("n").cast("string")
    heading = F.array(F.lit(""), F.concat(F.lit("## "), "grp", F.lit("（"), n, F.lit(" 筆）")), F.lit(""), *map(F.lit, _HISTORY_HEAD))
    title = F.array(F.lit(f"# Scan History — {AS_OF_EVENTS}"), F.lit(""), F.concat(F.lit("共 "), n, F.lit(" 筆")))
    path = SK.scratch_dir(spark, "history-report")
    GT.write_document(GT.grouped_document(rows, heading, title, PREFERRED), path)
    return GT.read_document(spark, path)
