"""Scan jobs over offers (events): seen sets, title filter, dedup, dispositions, repost windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import scan as SC
from ..operators.filters import title_predicate
from ..sources import tracker as TR
from ..sources.bindings import AS_OF_EVENTS, view
from . import sqlrules as Q
from .registry import register

SPLIT_TS = "2024-01-11 00:00:00"
# Fixture title filter (a user parameter; the shipped example lists other roles).
POSITIVE = ["Engineer", "Developer"]
NEGATIVE = ["Junior", "error"]


def offers(spark, sf) -> DataFrame:
    return view(spark, sf, "off")


def new_offers(spark, sf) -> DataFrame:
    return offers(spark, sf).where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp"))


def history(spark, sf) -> DataFrame:
    return offers(spark, sf).where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp")).select("url")


def tracker_lines(spark, sf) -> DataFrame:
    return TR.render_tracker(view(spark, sf, "trk"))


def seen_urls(spark, sf) -> DataFrame:
    return SC.seen_urls(history(spark, sf), view(spark, sf, "inbox_old"), tracker_lines(spark, sf))


def seen_keys(spark, sf) -> DataFrame:
    return SC.seen_role_keys(tracker_lines(spark, sf))


def dispositions(spark, sf) -> DataFrame:
    return SC.dispositions(new_offers(spark, sf), POSITIVE, NEGATIVE, seen_urls(spark, sf), seen_keys(spark, sf))


def _norm(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _title_sql(t):
    lt = f"lower({t})"
    pos = " OR ".join(f"strpos({lt}, {Q.q(p.lower())}) > 0" for p in POSITIVE)
    neg = " OR ".join(f"strpos({lt}, {Q.q(n.lower())}) > 0" for n in NEGATIVE)
    return f"(({pos}) AND NOT ({neg}))"


_SEEN_SQL = f"""
hist AS (SELECT url FROM off WHERE ts < TIMESTAMP '{SPLIT_TS}'),
seen_u AS (SELECT url FROM hist WHERE url <> ''
  UNION SELECT unnest(regexp_extract_all(line, '- \\[[ x!]\\] (https?://[^ \\t\\n\\f\\r]+)', 1)) FROM inbox_old
  UNION SELECT unnest(regexp_extract_all(concat_ws(' | ', CAST(num AS VARCHAR), date, company, role, score_raw, status_raw, report, notes), 'https?://[^\\s|)]+')) FROM trk),
seen_k AS (SELECT DISTINCT lower({_norm('company')}) || '::' || lower({_norm('role')}) AS role_key FROM trk
           WHERE {_norm('company')} <> '' AND {_norm('role')} <> ''),
nw AS (SELECT pos, {_norm('url')} AS url, {_norm('company')} AS company, {_norm('title')} AS title,
  lower({_norm('company')}) || '::' || lower({_norm('title')}) AS role_key FROM off WHERE ts >= TIMESTAMP '{SPLIT_TS}'),
flag AS (SELECT *, url <> '' AND company <> '' AND title <> '' AS is_valid, {_title_sql('title')} AS title_ok FROM nw),
cand AS (SELECT pos, url, role_key FROM flag WHERE is_valid AND title_ok
  AND url NOT IN (SELECT url FROM seen_u) AND role_key NOT IN (SELECT role_key FROM seen_k)),
st(it, pos, url, k, s, more) AS (
  SELECT 0, pos, url, role_key, 'U', TRUE FROM cand
  UNION ALL
  SELECT it + 1, pos, url, k,
    CASE WHEN s <> 'U' THEN s
         WHEN it % 2 = 0 THEN (CASE WHEN pos = min(CASE WHEN s = 'U' THEN pos END) OVER (PARTITION BY url)
                                     AND pos = min(CASE WHEN s = 'U' THEN pos END) OVER (PARTITION BY k) THEN 'A' ELSE 'U' END)
         ELSE (CASE WHEN max(CASE WHEN s = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY url) = 1
                      OR max(CASE WHEN s = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY k) = 1 THEN 'R' ELSE 'U' END) END,
    max(CASE WHEN s = 'U' THEN 1 ELSE 0 END) OVER () = 1
  FROM st WHERE more),
accepted AS (SELECT pos FROM st WHERE NOT more AND s = 'A'),
disp AS (SELECT f.pos, f.url, f.company, f.title, f.role_key,
  CASE WHEN NOT f.is_valid THEN 'invalid' WHEN NOT f.title_ok THEN 'skipped_title'
       WHEN a.pos IS NOT NULL THEN 'added' ELSE 'skipped_dup' END AS disposition
  FROM flag f LEFT JOIN accepted a ON a.pos = f.pos)"""


def _with_seen(body: str) -> str:
    return "WITH RECURSIVE " + _SEEN_SQL.strip() + "\n" + body


@register("set_seen_union", ("off", "inbox", "trk"), r"""
SELECT url FROM off WHERE url <> ''
UNION SELECT unnest(regexp_extract_all(line, '- \[[ x!]\] (https?://[^ \t\n\f\r]+)', 1)) FROM inbox
UNION SELECT unnest(regexp_extract_all(concat_ws(' | ', CAST(num AS VARCHAR), date, company, role, score_raw, status_raw, report, notes), 'https?://[^\s|)]+')) FROM trk""")
def set_seen_union(spark, sf):
    """All offers as history, the whole inbox and the tracker."""
    return SC.seen_urls(offers(spark, sf).select("url"), view(spark, sf, "inbox"), tracker_lines(spark, sf))


@register("join_seen_url", ("off", "inbox_old", "trk"), _with_seen(
    "SELECT pos, url FROM nw WHERE url NOT IN (SELECT url FROM seen_u)"))
def join_seen_url(spark, sf):
    o = SC.normalized(new_offers(spark, sf))
    return o.join(seen_urls(spark, sf), "url", "left_anti").select("pos", "url")


@register("join_seen_company_role", ("off", "inbox_old", "trk"), _with_seen(
    f"""SELECT pos, role_key FROM (SELECT pos, lower({_norm('company')}) || '::' || lower({_norm('title')}) AS role_key FROM off)
WHERE role_key NOT IN (SELECT role_key FROM seen_k)"""))
def join_seen_company_role(spark, sf):
    o = SC.normalized(offers(spark, sf))
    return o.join(seen_keys(spark, sf), "role_key", "left_anti").select("pos", "role_key")


@register("flt_title", ("off",), f"""
SELECT pos, {_norm('title')} AS title, {_title_sql(_norm('title'))} AS keep FROM off""")
def flt_title(spark, sf):
    o = SC.normalized(offers(spark, sf))
    return o.select("pos", "title", title_predicate(F.col("title"), POSITIVE, NEGATIVE).alias("keep"))


@register("ddp_offers_two_key", ("off", "inbox_old", "trk"), _with_seen("SELECT pos, url, role_key FROM disp WHERE disposition = 'added'"))
def ddp_offers_two_key(spark, sf):
    return dispositions(spark, sf).where(F.col("disposition") == "added").select("pos", "url", "role_key")


@register("flt_disposition", ("off", "inbox_old", "trk", "chk"), _with_seen("""
SELECT d.pos, CASE WHEN d.disposition <> 'added' THEN d.disposition WHEN c.result = 'expired' THEN 'skipped_expired'
  WHEN c.result = 'failed' THEN 'failed' ELSE 'added' END AS disposition
FROM disp d JOIN off o USING (pos)
ASOF LEFT JOIN (SELECT url, checked_at, arg_max(result, check_id) AS result FROM chk GROUP BY url, checked_at) c
  ON c.url = d.url AND c.checked_at <= o.ts"""))
def flt_disposition(spark, sf):
    return SC.dispositions(new_offers(spark, sf), POSITIVE, NEGATIVE, seen_urls(spark, sf), seen_keys(spark, sf),
                           view(spark, sf, "chk")).select("pos", "disposition")


@register("agg_scan_counters", ("off", "inbox_old", "trk"), _with_seen("""
SELECT (SELECT count(*) FROM nw) AS found,
  count(*) FILTER (WHERE disposition = 'skipped_title') AS filtered,
  count(*) FILTER (WHERE disposition = 'skipped_dup') AS duplicates,
  count(*) FILTER (WHERE disposition = 'added') AS added FROM disp"""))
def agg_scan_counters(spark, sf):
    d = F.col("disposition")
    return dispositions(spark, sf).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(d == "skipped_title").alias("filtered"),
        F.count_if(d == "skipped_dup").alias("duplicates"), F.count_if(d == "added").alias("added"))


@register("ddp_first_by_key", ("off",), """
SELECT pos, url FROM (SELECT pos, url, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM off WHERE url <> '')
WHERE rn = 1""")
def ddp_first_by_key(spark, sf):
    return SC.first_by_key(offers(spark, sf), "url").select("pos", "url")


@register("win_repost", ("off",), """
WITH d AS (SELECT company, title, CAST(seen_date AS DATE) AS day, count(*) AS n FROM off GROUP BY ALL),
w AS (SELECT company, title, day, coalesce(sum(n) OVER (PARTITION BY company, title ORDER BY day
      RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS reposts FROM d)
SELECT o.pos, CAST(w.reposts AS BIGINT) AS reposts FROM off o JOIN w ON w.company = o.company AND w.title = o.title AND w.day = o.seen_date
""")
def win_repost(spark, sf):
    return SC.repost_counts(offers(spark, sf)).select("pos", "reposts")


@register("win_cap_per_source", ("off",), """
SELECT pos, source FROM (SELECT pos, source, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM off) WHERE rn <= 20
""")
def win_cap_per_source(spark, sf):
    return SC.cap_per_group(offers(spark, sf), ["source"], "pos", 20).select("pos", "source")


@register("cls_provider", ("off",), """
SELECT pos, CASE WHEN strpos(lower(source), '104.com.tw') > 0 THEN '104' WHEN strpos(lower(source), 'cakeresume.com') > 0 THEN 'cakeresume'
  WHEN strpos(lower(source), 'yourator.co') > 0 THEN 'yourator' WHEN strpos(lower(source), 'meet.jobs') > 0 THEN 'meetjobs'
  WHEN strpos(lower(source), 'linkedin.com') > 0 THEN 'linkedin' ELSE 'unsupported' END AS provider FROM off
""")
def cls_provider(spark, sf):
    return offers(spark, sf).select("pos", SC.provider("source").alias("provider"))


@register("cls_posting_age", ("off",), f"""
SELECT pos, date_diff('day', seen_date, DATE '{AS_OF_EVENTS}') AS age_days,
  CASE WHEN date_diff('day', seen_date, DATE '{AS_OF_EVENTS}') < 30 THEN 'fresh'
       WHEN date_diff('day', seen_date, DATE '{AS_OF_EVENTS}') <= 60 THEN 'mixed' ELSE 'stale' END AS age FROM off
""")
def cls_posting_age(spark, sf):
    days = F.datediff(F.lit(AS_OF_EVENTS).cast("date"), F.col("seen_date"))
    return offers(spark, sf).select("pos", days.alias("age_days"), D.age_bucket(days).alias("age"))


@register("cls_seniority_boost", ("off",), """
SELECT pos, strpos(lower(title), 'senior') > 0 OR strpos(lower(title), 'staff') > 0 OR strpos(lower(title), 'principal') > 0
  OR strpos(lower(title), 'lead') > 0 OR strpos(lower(title), 'head') > 0 OR strpos(lower(title), '資深') > 0 AS boost FROM off
""")
def cls_seniority_boost(spark, sf):
    return offers(spark, sf).select("pos", SC.seniority_boost("title").alias("boost"))


@register("dat_cache_split", ("off",), f"""
SELECT pos, CASE WHEN date_diff('day', seen_date, DATE '{AS_OF_EVENTS}') <= 30 THEN 'fresh' ELSE 'stale' END AS cache FROM off
""")
def dat_cache_split(spark, sf):
    return offers(spark, sf).select("pos", D.cache_state("seen_date", AS_OF_EVENTS, 30).alias("cache"))


@register("txt_normalize", ("off",), f"SELECT pos, {_norm('title')} AS title_norm, lower({_norm('title')}) AS title_key FROM off")
def txt_normalize(spark, sf):
    return offers(spark, sf).select("pos", T.collapse_ws("title").alias("title_norm"),
                                    T.normalize_lower("title").alias("title_key"))
