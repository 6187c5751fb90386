"""Scan flow over offers: validity, title filter, seen sets, two-key dedup, dispositions.

Seen sets are DataFrames (url column / key column) and are applied with
``left_anti`` joins, so they may be any size; AQE broadcasts them only when
their runtime size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_table
from . import greedy as G
from .asof import latest_before
from .filters import title_predicate

INBOX_URL_RE = r"- \[[ x!]\] (https?://[^ \t\n\f\r]+)"
TRACKER_URL_RE = r"https?://[^\s|)]+"


def normalized(offers: DataFrame) -> DataFrame:
    """Whitespace-normalised title / company / url and the company::title key."""
    return (offers.withColumn("title", T.collapse_ws("title"))
            .withColumn("company", T.collapse_ws("company"))
            .withColumn("url", T.collapse_ws("url"))
            .withColumn("role_key", F.concat(F.lower("company"), F.lit("::"), F.lower("title"))))


def valid(offers: DataFrame) -> Column:
    return (F.col("title") != "") & (F.col("company") != "") & (F.col("url") != "")


def seen_urls(history: DataFrame, inbox_lines: DataFrame, tracker_lines: DataFrame) -> DataFrame:
    """set_seen_union: history urls ∪ inbox checklist urls ∪ urls in tracker text."""
    h = history.select(F.split(F.col("line"), "\t", 2).getItem(0).alias("url")) if "line" in history.columns \
        else history.select("url")
    i = inbox_lines.select(F.explode(F.regexp_extract_all("line", F.lit(INBOX_URL_RE), 1)).alias("url"))
    t = tracker_lines.select(F.explode(F.regexp_extract_all("line", F.lit(TRACKER_URL_RE), 0)).alias("url"))
    return h.unionByName(i).unionByName(t).where(F.col("url") != "").distinct()


def seen_role_keys(tracker_lines: DataFrame) -> DataFrame:
    """company::role keys from tracker pipe rows (header rows skipped)."""
    cells = F.transform(F.split(F.col("line"), r"\|", -1), T.js_trim)
    ok = (F.col("line").startswith("|") & (F.size(cells) >= 5) & (F.get(cells, 1) != "#")
          & (F.get(cells, 3) != "Company"))
    k = tracker_lines.where(ok).select(T.normalize_lower(F.get(cells, 3)).alias("c"),
                                       T.normalize_lower(F.get(cells, 4)).alias("r"))
    return k.where((F.col("c") != "") & (F.col("r") != "")).select(
        F.concat("c", F.lit("::"), "r").alias("role_key")).distinct()


def dispositions(offers: DataFrame, positive: list[str], negative: list[str],
                 urls: DataFrame, keys: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """flt_disposition: invalid / skipped_title / skipped_dup / skipped_expired / failed / added per offer.

    Offers stand in the order of ``pos``; the first label that applies is taken.  With ``checks`` (url,
    checked_at, check_id, result) an offer that passes all filters is judged by the latest liveness check
    of its url not after its ``ts``: expired, failed to load, or else added, as without any check.
    """
    o = cut_table(normalized(offers).withColumn("_valid", valid(offers))
                    .withColumn("_title_ok", title_predicate(F.col("title"), positive, negative)))
    cand = o.where(F.col("_valid") & F.col("_title_ok"))
    fresh = cand.join(urls, "url", "left_anti").join(keys, "role_key", "left_anti")
    acc = G.two_key_accept(fresh.select("pos", "url", "role_key"), "pos", "url", "role_key")
    flags = acc.where("accepted").select("pos", F.lit("added").alias("_passed"))
    if checks is not None:
        passed = cut_table(flags.select("pos").join(o.select("pos", "url", "ts"), "pos"))
        known = checks.withColumn("url", T.collapse_ws("url")).join(passed.select("url").distinct(), "url", "left_semi")
        result = latest_before(passed, known, "url", "ts", "pos", "checked_at", "check_id", "result")
        flags = result.select("pos", F.when(F.col("result") == "expired", "skipped_expired").when(F.col("result") == "failed", "failed")
                              .otherwise("added").alias("_passed"))
    out = o.join(flags, "pos", "left")
    disp = F.when(~F.col("_valid"), "invalid").when(~F.col("_title_ok"), "skipped_title").otherwise(F.coalesce("_passed", F.lit("skipped_dup")))
    return out.select("pos", "url", "company", "title", "role_key", disp.alias("disposition"))


def first_by_key(df: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """ddp_first_by_key: first row per non-empty key in order.

    The first position per key is a map-side-combined ``min``; rows are kept by a
    semi join on (key, position), so a hot key never lands in one window task.
    """
    keyed = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    firsts = keyed.groupBy(key).agg(F.min(order).alias(order))
    return keyed.join(firsts, [key, order], "left_semi")


def repost_counts(offers: DataFrame, day_col: str = "seen_date", days: int = 90) -> DataFrame:
    """win_repost: earlier appearances of the same company + title within ``days`` days.

    Appearances are first counted per (company, title, day) - a map-side
    combined aggregate - and the range window runs over those daily counts, so
    a hot company+title costs one row per day, not one per appearance.
    """
    keyed = offers.withColumn("_day", F.unix_date(F.col(day_col)))
    daily = keyed.groupBy("company", "title", "_day").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("company", "title").orderBy("_day").rangeBetween(-days, -1)
    daily = daily.withColumn("reposts", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long")).drop("_n")
    return keyed.join(daily, ["company", "title", "_day"]).drop("_day")


def cap_per_group(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """win_cap_per_source: at most ``n`` rows per group in order (the cap is the feature)."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def provider(c) -> Column:
    """cls_provider: query / url text -> job board provider."""
    q = F.lower(T.col(c))
    return (F.when(q.contains("104.com.tw"), "104").when(q.contains("cakeresume.com"), "cakeresume")
            .when(q.contains("yourator.co"), "yourator").when(q.contains("meet.jobs"), "meetjobs")
            .when(q.contains("linkedin.com"), "linkedin").otherwise("unsupported"))


def ats_endpoint(api: Column, careers_url: Column) -> Column:
    """cls_ats_endpoint: (type, slug, api url) from a declared greenhouse api or the careers url."""
    u = F.coalesce(careers_url, F.lit(""))
    ashby = F.regexp_extract(u, r"jobs\.ashbyhq\.com/([^/?#]+)", 1)
    lever = F.regexp_extract(u, r"jobs\.lever\.co/([^/?#]+)", 1)
    gh = F.regexp_extract(u, r"job-boards(?:\.eu)?\.greenhouse\.io/([^/?#]+)", 1)
    declared = api.isNotNull() & api.contains("greenhouse")
    typ = (F.when(declared, "greenhouse").when(ashby != "", "ashby").when(lever != "", "lever")
           .when(gh != "", "greenhouse"))
    slug = F.when(declared, F.lit(None)).when(ashby != "", ashby).when(lever != "", lever).when(gh != "", gh)
    url = (F.when(declared, api)
           .when(ashby != "", F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), ashby,
                                       F.lit("?includeCompensation=true")))
           .when(lever != "", F.concat(F.lit("https://api.lever.co/v0/postings/"), lever))
           .when(gh != "", F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), gh, F.lit("/jobs"))))
    return F.struct(typ.alias("type"), slug.alias("slug"), url.alias("api_url"))


# Fixed values (seniority prefixes that raise relevance, not required).
SENIORITY_BOOST = ["資深", "Senior", "Staff", "Principal", "Lead", "Head"]


def seniority_boost(title) -> Column:
    t = T.normalize_lower(title)
    return T.any_contains(t, [s.lower() for s in SENIORITY_BOOST])
