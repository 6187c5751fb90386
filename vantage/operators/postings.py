"""Rich-posting rules: reason-coded filters, salary parsing, cross-keyword dedup, formatting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T

NEGOTIABLE = "面議"
MONTHLY_LIMIT = 200000
# Fixed values (remote and education code labels).
REMOTE_LABEL = {0: "", 1: "混合遠端", 2: "完全遠端"}
EDU_LABEL = {1: "高中", 2: "專科", 3: "大學", 4: "碩士", 5: "博士", 6: "不拘"}


@dataclass
class PostingFilter:
    allowed_locations: list[str] = field(default_factory=list)
    excluded_locations: list[str] = field(default_factory=list)
    exclude_companies: list[str] = field(default_factory=list)
    min_salary_annual: int = 0
    min_monthly_salary_max: int = 0
    accept_negotiable: bool = True
    max_age_days: int = 0
    include_remote: bool = True
    negotiable: str = NEGOTIABLE


def _norm_terms(terms):
    return [" ".join(t.split()).lower() for t in terms if " ".join(t.split())]


def salary_annual(salary: Column) -> Column:
    """flt_salary_annual: first ``\\d[\\d,]+`` as a number, monthly (< 200000) times 12."""
    m = F.regexp_extract(salary, r"([0-9][0-9,]+)", 1)
    v = F.when(m != "", F.regexp_replace(m, ",", "").try_cast("long"))
    return F.when(v < MONTHLY_LIMIT, v * 12).otherwise(v)


def salary_cap(salary: Column) -> Column:
    """flt_salary_cap: upper bound of ``lo~hi`` (or the single number)."""
    s = F.regexp_replace(salary, ",", "")
    lo = F.regexp_extract(s, r"([0-9]+)(?:~([0-9]+))?", 1)
    hi = F.regexp_extract(s, r"([0-9]+)(?:~([0-9]+))?", 2)
    return F.when(lo != "", F.coalesce(F.when(hi != "", hi), lo).try_cast("long"))


def reason(p: PostingFilter, as_of: str) -> Column:
    """flt_posting_reason: the first failing rule, else ``pass``."""
    loc = T.normalize_lower("location")
    co = T.normalize_lower("company")
    sal = F.col("salary")
    remote = F.col("remote_type") > 0
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    allowed = _norm_terms(p.allowed_locations)
    if allowed:
        bypass = remote if p.include_remote else F.lit(False)
        out = out.when(~bypass & ~T.any_contains(loc, allowed), "location")
    excluded = _norm_terms(p.excluded_locations)
    if excluded:
        out = out.when(T.any_contains(loc, excluded), "location_excluded")
    companies = _norm_terms(p.exclude_companies)
    if companies:
        out = out.when(T.any_contains(co, companies), "company_excluded")
    if p.min_salary_annual > 0:
        if not p.accept_negotiable:
            out = out.when(sal == p.negotiable, "salary")
            # The numeric test only runs when negotiable salaries are refused (kept as in the reference).
            out = out.when((sal != p.negotiable) & (salary_annual(sal) < p.min_salary_annual), "salary")
    if p.min_monthly_salary_max > 0:
        hi = salary_cap(sal)
        out = out.when(sal.isNotNull() & (sal != "") & (sal != p.negotiable) & (hi < MONTHLY_LIMIT)
                       & (hi < p.min_monthly_salary_max), "salary_max_too_low")
    if p.max_age_days > 0:
        cutoff = F.date_format(F.date_sub(F.lit(as_of).cast("date"), p.max_age_days), "yyyyMMdd")
        d = F.substring(F.regexp_replace(F.col("appear_date").cast("string"), "-", ""), 1, 8)
        out = out.when(F.col("appear_date").isNotNull() & (d != "") & (d < cutoff), "too_old")
    return out.otherwise("pass")


def posting_url(job_no: Column) -> Column:
    return F.concat(F.lit("https://www.104.com.tw/job/"), job_no)


def dedup_postings(posts: DataFrame, title_ok: Column, p: PostingFilter, as_of: str, seen_urls: DataFrame) -> DataFrame:
    """ddp_postings: outcome per posting in order (``pos``).

    A posting is a duplicate when an earlier *passing* posting has its id; a
    passing first-of-id posting is a duplicate when its url was seen or taken
    by an earlier accepted posting.
    """
    r = posts.withColumn("title_ok", title_ok).withColumn("reason", reason(p, as_of)) \
        .withColumn("url", posting_url(F.col("job_no")))
    passing = r.where(F.col("title_ok") & (F.col("reason") == "pass"))
    first_pass = passing.groupBy("job_no").agg(F.min("pos").alias("first_pass_pos"))
    r = r.join(first_pass, "job_no", "left")
    id_dup = F.col("first_pass_pos").isNotNull() & (F.col("first_pass_pos") < F.col("pos"))
    leaders = r.where(~id_dup & F.col("title_ok") & (F.col("reason") == "pass")).select("pos", "url")
    fresh = leaders.join(seen_urls, "url", "left_anti")
    accepted = fresh.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_acc"))
    r = r.join(accepted, "pos", "left")
    outcome = (F.when(id_dup, "duplicate").when(~F.col("title_ok"), "title")
               .when(F.col("reason") != "pass", F.col("reason"))
               .when(F.col("_acc"), "added").otherwise("duplicate"))
    return r.select("pos", "job_no", "url", outcome.alias("outcome"))


def posting_counters(outcomes: DataFrame) -> DataFrame:
    """agg_posting_counters: the scanner's printed counters (reason ``salary`` counts nowhere)."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(o == "title").alias("title_filtered"),
        F.count_if(o.isin("location", "location_excluded")).alias("location_filtered"),
        F.count_if(o == "company_excluded").alias("company_filtered"),
        F.count_if(o == "too_old").alias("age_filtered"),
        F.count_if(o == "salary_max_too_low").alias("salary_filtered"),
        F.count_if(o == "duplicate").alias("duplicates"),
        F.count_if(o == "added").alias("added"),
    )


def _thousands(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c.cast("long"), 0), r"\.0+$", "")


def format_salary(desc: Column, low: Column, high: Column, negotiable: str = NEGOTIABLE) -> Column:
    """txt_format_salary: description, else ``lo~hi``, else ``lo 以上``, else negotiable."""
    d = T.collapse_ws(F.coalesce(desc, F.lit("")))
    lo = F.coalesce(low, F.lit(0))
    hi = F.coalesce(high, F.lit(0))
    return (F.when(d != "", d)
            .when((lo != 0) & (hi != 0), F.concat(_thousands(lo), F.lit("~"), _thousands(hi)))
            .when(lo != 0, F.concat(_thousands(lo), F.lit(" 以上")))
            .otherwise(F.lit(negotiable)))


def format_size(count: Column) -> Column:
    """txt_format_size: head-count band."""
    c = count
    return (F.when(c.isNull() | (c == 0), F.lit(""))
            .when(c < 30, F.lit("<30人"))
            .when(c < 100, F.concat(c.cast("string"), F.lit("人")))
            .when(c < 500, F.concat((T.js_round(c / 100) * 100).cast("long").cast("string"), F.lit("人以上")))
            .otherwise(F.concat((T.js_round(c / 500) * 500).cast("long").cast("string"), F.lit("人以上"))))


def format_date8(c: Column) -> Column:
    """``YYYYMMDD`` -> ``YYYY-MM-DD``; other strings unchanged."""
    s = c.cast("string")
    return F.when(F.length(s) == 8, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))) \
        .otherwise(s)


def remote_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(S.map_lit(REMOTE_LABEL), code), F.lit(""))


def edu_labels(codes: Column) -> Column:
    m = S.map_lit(EDU_LABEL)
    return F.filter(F.transform(codes, lambda e: F.try_element_at(m, e)), lambda x: x.isNotNull())


def location_group_rank(group: Column, preferred: list[str]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, p in enumerate(preferred):
        out = out.when(group.startswith(p), F.lit(i))
    return out.otherwise(F.lit(99))
