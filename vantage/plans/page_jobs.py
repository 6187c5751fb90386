"""Page jobs: anchors, entity / tag handling, url resolution, liveness, ATS text, embedded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import classify as K
from ..functions import html as H
from ..functions import text as T
from ..sources.bindings import VIEWS, _view, view
from . import sqlrules as Q
from .registry import register

HREF_PATTERN = "^/"  # which hrefs count as job links (a scanner parameter)

# Stored crawl rows: status, final url, html, derived from pages with a few closed / listing / short cases.
_view("crawl", ("pages",), """
SELECT page_id,
  CASE WHEN page_id % 23 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 410 ELSE 200 END AS status,
  CASE WHEN page_id % 31 = 0 THEN url || '?error=true' ELSE url END AS final_url,
  CASE WHEN page_id % 11 = 0 THEN '<html><body><p>Short page</p></body></html>'
       ELSE html || CASE CAST(page_id % 7 AS INTEGER) WHEN 1 THEN '<p>This job has expired.</p>'
                                     WHEN 2 THEN '<p>124 jobs found</p>'
                                     WHEN 3 THEN '<p><a href="/apply">Apply now</a></p>'
                                     WHEN 4 THEN '<p>Applications are closed</p>' ELSE '' END END AS html
FROM pages
""")

# Pages carrying an embedded ``window.__data`` state blob (company index + experiences).
_view("pstate", ("pages",), """
SELECT page_id, concat('Company ', CAST(page_id % 40 AS STRING)) AS company,
  concat(html, '<script>window.__data = ',
    CASE WHEN page_id % 13 = 0 THEN '{"broken": '
    ELSE concat('{"companyIndex":{"overviewStatisticsByName":{"Company ', CAST(page_id % 40 AS STRING), '":{"data":{"jobAverageSalaries":[',
      '{"job_title":{"name":"Engineer"},"average_salary":{"type":"month","amount":', CAST(40000 + page_id * 10 AS STRING), '},"data_count":', CAST(page_id % 9 AS STRING), '},',
      '{"job_title":{"name":"Analyst"},"average_salary":{"type":"year","amount":', CAST(600000 + page_id AS STRING), '},"data_count":', CAST(page_id % 5 AS STRING), '}]}}}},',
      '"experience":{"experienceById":{"', lpad(CAST(page_id AS STRING), 24, 'a'), '":{"data":{"originalCompanyName":"Company ', CAST(page_id % 40 AS STRING),
      '","job_title":{"name":"', split_part('Engineer|Analyst|Designer', '|', CAST(page_id % 3 AS INT) + 1), '"},"interview_time":{"year":', CAST(2019 + page_id % 6 AS STRING), ',"month":', CAST(1 + page_id % 12 AS STRING),
      '},"interview_result":"', CASE WHEN page_id % 2 = 0 THEN 'offer' ELSE 'rejected' END, '","region":"', split_part('North|South|', '|', CAST(page_id % 3 AS INT) + 1),
      '","experience_in_year": ', CASE WHEN page_id % 4 = 0 THEN 'undefined' ELSE CAST(page_id % 9 AS STRING) END,
      ',"averageSectionRating": ', CASE WHEN page_id % 3 = 0 THEN 'undefined' ELSE concat(CAST(1 + page_id % 4 AS STRING), '.5') END,
      ',"sections":[', CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('{"subtitle":"Round 1","content":"Coding ', CAST(page_id AS STRING), '"},{"subtitle":"Round 2"}') END,
      CASE WHEN page_id % 5 = 1 THEN ',{"content":"More"}' ELSE '' END, ']}},"', lpad(CAST(page_id AS STRING), 24, 'b'),
      '":{"data":{"sections":[{"subtitle":"Only","content":"', CAST(page_id % 7 AS STRING), '"}]}},"', lpad(CAST(page_id AS STRING), 24, 'c'), '":{"data":null}}},"flag": undefined}') END,
    ';</script>') AS html
FROM pages
""")


def pages(spark, sf) -> DataFrame:
    return view(spark, sf, "pages")


# --- anchors ---------------------------------------------------------------------------

def html_anchors(df: DataFrame, pattern: str = HREF_PATTERN, cap: int | None = None) -> DataFrame:
    """src_html_anchors: job links of each page (first per url); ``cap`` keeps at most that many per page."""
    a = df.select("page_id", "url", F.posexplode(H.anchors("html", "url")).alias("idx", "a"))
    a = a.where(F.col("a.href").rlike(pattern)).select(
        "page_id", "idx", F.col("a.title").alias("title"),
        H.absolute_url(F.col("url"), F.split(F.col("a.href"), r"\?", 2).getItem(0)).alias("link"))
    a = a.where((F.col("link") != "") & (F.col("title") != "") & (F.length("title") >= 3))
    first = a.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("idx"))).where("_r = 1")
    if cap is not None:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("idx"))).where(F.col("_n") <= cap)
    return first.select("page_id", "idx", F.col("link").alias("url"), "title",
                         H.company_from_url(F.col("link")).alias("company"))


_ANCHOR_SQL = f"""
a0 AS (SELECT page_id, url, regexp_extract_all(html, {Q.q(H.ANCHOR_RE)}, 1) AS hs, regexp_extract_all(html, {Q.q(H.ANCHOR_RE)}, 2) AS ins FROM pages),
a1 AS (SELECT page_id, url, CAST(i - 1 AS INTEGER) AS idx, {Q.decode_entities('hs[i]')} AS href, {Q.strip_tags('ins[i]')} AS title
       FROM a0, range(1, len(hs) + 1) t(i)),
a2 AS (SELECT page_id, idx, title, {Q.absolute_url('url', "split_part(href, '?', 1)")} AS link FROM a1 WHERE regexp_matches(href, '{HREF_PATTERN}')),
a3 AS (SELECT * FROM a2 WHERE link <> '' AND title <> '' AND length(title) >= 3),
a4 AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY idx) AS r FROM a3)"""


@register("src_html_anchors", ("pages",), f"""WITH {_ANCHOR_SQL}
SELECT page_id, idx, link AS url, title, {Q.company_from_url('link')} AS company FROM a4 WHERE r = 1""")
def src_html_anchors(spark, sf):
    return html_anchors(pages(spark, sf))


@register("txt_absolute_url", ("pages",), f"""WITH {_ANCHOR_SQL}
SELECT page_id, idx, link FROM a2""")
def txt_absolute_url(spark, sf):
    p = pages(spark, sf)
    a = p.select("page_id", "url", F.posexplode(H.anchors("html", "url")).alias("idx", "a"))
    return a.where(F.col("a.href").rlike(HREF_PATTERN)).select(
        "page_id", "idx", H.absolute_url(F.col("url"), F.split(F.col("a.href"), r"\?", 2).getItem(0)).alias("link"))


@register("txt_company_from_url", ("off",), f"SELECT pos, {Q.company_from_url('url')} AS company FROM off")
def txt_company_from_url(spark, sf):
    return view(spark, sf, "off").select("pos", H.company_from_url("url").alias("company"))


@register("txt_decode_entities", ("pages",), f"""
SELECT page_id, {Q.decode_entities("html")} AS text FROM pages""")
def txt_decode_entities(spark, sf):
    return pages(spark, sf).select("page_id", H.decode_entities(F.col("html")).alias("text"))


@register("txt_strip_tags", ("pages",), f"""
SELECT page_id, {Q.strip_tags("html")} AS text FROM pages""")
def txt_strip_tags(spark, sf):
    return pages(spark, sf).select("page_id", H.strip_tags(F.col("html")).alias("text"))


def _strip_html_sql(x: str) -> str:
    s = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)</?(p|div|li|tr)[^>]*>', chr(10), 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    for ent, ch in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        s = f"replace({s}, {Q.q(ent)}, {Q.q(ch)})"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({s}, '^{Q.WS_RE2}+|{Q.WS_RE2}+$', '', 'g')"


@register("txt_strip_html", ("pages",), f"SELECT page_id, {_strip_html_sql('html')} AS text FROM pages")
def txt_strip_html(spark, sf):
    return pages(spark, sf).select("page_id", H.strip_html("html").alias("text"))


# --- liveness ------------------------------------------------------------------------------

# Fixed values (reasons given).
REASON_SHORT = "insufficient content — likely nav/footer only"
REASON_UNCERTAIN = "content present but no visible apply control found"
# Fixed values (closed-page text patterns, listing-page patterns, expired-url patterns, apply controls).
HARD_EXPIRED = [
    r"job (is )?no longer available",
    r"job.*no longer open",
    r"position has been filled",
    r"this job has expired",
    r"job posting has expired",
    r"no longer accepting applications",
    r"this (position|role|job) (is )?no longer",
    r"this job (listing )?is closed",
    r"job (listing )?not found",
    r"the page you are looking for doesn.t exist",
    r"applications?\s+(?:(?:have|are|is)\s+)?closed",
    r"closed on \d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"closed on (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}",
    r"diese stelle (ist )?(nicht mehr|bereits) besetzt",
    r"offre (expirée|n'est plus disponible)",
]
LISTING = [r"\d+\s+jobs?\s+found", r"search for jobs page is loaded"]
EXPIRED_URL = [r"[?&]error=true"]
APPLY = [r"\bapply\b", r"\bsolicitar\b", r"\bbewerben\b", r"\bpostuler\b", r"submit application", r"easy apply",
         r"start application", r"ich bewerbe mich"]
MIN_CONTENT_CHARS = 300


def liveness(df: DataFrame) -> DataFrame:
    """cls_liveness: ordered rules -> (result, reason); ``reason`` names the first matching pattern."""
    body = H.strip_tags(F.col("html"))
    controls = F.transform(H.anchors("html", "final_url"), lambda a: a["title"])
    st = F.col("status")

    def first(patterns, text):
        # One scan for "any pattern" first; only matching texts test the patterns in order.
        any_re = "(?iu)(?:" + "|".join(K.jsre(p) for p in patterns) + ")"
        out = F.when(~text.rlike(any_re), F.lit(None).cast("string"))
        for p in patterns:
            out = out.when(text.rlike("(?iu)" + K.jsre(p)), F.lit(p))
        return out

    exp_url = first(EXPIRED_URL, F.col("final_url"))
    exp_body = first(HARD_EXPIRED, body)
    listing = first(LISTING, body)
    apply_re = "(?iu)(" + "|".join(K.jsre(p) for p in APPLY) + ")"
    has_apply = F.exists(controls, lambda c: c.rlike(apply_re))
    result = (F.when(st.isin(404, 410), "expired").when(exp_url.isNotNull(), "expired")
              .when(exp_body.isNotNull(), "expired").when(has_apply, "active")
              .when(listing.isNotNull(), "expired")
              .when(F.length(T.js_trim(body)) < MIN_CONTENT_CHARS, "expired").otherwise("uncertain"))
    reason = (F.when(st.isin(404, 410), F.concat(F.lit("HTTP "), st.cast("string")))
              .when(exp_url.isNotNull(), F.concat(F.lit("redirect to "), F.col("final_url")))
              .when(exp_body.isNotNull(), F.concat(F.lit("pattern matched: "), exp_body))
              .when(has_apply, F.lit("visible apply control detected"))
              .when(listing.isNotNull(), F.concat(F.lit("pattern matched: "), listing))
              .when(F.length(T.js_trim(body)) < MIN_CONTENT_CHARS, F.lit(REASON_SHORT))
              .otherwise(F.lit(REASON_UNCERTAIN)))
    return df.select("page_id", result.alias("result"), reason.alias("reason"))


def _liveness_sql() -> str:
    body = Q.strip_tags("html")

    def first(patterns, text):
        return "CASE " + " ".join(f"WHEN regexp_matches({text}, {Q.q('(?i)' + p)}) THEN {Q.q(p)}" for p in patterns) + " END"

    apply_re = "(?i)(" + "|".join(APPLY) + ")"
    return f"""
l0 AS (SELECT page_id, status, final_url, {body} AS body,
  list_transform(regexp_extract_all(html, {Q.q(H.ANCHOR_RE)}, 2), lambda x: {Q.strip_tags('x')}) AS controls FROM crawl),
l1 AS (SELECT *, {first(EXPIRED_URL, 'final_url')} AS eu, {first(HARD_EXPIRED, 'body')} AS eb, {first(LISTING, 'body')} AS lp,
  len(list_filter(controls, lambda c: regexp_matches(c, {Q.q(apply_re)}))) > 0 AS ap FROM l0),
live AS (SELECT page_id,
  CASE WHEN status IN (404, 410) THEN 'expired' WHEN eu IS NOT NULL THEN 'expired' WHEN eb IS NOT NULL THEN 'expired'
       WHEN ap THEN 'active' WHEN lp IS NOT NULL THEN 'expired' WHEN length(body) < {MIN_CONTENT_CHARS} THEN 'expired'
       ELSE 'uncertain' END AS result,
  CASE WHEN status IN (404, 410) THEN 'HTTP ' || CAST(status AS VARCHAR) WHEN eu IS NOT NULL THEN 'redirect to ' || final_url
       WHEN eb IS NOT NULL THEN 'pattern matched: ' || eb WHEN ap THEN 'visible apply control detected'
       WHEN lp IS NOT NULL THEN 'pattern matched: ' || lp WHEN length(body) < {MIN_CONTENT_CHARS} THEN {Q.q(REASON_SHORT)}
       ELSE {Q.q(REASON_UNCERTAIN)} END AS reason FROM l1)"""


@register("cls_liveness", ("crawl",), f"WITH {_liveness_sql()} SELECT * FROM live")
def cls_liveness(spark, sf):
    return liveness(view(spark, sf, "crawl"))


@register("agg_liveness_counts", ("crawl",), f"WITH {_liveness_sql()} SELECT result, count(*) AS n FROM live GROUP BY result")
def agg_liveness_counts(spark, sf):
    return liveness(view(spark, sf, "crawl")).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


# --- ATS character normalisation -------------------------------------------------------------

def _ats_sql_segments(x: str) -> str:
    return f"regexp_extract_all({x}, {Q.q(H.ATS_SEGMENT_RE)}, 0)"


def _ats_sanitize_sql(t: str) -> str:
    for _, pat, rep in H.ATS_CLASSES:
        t = f"regexp_replace({t}, {Q.q(pat)}, {Q.q(rep)}, 'g')"
    return t


# Pages and documents with the typographic characters that application systems stumble over.
_TYPOGRAPHY = [("—", 2), ("–", 3), ("“x”", 4), ("‘y’", 5), ("…", 3), ("\u200b", 2), ("\u00a0", 7)]


def _typed(text: str, key: str) -> str:
    return "concat(" + ", ".join([text] + [f"repeat('{c}', CAST({key} % {n} AS INT))" for c, n in _TYPOGRAPHY]) + ")"


_view("typed_pages", ("pages",), f"""
SELECT page_id, concat({_typed("'<p title=\"a — b\">dash'", "page_id")}, '</p><style>a…b</style>', html, {_typed("'<i>end'", "page_id")}, '</i>') AS html FROM pages""")
_view("typed_docs", ("documents",), f"SELECT doc_id, {_typed('text', 'doc_id')} AS text FROM documents")


@register("txt_ats_normalize", ("typed_pages",), f"""
SELECT page_id, md5(array_to_string(list_transform({_ats_sql_segments('html')},
  lambda s: CASE WHEN starts_with(s, '<') THEN s ELSE {_ats_sanitize_sql('s')} END), '')) AS html_md5,
  length(array_to_string(list_transform({_ats_sql_segments('html')},
  lambda s: CASE WHEN starts_with(s, '<') THEN s ELSE {_ats_sanitize_sql('s')} END), '')) AS n_chars FROM typed_pages""")
def txt_ats_normalize(spark, sf):
    out = H.ats_normalize("html")
    return view(spark, sf, "typed_pages").select("page_id", F.md5(out).alias("html_md5"), F.length(out).alias("n_chars"))


def _ats_counts_sql():
    text = f"array_to_string(list_filter({_ats_sql_segments('text')}, lambda s: NOT starts_with(s, '<')), '')"
    cols = ", ".join(f"CAST(len(regexp_extract_all(t, {Q.q(p)})) AS INTEGER) AS {n.replace('-', '_')}"
                     for n, p, _ in H.ATS_CLASSES)
    return f"WITH d AS (SELECT doc_id, {text} AS t FROM typed_docs) SELECT doc_id, {cols} FROM d"


@register("agg_ats_replacements", ("typed_docs",), _ats_counts_sql())
def agg_ats_replacements(spark, sf):
    d = view(spark, sf, "typed_docs").select("doc_id", H.ats_text_only("text").alias("t"))
    return d.select("doc_id", *[F.regexp_count("t", F.lit(p)).cast("int").alias(n.replace("-", "_"))
                                for n, p, _ in H.ATS_CLASSES])


# --- embedded state (company index, interview experiences, salary stats) ------------------------

STATE_RE = r"window\.__data\s*=\s*(\{[\s\S]*?\});\s*</script>"
EXP_SCHEMA = Ty.StructType([
    Ty.StructField("originalCompanyName", Ty.StringType()),
    Ty.StructField("job_title", Ty.StructType([Ty.StructField("name", Ty.StringType())])),
    Ty.StructField("interview_time", Ty.StructType([Ty.StructField("year", Ty.LongType()),
                                                   Ty.StructField("month", Ty.LongType())])),
    Ty.StructField("interview_result", Ty.StringType()),
    Ty.StructField("sections", Ty.ArrayType(Ty.StructType([Ty.StructField("subtitle", Ty.StringType()),
                                                          Ty.StructField("content", Ty.StringType())]))),
])
SAL_SCHEMA = Ty.StructType([Ty.StructField("data", Ty.StructType([Ty.StructField(
    "jobAverageSalaries", Ty.ArrayType(Ty.StructType([
        Ty.StructField("job_title", Ty.StructType([Ty.StructField("name", Ty.StringType())])),
        Ty.StructField("average_salary", Ty.StructType([Ty.StructField("type", Ty.StringType()),
                                                        Ty.StructField("amount", Ty.LongType())])),
        Ty.StructField("data_count", Ty.LongType())])))]))])
STATE_SCHEMA = Ty.StructType([
    Ty.StructField("companyIndex", Ty.StructType([Ty.StructField(
        "overviewStatisticsByName", Ty.MapType(Ty.StringType(), SAL_SCHEMA))])),
    Ty.StructField("experience", Ty.StructType([Ty.StructField(
        "experienceById", Ty.MapType(Ty.StringType(), Ty.StructType([Ty.StructField("data", EXP_SCHEMA)])))])),
])


def embedded_state(df: DataFrame) -> DataFrame:
    """src_embedded_state: the ``window.__data`` blob parsed (``undefined`` -> null); bad JSON -> null state.

    ``state`` has the fields of the fixed schema, ``data`` the whole blob as VARIANT.
    """
    blob = F.regexp_extract("html", STATE_RE, 1)
    fixed = F.regexp_replace(blob, r":\s*undefined", ": null")
    read = df.select("page_id", "company", fixed.alias("_json"), F.when(blob != "", F.try_parse_json(fixed)).alias("data"))
    state = F.when(F.col("data").isNotNull(), F.from_json("_json", STATE_SCHEMA, {"mode": "PERMISSIVE"}))
    return read.select("page_id", "company", state.alias("state"), "data")


def _state_sql():
    blob = f"regexp_extract(html, {Q.q(STATE_RE)}, 1)"
    fixed = f"regexp_replace({blob}, ':\\s*undefined', ': null', 'g')"
    return f"""s0 AS (SELECT page_id, company, CASE WHEN json_valid({fixed}) AND {blob} <> '' THEN {fixed} END AS j FROM pstate)"""


@register("src_embedded_state", ("pstate",), f"""WITH {_state_sql()}
SELECT page_id, j IS NOT NULL AS has_state,
  coalesce(len(json_keys(j, '$.experience.experienceById')), 0) AS n_experiences FROM s0""")
def src_embedded_state(spark, sf):
    s = embedded_state(view(spark, sf, "pstate"))
    return s.select("page_id", F.col("state").isNotNull().alias("has_state"),
                    F.coalesce(F.size(F.map_keys("state.experience.experienceById")), F.lit(0)).cast("bigint")
                    .alias("n_experiences"))


def experience_rows(states: DataFrame) -> DataFrame:
    """One row per interview experience of the embedded state, read from its VARIANT; those without data give none."""
    tvf = states.sparkSession.tvf
    found = states.lateralJoin(tvf.variant_explode(F.variant_get(F.col("data").outer(), "$.experience.experienceById", "variant")))
    e = found.select("page_id", "company", F.col("key").alias("exp_id"), F.try_variant_get("value", "$.data", "variant").alias("d"))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("d", path, kind)

    return e.where("d is not null and not is_variant_null(d)").select(
        "page_id", "company", "exp_id",
        F.coalesce(field("$.originalCompanyName", "string"), F.lit("")).alias("exp_company"),
        F.coalesce(field("$.job_title.name", "string"), F.lit("")).alias("job_title"),
        F.coalesce(field("$.region", "string"), F.lit("")).alias("region"), field("$.experience_in_year", "double").alias("exp_years"),
        F.coalesce(field("$.interview_time.year", "long"), F.lit(0)).alias("year"),
        F.coalesce(field("$.interview_time.month", "long"), F.lit(0)).alias("month"),
        F.coalesce(field("$.interview_result", "string"), F.lit("")).alias("result"),
        field("$.averageSectionRating", "double").alias("rating"), field("$.sections", "variant").alias("sections"))


def experience_sections(rows: DataFrame) -> DataFrame:
    """Every experience with its sections' texts, a row per section (number null where there are none)."""
    found = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("sections").outer()))
    text = lambda name: F.coalesce(F.try_variant_get("value", f"$.{name}", "string"), F.lit(""))
    return found.select(*[c for c in rows.columns if c != "sections"], F.col("pos").cast("int").alias("section"),
                        F.when(F.col("pos").isNotNull(), text("subtitle")).alias("subtitle"), F.when(F.col("pos").isNotNull(), text("content")).alias("content"))


def experiences(spark, sf) -> DataFrame:
    return experience_rows(embedded_state(view(spark, sf, "pstate")))


_EXP_SQL = f"""{_state_sql()},
ek AS (SELECT page_id, company, unnest(json_keys(j, '$.experience.experienceById')) AS exp_id, j FROM s0 WHERE j IS NOT NULL),
ed AS (SELECT page_id, company, exp_id, json_extract(j, '$.experience.experienceById."' || exp_id || '".data') AS d FROM ek),
ex AS (SELECT page_id, company, exp_id, coalesce(d->>'$.originalCompanyName', '') AS exp_company, coalesce(d->>'$.job_title.name', '') AS job_title,
  coalesce(d->>'$.region', '') AS region, TRY_CAST(d->>'$.experience_in_year' AS DOUBLE) AS exp_years,
  coalesce(TRY_CAST(d->>'$.interview_time.year' AS BIGINT), 0) AS year, coalesce(TRY_CAST(d->>'$.interview_time.month' AS BIGINT), 0) AS month,
  coalesce(d->>'$.interview_result', '') AS result, TRY_CAST(d->>'$.averageSectionRating' AS DOUBLE) AS rating, d->'$.sections' AS sections
  FROM ed WHERE d IS NOT NULL AND json_type(d) <> 'NULL')"""


@register("src_experiences", ("pstate",), f"""WITH {_EXP_SQL},
n AS (SELECT *, unnest(CASE WHEN coalesce(json_array_length(sections), 0) = 0 THEN [NULL] ELSE range(0, json_array_length(sections)::BIGINT) END)::INT AS section FROM ex)
SELECT * EXCLUDE (sections), CASE WHEN section IS NOT NULL THEN coalesce(sections[section]->>'$.subtitle', '') END AS subtitle,
  CASE WHEN section IS NOT NULL THEN coalesce(sections[section]->>'$.content', '') END AS content FROM n""")
def src_experiences(spark, sf):
    return experience_sections(experiences(spark, sf))


def recent_per_company(rows: DataFrame, since: int, limit: int) -> DataFrame:
    """The first ``limit`` experiences of each company that are undated or not before the year ``since``."""
    w = Window.partitionBy("company").orderBy("page_id", "exp_id")
    recent = rows.where((F.col("year") == 0) | (F.col("year") >= since))
    return recent.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


RECENT_SINCE, RECENT_LIMIT, SALARY_LIMIT = 2022, 3, 8


@register("win_recent_per_company", ("pstate",), f"""WITH {_EXP_SQL}
SELECT page_id, exp_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY page_id, exp_id) AS rn FROM ex
WHERE year = 0 OR year >= {RECENT_SINCE}) WHERE rn <= {RECENT_LIMIT}""")
def win_recent_per_company(spark, sf):
    return recent_per_company(experiences(spark, sf), RECENT_SINCE, RECENT_LIMIT).select("page_id", "exp_id")


def salaries(spark, sf) -> DataFrame:
    s = embedded_state(view(spark, sf, "pstate"))
    first = F.get(F.map_values("state.companyIndex.overviewStatisticsByName"), 0)
    rows = s.select("page_id", "company", F.posexplode(first["data"]["jobAverageSalaries"]).alias("idx", "x"))
    return rows.select("page_id", "company", "idx", F.coalesce("x.job_title.name", F.lit("")).alias("job"),
                       F.coalesce("x.average_salary.type", F.lit("")).alias("type"),
                       F.coalesce("x.average_salary.amount", F.lit(0)).alias("amount"),
                       F.coalesce("x.data_count", F.lit(0)).alias("count"))


_SAL_SQL = f"""{_state_sql()},
sk AS (SELECT page_id, company, j, json_keys(j, '$.companyIndex.overviewStatisticsByName')[1] AS k FROM s0 WHERE j IS NOT NULL),
sa AS (SELECT page_id, company, json_extract(j, '$.companyIndex.overviewStatisticsByName."' || k || '".data.jobAverageSalaries') AS arr FROM sk),
sal AS (SELECT page_id, company, CAST(i - 1 AS INTEGER) AS idx,
  coalesce(json_extract_string(arr, '$[' || (i - 1) || '].job_title.name'), '') AS job,
  coalesce(json_extract_string(arr, '$[' || (i - 1) || '].average_salary.type'), '') AS type,
  coalesce(CAST(json_extract(arr, '$[' || (i - 1) || '].average_salary.amount') AS BIGINT), 0) AS amount,
  coalesce(CAST(json_extract(arr, '$[' || (i - 1) || '].data_count') AS BIGINT), 0) AS count
  FROM sa, range(1, CAST(coalesce(json_array_length(arr), 0) AS BIGINT) + 1) t(i))"""


@register("src_salary_stats", ("pstate",), f"WITH {_SAL_SQL} SELECT * FROM sal")
def src_salary_stats(spark, sf):
    return salaries(spark, sf)


def first_salaries(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` salary statistics of each company."""
    w = Window.partitionBy("company").orderBy("page_id", "idx")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


@register("win_salary_top", ("pstate",), f"""WITH {_SAL_SQL}
SELECT page_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY page_id, idx) AS rn FROM sal) WHERE rn <= {SALARY_LIMIT}""")
def win_salary_top(spark, sf):
    return first_salaries(salaries(spark, sf), SALARY_LIMIT).select("page_id", "idx")


assert "crawl" in VIEWS and "pstate" in VIEWS
