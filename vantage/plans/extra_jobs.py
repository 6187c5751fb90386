"""Job-detail documents, company site profiles, HTML job cards and rendered card text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import html as H
from ..functions import text as T
from ..session import cut_table, once
from ..sources.bindings import AS_OF_EVENTS, _view, view
from . import sqlrules as Q
from .page_jobs import _strip_html_sql
from .registry import register

# Job-detail payloads (nested header / jobDetail / condition / welfare), one per event.
_view("jpay", ("events",), """
SELECT event_id AS pos, CAST(event_id AS STRING) AS job_no, concat('Company ', CAST(user_id % 40 AS STRING)) AS company,
  concat('{"data":{"header":{',
    CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('"jobName":"', event_type, ' <b>Engineer</b>",') END,
    '"custName":"Company ', CAST(user_id % 40 AS STRING), '",',
    CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('"corpName":"Corp ', CAST(user_id % 40 AS STRING), '",') END,
    '"custUrl":', CASE WHEN event_id % 3 = 0 THEN '"https://c.example.com"' ELSE '""' END, '},',
    '"jobDetail":{"salary":', CASE WHEN event_id % 4 = 0 THEN '""' ELSE '"40000~60000"' END,
    ',"salaryMin":', CAST((event_id % 3) * 10000 AS STRING), ',"salaryMax":', CAST((event_id % 2) * 55000 AS STRING),
    ',"addressRegion":"North City","addressArea":', CASE WHEN event_id % 2 = 0 THEN '"East"' ELSE '""' END,
    ',"addressDetail":', CASE WHEN event_id % 5 = 0 THEN '" 5F "' ELSE '""' END,
    ',"jobType":', CAST(1 + event_id % 6 AS STRING), ',"remoteWork":', CAST(event_id % 2 AS STRING),
    ',"jobDescription":', CASE WHEN event_id % 7 = 0 THEN '""' ELSE
      '"We build data tools for many happy customers.【Duties】Build &amp; ship<br>daily"' END, '},',
    '"condition":{"workExp":', CASE WHEN event_id % 3 = 0 THEN '""' ELSE '"3 years"' END, ',"edu":"University",',
    '"skill":[{"description":"Python"},{"description":"SQL"}],"certificate":[],',
    '"language":[{"language":"English","ability":"Fluent"},{"language":"French","ability":""}],',
    '"other":', CASE WHEN event_id % 2 = 0 THEN '"Team player"' ELSE '""' END, '},',
    '"welfare":{"welfare":"Bonus","tag":', CASE WHEN event_id % 2 = 0 THEN '["remote","snacks"]' ELSE '[]' END, '},',
    '"industry":"Software","employees":', CASE WHEN event_id % 5 = 0 THEN '"暫不提供"' ELSE '"120人"' END,
    ',"custNo":"c', CAST(user_id AS STRING), '"}}') AS json
FROM events
""")

JD = Ty.StructType([Ty.StructField("data", Ty.StructType([
    Ty.StructField("header", Ty.StructType([Ty.StructField(n, Ty.StringType())
                                            for n in ["jobName", "custName", "corpName", "custUrl"]])),
    Ty.StructField("jobDetail", Ty.StructType(
        [Ty.StructField(n, Ty.StringType()) for n in ["salary", "addressRegion", "addressArea", "addressDetail",
                                                     "jobDescription"]]
        + [Ty.StructField(n, Ty.LongType()) for n in ["salaryMin", "salaryMax", "jobType", "remoteWork"]])),
    Ty.StructField("condition", Ty.StructType([
        Ty.StructField("workExp", Ty.StringType()), Ty.StructField("edu", Ty.StringType()),
        Ty.StructField("skill", Ty.ArrayType(Ty.StructType([Ty.StructField("description", Ty.StringType())]))),
        Ty.StructField("certificate", Ty.ArrayType(Ty.StructType([Ty.StructField("description", Ty.StringType())]))),
        Ty.StructField("language", Ty.ArrayType(Ty.StructType([Ty.StructField("language", Ty.StringType()),
                                                               Ty.StructField("ability", Ty.StringType())]))),
        Ty.StructField("other", Ty.StringType())])),
    Ty.StructField("welfare", Ty.StructType([Ty.StructField("welfare", Ty.StringType()),
                                             Ty.StructField("tag", Ty.ArrayType(Ty.StringType()))])),
    Ty.StructField("industry", Ty.StringType()), Ty.StructField("employees", Ty.StringType()),
    Ty.StructField("custNo", Ty.StringType())]))])

# Fixed values (job type labels).
JOB_TYPE = {1: "全職", 2: "兼職", 3: "高階", 4: "派遣", 5: "實習"}


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(c: Column, default: str) -> Column:
    return F.when(_s(c) != "", c).otherwise(F.lit(default))


def _opt(cond: Column, *lines: Column) -> Column:
    return F.when(cond, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def jd_document(df: DataFrame) -> DataFrame:
    """src_jd_document: flat JD fields assembled into the queue's text document."""
    j = df.select("pos", "job_no", "company", F.from_json("json", JD)["data"].alias("d"))
    h, jd, c, w = F.col("d.header"), F.col("d.jobDetail"), F.col("d.condition"), F.col("d.welfare")
    jt = F.try_element_at(F.create_map(*[x for k, v in JOB_TYPE.items() for x in (F.lit(k), F.lit(v))]), jd["jobType"])
    jt = F.coalesce(jt, jd["jobType"].cast("string"), F.lit(""))
    skills = F.filter(F.transform(F.coalesce(c["skill"], F.array()), lambda s: _s(s["description"])), lambda x: x != "")
    certs = F.filter(F.transform(F.coalesce(c["certificate"], F.array()), lambda s: _s(s["description"])), lambda x: x != "")
    langs = F.filter(F.transform(F.coalesce(c["language"], F.array()), lambda l: F.concat_ws(
        " ", F.when(_s(l["language"]) != "", l["language"]), F.when(_s(l["ability"]) != "", l["ability"]))),
        lambda x: x != "")
    tags = F.coalesce(w["tag"], F.array())
    lines = F.flatten(F.array(
        F.array(F.concat(F.lit("# 職缺 JD — "), F.coalesce(F.when(_s(h["jobName"]) != "", h["jobName"]), F.col("company"))),
                F.concat(F.lit("公司："), F.coalesce(F.when(_s(h["corpName"]) != "", h["corpName"]), F.col("company"))),
                F.concat(F.lit("URL：https://www.104.com.tw/job/"), F.col("job_no")),
                F.concat(F.lit("薪資："), _or(jd["salary"], "面議")),
                F.concat(F.lit("工作地點："), _s(jd["addressRegion"]), _s(jd["addressArea"])),
                F.concat(F.lit("工作性質："), jt),
                F.concat(F.lit("遠端："), F.when(F.coalesce(jd["remoteWork"], F.lit(0)) != 0, "是").otherwise("否")),
                F.lit(""), F.lit("## 工作內容"), _or(jd["jobDescription"], "（無）"), F.lit(""), F.lit("## 條件要求"),
                F.concat(F.lit("年資："), _or(c["workExp"], "不拘")), F.concat(F.lit("學歷："), _or(c["edu"], "不拘")),
                F.when(F.size(skills) > 0, F.concat(F.lit("技能："), F.array_join(skills, "、"))).otherwise(F.lit("")),
                F.when(F.size(certs) > 0, F.concat(F.lit("證照："), F.array_join(certs, "、"))).otherwise(F.lit("")),
                F.when(F.size(langs) > 0, F.concat(F.lit("語言："), F.array_join(langs, "、"))).otherwise(F.lit("")),
                F.when(_s(c["other"]) != "", F.concat(F.lit("其他："), c["other"])).otherwise(F.lit("")),
                F.lit(""), F.lit("## 福利待遇"), _s(w["welfare"]),
                F.when(F.size(tags) > 0, F.concat(F.lit("標籤："), F.array_join(tags, "、"))).otherwise(F.lit(""))),
    ))
    return j.select("pos", T.js_trim(F.array_join(lines, "\n")).alias("document"))


def _jd_sql_fields():
    return """j0 AS (SELECT pos, job_no, company, json FROM jpay),
j1 AS (SELECT pos, job_no, company,
  json_extract_string(json, '$.data.header.jobName') AS job_name, json_extract_string(json, '$.data.header.corpName') AS corp,
  json_extract_string(json, '$.data.header.custName') AS cust, json_extract_string(json, '$.data.header.custUrl') AS cust_url,
  json_extract_string(json, '$.data.jobDetail.salary') AS salary, CAST(json_extract(json, '$.data.jobDetail.salaryMin') AS BIGINT) AS smin,
  CAST(json_extract(json, '$.data.jobDetail.salaryMax') AS BIGINT) AS smax,
  json_extract_string(json, '$.data.jobDetail.addressRegion') AS region, json_extract_string(json, '$.data.jobDetail.addressArea') AS area,
  json_extract_string(json, '$.data.jobDetail.addressDetail') AS addr_detail, CAST(json_extract(json, '$.data.jobDetail.jobType') AS BIGINT) AS job_type,
  CAST(json_extract(json, '$.data.jobDetail.remoteWork') AS BIGINT) AS remote, json_extract_string(json, '$.data.jobDetail.jobDescription') AS descr,
  json_extract_string(json, '$.data.condition.workExp') AS work_exp, json_extract_string(json, '$.data.condition.edu') AS edu,
  list_filter(list_transform(json_extract_string(json, '$.data.condition.skill[*].description'), lambda x: coalesce(x, '')), lambda x: x <> '') AS skills,
  list_filter(list_transform(json_extract_string(json, '$.data.condition.certificate[*].description'), lambda x: coalesce(x, '')), lambda x: x <> '') AS certs,
  json_extract_string(json, '$.data.condition.language[*].language') AS langs_l, json_extract_string(json, '$.data.condition.language[*].ability') AS langs_a,
  json_extract_string(json, '$.data.condition.other') AS other, json_extract_string(json, '$.data.welfare.welfare') AS welfare,
  json_extract_string(json, '$.data.welfare.tag[*]') AS tags, json_extract_string(json, '$.data.industry') AS industry,
  json_extract_string(json, '$.data.employees') AS employees, json_extract_string(json, '$.data.custNo') AS cust_no FROM j0)"""


@register("src_jd_document", ("jpay",), f"""WITH {_jd_sql_fields()},
j2 AS (SELECT *, list_filter(list_transform(range(1, len(coalesce(langs_l, [])) + 1), lambda i: concat_ws(' ', nullif(langs_l[i], ''), nullif(langs_a[i], ''))), lambda x: x <> '') AS langs FROM j1)
SELECT pos, regexp_replace(array_to_string([
  '# 職缺 JD — ' || coalesce(nullif(job_name, ''), company), '公司：' || coalesce(nullif(corp, ''), company),
  'URL：https://www.104.com.tw/job/' || job_no, '薪資：' || coalesce(nullif(salary, ''), '面議'),
  '工作地點：' || coalesce(region, '') || coalesce(area, ''),
  '工作性質：' || coalesce(CASE job_type WHEN 1 THEN '全職' WHEN 2 THEN '兼職' WHEN 3 THEN '高階' WHEN 4 THEN '派遣' WHEN 5 THEN '實習' END, CAST(job_type AS VARCHAR), ''),
  '遠端：' || CASE WHEN coalesce(remote, 0) <> 0 THEN '是' ELSE '否' END, '', '## 工作內容', coalesce(nullif(descr, ''), '（無）'), '', '## 條件要求',
  '年資：' || coalesce(nullif(work_exp, ''), '不拘'), '學歷：' || coalesce(nullif(edu, ''), '不拘'),
  CASE WHEN len(skills) > 0 THEN '技能：' || array_to_string(skills, '、') ELSE '' END,
  CASE WHEN len(certs) > 0 THEN '證照：' || array_to_string(certs, '、') ELSE '' END,
  CASE WHEN len(langs) > 0 THEN '語言：' || array_to_string(langs, '、') ELSE '' END,
  CASE WHEN coalesce(other, '') <> '' THEN '其他：' || other ELSE '' END, '', '## 福利待遇', coalesce(welfare, ''),
  CASE WHEN len(coalesce(tags, [])) > 0 THEN '標籤：' || array_to_string(tags, '、') ELSE '' END], chr(10)),
  '^{Q.WS_RE2}+|{Q.WS_RE2}+$', '', 'g') AS document FROM j2""")
def src_jd_document(spark, sf):
    return jd_document(view(spark, sf, "jpay"))


def _thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def jd_markdown(df: DataFrame, as_of: str) -> DataFrame:
    """src_jd_markdown: the second JD rendering (salary range, placeholder employees dropped, intro before 【…】)."""
    j = df.select("pos", "job_no", F.from_json("json", JD)["data"].alias("d"))
    h, jd, c, w = F.col("d.header"), F.col("d.jobDetail"), F.col("d.condition"), F.col("d.welfare")
    title = H.strip_html(_or(h["jobName"], "（職位未知）"))
    company = H.strip_html(_or(h["custName"], "（公司未知）"))
    loc_parts = F.filter(F.array(jd["addressRegion"], jd["addressArea"]), lambda x: _s(x) != "")
    location = F.when(F.size(loc_parts) > 0, F.array_join(loc_parts, " ")).otherwise(F.lit("未提供"))
    detail = T.js_trim(_s(jd["addressDetail"]))
    smin, smax = F.coalesce(jd["salaryMin"], F.lit(0)), F.coalesce(jd["salaryMax"], F.lit(0))
    salary = (F.when((smin != 0) & (smax != 0), F.concat(_thousands(smin), F.lit("～"), _thousands(smax), F.lit(" 元")))
              .when(smin != 0, F.concat(_thousands(smin), F.lit(" 元以上"))).otherwise(F.lit("面議")))
    desc = H.strip_html(_s(jd["jobDescription"]))
    req = H.strip_html(_s(c["other"]))
    wel = H.strip_html(_s(w["welfare"]))
    emp = T.js_trim(_s(F.col("d.employees")))
    emp = F.when((emp != "") & (emp != "暫不提供"), emp)
    idx = F.regexp_instr(desc, F.lit("【[^】]+】"))
    intro = F.when(idx > 1, T.js_trim(F.substring(desc, F.lit(1), idx - 1))).otherwise(F.lit(""))
    intro = F.when(F.length(intro) > 30, intro).otherwise(F.lit(""))
    cust_url = _s(h["custUrl"])
    page = F.when(cust_url != "", cust_url).otherwise(F.concat(F.lit("https://www.104.com.tw/company/"), _s(F.col("d.custNo"))))
    lines = F.flatten(F.array(
        F.array(F.concat(F.lit("# "), title, F.lit(" — "), company), F.lit(""),
                F.concat(F.lit("**職缺 URL**: https://www.104.com.tw/job/"), F.col("job_no")),
                F.concat(F.lit("**公司頁面**: "), page),
                F.concat(F.lit("**地點**: "), location, F.when(detail != "", F.concat(F.lit("（"), detail, F.lit("）"))).otherwise(F.lit(""))),
                F.concat(F.lit("**薪資**: "), salary), F.concat(F.lit("**抓取日期**: "), F.lit(as_of)), F.lit("")),
        _opt(desc != "", F.lit("## 工作內容"), F.lit(""), desc, F.lit("")),
        _opt(req != "", F.lit("## 條件要求"), F.lit(""), req, F.lit("")),
        _opt(wel != "", F.lit("## 福利制度"), F.lit(""), wel, F.lit("")),
        F.array(F.lit("## 公司簡介"), F.lit("")),
        _opt(_s(F.col("d.industry")) != "", F.concat(F.lit("**產業**: "), F.col("d.industry"))),
        _opt(emp.isNotNull(), F.concat(F.lit("**員工人數**: "), emp)),
        F.array(F.lit("")),
        _opt(intro != "", intro, F.lit("")),
        _opt(intro == "", F.lit("<!-- 請自行補充公司介紹 -->"), F.lit("")),
    ))
    return j.select("pos", F.array_join(lines, "\n").alias("markdown"))


def _fmt(x):
    return f"format('{{:,}}', {x})"


@register("src_jd_markdown", ("jpay",), f"""WITH {_jd_sql_fields()},
m AS (SELECT *, {_strip_html_sql("coalesce(nullif(job_name, ''), '（職位未知）')")} AS title, {_strip_html_sql("coalesce(nullif(cust, ''), '（公司未知）')")} AS comp,
  {_strip_html_sql("coalesce(descr, '')")} AS d, {_strip_html_sql("coalesce(other, '')")} AS req, {_strip_html_sql("coalesce(welfare, '')")} AS wel,
  CASE WHEN trim(coalesce(employees, '')) <> '' AND trim(coalesce(employees, '')) <> '暫不提供' THEN trim(employees) END AS emp FROM j1),
m2 AS (SELECT *, CASE WHEN strpos(d, '【') > 1 AND regexp_matches(d, '【[^】]+】') AND strpos(d, regexp_extract(d, '【[^】]+】', 0)) > 1
  THEN trim(substr(d, 1, strpos(d, regexp_extract(d, '【[^】]+】', 0)) - 1)) ELSE '' END AS intro0 FROM m),
m3 AS (SELECT *, CASE WHEN length(intro0) > 30 THEN intro0 ELSE '' END AS intro FROM m2)
SELECT pos, array_to_string(flatten([
  ['# ' || title || ' — ' || comp, '', '**職缺 URL**: https://www.104.com.tw/job/' || job_no,
   '**公司頁面**: ' || CASE WHEN coalesce(cust_url, '') <> '' THEN cust_url ELSE 'https://www.104.com.tw/company/' || coalesce(cust_no, '') END,
   '**地點**: ' || coalesce(nullif(concat_ws(' ', nullif(region, ''), nullif(area, '')), ''), '未提供')
     || CASE WHEN trim(coalesce(addr_detail, '')) <> '' THEN '（' || trim(addr_detail) || '）' ELSE '' END,
   '**薪資**: ' || CASE WHEN coalesce(smin, 0) <> 0 AND coalesce(smax, 0) <> 0 THEN {_fmt('smin')} || '～' || {_fmt('smax')} || ' 元'
                       WHEN coalesce(smin, 0) <> 0 THEN {_fmt('smin')} || ' 元以上' ELSE '面議' END,
   '**抓取日期**: {AS_OF_EVENTS}', ''],
  CASE WHEN d <> '' THEN ['## 工作內容', '', d, ''] ELSE [] END,
  CASE WHEN req <> '' THEN ['## 條件要求', '', req, ''] ELSE [] END,
  CASE WHEN wel <> '' THEN ['## 福利制度', '', wel, ''] ELSE [] END,
  ['## 公司簡介', ''],
  CASE WHEN coalesce(industry, '') <> '' THEN ['**產業**: ' || industry] ELSE [] END,
  CASE WHEN emp IS NOT NULL THEN ['**員工人數**: ' || emp] ELSE [] END,
  [''],
  CASE WHEN intro <> '' THEN [intro, ''] ELSE [] END,
  CASE WHEN intro = '' THEN ['<!-- 請自行補充公司介紹 -->', ''] ELSE [] END]), chr(10)) AS markdown FROM m3""")
def src_jd_markdown(spark, sf):
    return jd_markdown(view(spark, sf, "jpay"), AS_OF_EVENTS)


# --- company site profile ----------------------------------------------------------------------

# Pages of company sites: with and without descriptions, structured data (some of it broken) and brand names.
_view("sites", ("pages",), """
SELECT page_id, concat(
  CASE WHEN page_id % 3 = 0 THEN concat('<meta property="og:description" content="We build useful things for region ', CAST(page_id AS STRING), '">') ELSE '' END,
  CASE WHEN page_id % 4 = 1 THEN concat('<meta name="description" content="A description of company ', CAST(page_id AS STRING), ' for readers">') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN concat('<script type="application/ld+json">{"name":"Brand ', CAST(page_id % 17 AS STRING), '","description":"Structured text ', CAST(page_id AS STRING), '"}</script>')
       WHEN page_id % 5 = 1 THEN '<script type="application/ld+json">{"name":"Brand only"}</script>'
       WHEN page_id % 5 = 2 THEN '<script type="application/ld+json">{"name": broken</script>' ELSE '' END, html) AS html
FROM pages
""")

# Fixed values (patterns of descriptions, structured data and text blocks).
OG_RE = r"(?i)<meta[^>]+property=[\"']og:description[\"'][^>]+content=[\"']([^\"']{20,})"
META_RE = r"(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']{20,})"
LD_RE = r"(?i)<script type=[\"']application/ld\+json[\"']>([\s\S]*?)</script>"
BLOCK_RE = r"(?i)<(h[1-4]|p)[^>]*>([\s\S]*?)</\1>"
BLOCK_RE2 = "(?i)" + "|".join(f"<{t}[^>]*>[\\s\\S]*?</{t}>" for t in ["h1", "h2", "h3", "h4", "p"])


def _clean_block(b: Column) -> Column:
    s = F.regexp_replace(b, r"<[^>]+>", " ")
    s = F.replace(F.replace(F.replace(s, F.lit("&amp;"), F.lit("&")), F.lit("&#x27;"), F.lit("'")), F.lit("&nbsp;"), F.lit(" "))
    s = F.regexp_replace(F.regexp_replace(s, r"&copy;[^<]*", ""), r"©[^\n]*", "")
    return T.collapse_ws(s)


def _block_ok(t: Column) -> Column:
    letters = F.regexp_count(t, F.lit("[a-zA-Z一-龥]"))
    return ((F.length(t) > 30) & (F.length(t) < 400)
            & ~F.regexp_replace(t, T.WS_CLASS, "").rlike("([A-Z][a-z]+){4,}")
            & ~t.rlike("(?i)copyright|cookie|privacy|all rights reserved")
            & (letters > F.length(t) * 0.3))


def site_profile(pages: DataFrame, max_blocks: int | None = None) -> DataFrame:
    """src_site_profile: intro (JSON-LD description, else og/meta description), brand, quality text blocks (the first ``max_blocks``)."""
    h = F.col("html")
    og = F.coalesce(F.when(h.rlike(OG_RE), F.regexp_extract(h, OG_RE, 1)), F.when(h.rlike(META_RE), F.regexp_extract(h, META_RE, 1)),
                    F.lit(""))
    ld = F.when(h.rlike(LD_RE), F.regexp_extract(h, LD_RE, 1))
    ld_ok = F.try_parse_json(ld).isNotNull()
    ld_name = F.when(ld_ok, F.get_json_object(ld, "$.name"))
    ld_desc = F.when(ld_ok, F.get_json_object(ld, "$.description"))
    no_script = F.regexp_replace(F.regexp_replace(h, r"(?i)<script[\s\S]*?</script>", ""), r"(?i)<style[\s\S]*?</style>", "")
    blocks = F.transform(F.regexp_extract_all(no_script, F.lit(BLOCK_RE), 2), _clean_block)
    good = F.filter(blocks, _block_ok)
    if max_blocks is not None:
        good = F.slice(good, 1, max_blocks)
    return pages.select("page_id", F.coalesce(F.when(_s(ld_desc) != "", ld_desc), og).alias("intro"),
                        F.coalesce(ld_name, F.lit("")).alias("brand"), F.size(good).alias("n_blocks"),
                        F.array_join(good, "\n").alias("blocks"))


def _clean_block_sql(x):
    s = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    s = f"replace(replace(replace({s}, '&amp;', '&'), '&#x27;', ''''), '&nbsp;', ' ')"
    s = f"regexp_replace(regexp_replace({s}, '&copy;[^<]*', '', 'g'), '©[^\\n]*', '', 'g')"
    return f"regexp_replace(regexp_replace({s}, '{Q.WS_RE2}+', ' ', 'g'), '^{Q.WS_RE2}+|{Q.WS_RE2}+$', '', 'g')"


@register("src_site_profile", ("sites",), f"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?i)<script[\\s\\S]*?</script>', '', 'g'), '(?i)<style[\\s\\S]*?</style>', '', 'g') AS ns FROM sites),
b AS (SELECT page_id, html, list_transform(regexp_extract_all(ns, {Q.q(BLOCK_RE2)}, 0),
  lambda x: {_clean_block_sql("regexp_replace(regexp_replace(x, '(?i)^<[^>]*>', ''), '(?i)</[^>]*>$', '')")}) AS bl FROM p),
g AS (SELECT page_id, html, list_filter(bl, lambda t: length(t) > 30 AND length(t) < 400
  AND NOT regexp_matches(regexp_replace(t, '{Q.WS_RE2}', '', 'g'), '([A-Z][a-z]+){{4,}}')
  AND NOT regexp_matches(t, '(?i)copyright|cookie|privacy|all rights reserved')
  AND len(regexp_extract_all(t, '[a-zA-Z一-龥]')) > length(t) * 0.3) AS good FROM b), l AS (SELECT *, regexp_extract(html, {Q.q(LD_RE)}, 1) AS ld FROM g)
SELECT page_id, coalesce(CASE WHEN json_valid(ld) THEN nullif(ld->>'$.description', '') END, nullif(regexp_extract(html, {Q.q(OG_RE)}, 1), ''), nullif(regexp_extract(html, {Q.q(META_RE)}, 1), ''), '') AS intro,
  coalesce(CASE WHEN json_valid(ld) THEN ld->>'$.name' END, '') AS brand, CAST(len(good) AS INTEGER) AS n_blocks, array_to_string(good, chr(10)) AS blocks FROM l""")
def src_site_profile(spark, sf):
    return site_profile(view(spark, sf, "sites"))


# --- job cards --------------------------------------------------------------------------------

# Listing pages with job cards (title anchor + company anchor), built from offers.
_view("cards", ("off",), """
SELECT page_id, 'https://www.cakeresume.com/jobs?query=x' AS url,
  concat(lead, '<div class="card"><h2><a class="jobTitle big" href="/companies/c', c, '/jobs/', CAST(page_id AS STRING),
    '?ref=list">', title, '</a></h2><span>', CASE WHEN page_id % 4 = 0 THEN 'Remote-first team' WHEN page_id % 4 = 1 THEN '台北市信義區, hybrid'
    WHEN page_id % 4 = 2 THEN 'Office in 新竹縣竹北市' ELSE 'Location flexible' END, '</span>',
    CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('<a class="companyName" href="/companies/c', c, '">', company, '</a>') END, '</div>',
    CASE WHEN page_id % 3 = 0 THEN concat(repeat('<p>filler text</p>', 300), '<a class="jobTitle big" href="/companies/c', c, '/jobs/', CAST(page_id AS STRING), 'b">',
      upper(title), '</a><a class="companyName" href="#">Second ', company, '</a>') ELSE '' END,
    CASE WHEN page_id % 6 = 0 THEN concat(repeat('<i>more</i>', 400), '<a class="jobTitle big" href="/companies/c', c, '/jobs/', CAST(page_id AS STRING), 'b">',
      upper(title), '</a>') ELSE '' END) AS html
FROM (SELECT pos AS page_id, CAST(pos % 40 AS STRING) AS c, title, company, repeat('<br>', CAST(pos % 30 AS INT)) AS lead FROM off) o
""")

# Fixed values (patterns of job cards).
CARD_RE = r"(?i)<a\b([^>]*class=[\"'][^\"']*jobTitle[^\"']*[\"'][^>]*)>([\s\S]*?)</a>"
COMPANY_RE = r"(?i)class=[\"'][^\"']*companyName[^\"']*[\"'][^>]*>([\s\S]*?)</a>"


def card_windows(html: Column, window: int, anchors: Column | None = None) -> Column:
    """array<struct<attrs, inner, card>>: every title anchor with up to ``window`` characters before its start and after.

    The text is split at its anchors, so an anchor's place is the length of what stands before it: equal
    anchors have places of their own, and only the windows leave the expression, not the page.
    """
    anchors = F.regexp_extract_all(html, F.lit(CARD_RE), 0) if anchors is None else anchors
    between = F.split(html, CARD_RE, -1)
    ends = F.aggregate(
        F.arrays_zip(anchors.alias("m"), F.slice(between, 1, F.greatest(F.size(anchors), F.lit(0))).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"] + F.length(x["gap"]) + 1)).alias("starts")),
        lambda acc: acc["starts"])

    def card(m: Column, at: Column) -> Column:
        start = F.greatest(at - window, F.lit(1))
        return F.struct(F.regexp_extract(m, CARD_RE, 1).alias("attrs"), F.regexp_extract(m, CARD_RE, 2).alias("inner"),
                        F.substring(html, start, F.least(at + window, F.length(html) + 1) - start).alias("card"))

    return F.zip_with(anchors, ends, card)


def html_cards(pages: DataFrame, window: int = 2500) -> DataFrame:
    """src_html_cards: title anchors; company from the ±``window`` characters around each anchor."""
    whole = pages.select("page_id", "url", once(F.col("html")).alias("html"))
    found = whole.select("page_id", "url", "html", once(F.regexp_extract_all("html", F.lit(CARD_RE), 0)).alias("anchors")).where(F.size("anchors") > 0)
    windows = found.select("page_id", "url", once(card_windows(F.col("html"), window, F.col("anchors"))).alias("cards"))
    e = windows.select("page_id", "url", F.posexplode("cards").alias("idx", "c"))
    attrs, inner = F.col("c.attrs"), F.col("c.inner")
    href = F.regexp_extract(attrs, r"(?i)href=[\"']([^\"']+)[\"']", 1)
    company = F.regexp_extract(F.col("c.card"), COMPANY_RE, 1)
    # Written once: the first card of a url and the cards themselves are two readings.
    out = cut_table(e.where(href.rlike(r"(?i)/companies/[^/]+/jobs/[^/?#]+")).select(
        "page_id", "idx", H.strip_tags(inner).alias("title"),
        H.absolute_url(F.col("url"), F.split(H.decode_entities(href), r"\?", 2).getItem(0)).alias("job_url"),
        F.coalesce(F.when(H.strip_tags(company) != "", H.strip_tags(company)),
                   F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), H.company_from_url(href)).otherwise(F.lit(""))).alias("company")))
    first = out.groupBy("page_id", "job_url").agg(F.min("idx").alias("idx"))
    return out.join(first, ["page_id", "job_url", "idx"], "left_semi")


_STRIPPED = "trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{ws}+', ' ', 'g'))".replace("{ws}", Q.WS_RE2)


_ANCHOR_SQL = "(?i)<a\\b[^>]*class=[\"''][^\"'']*jobTitle[^\"'']*[\"''][^>]*>[\\s\\S]*?</a>"


@register("src_html_cards", ("cards",), f"""
WITH m AS (SELECT page_id, url, html, regexp_extract_all(html, {Q.q(CARD_RE)}, 0) AS ms, regexp_split_to_array(html, '{_ANCHOR_SQL}') AS gaps FROM cards),
e AS (SELECT page_id, url, html, CAST(i - 1 AS INTEGER) AS idx, ms[i] AS m,
  1 + list_sum(list_transform(range(1, i + 1), lambda j: length(gaps[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(ms[j]))), 0) AS p
  FROM m, range(1, CAST(len(ms) AS BIGINT) + 1) t(i)),
x AS (SELECT *, regexp_extract(regexp_extract(m, {Q.q(CARD_RE)}, 1), '(?i)href=["'']([^"'']+)["'']', 1) AS href,
  regexp_extract(m, {Q.q(CARD_RE)}, 2) AS inner_html,
  regexp_extract(substr(html, greatest(p - 2500, 1)::BIGINT, (least(p + 2500, length(html) + 1) - greatest(p - 2500, 1))::BIGINT), {Q.q(COMPANY_RE)}, 1) AS chtml FROM e),
o AS (SELECT page_id, idx, {_STRIPPED.replace("{x}", "inner_html")} AS title,
  regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || split_part(href, '?', 1) AS job_url, {_STRIPPED.replace("{x}", "chtml")} AS company
  FROM x WHERE regexp_matches(href, '(?i)/companies/[^/]+/jobs/[^/?#]+'))
SELECT page_id, idx, title, job_url, company FROM o QUALIFY row_number() OVER (PARTITION BY page_id, job_url ORDER BY idx) = 1""")
def src_html_cards(spark, sf):
    """Job cards of listing pages; the company stands in a window around the title anchor."""
    return html_cards(view(spark, sf, "cards"))


# Fixed values (cities and remote work in card texts).
CITY_RE = r"(台北市|新北市|桃園市|台中市|台南市|高雄市|新竹市|新竹縣|遠端|Remote)[^，,。| ]*"


@register("src_rendered_cards", ("cards",), f"""
WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{Q.WS_RE2}+', ' ', 'g')) AS card_text,
  regexp_extract(html, {Q.q(COMPANY_RE)}, 1) AS company_html FROM cards)
SELECT page_id, regexp_extract(card_text, {Q.q(CITY_RE)}, 0) AS location,
  coalesce(nullif(trim(regexp_replace(regexp_replace(company_html, '<[^>]+>', ' ', 'g'), '{Q.WS_RE2}+', ' ', 'g')), ''), '104') AS company FROM c""")
def src_rendered_cards(spark, sf):
    c = view(spark, sf, "cards")
    text = T.collapse_ws(F.regexp_replace("html", "<[^>]+>", " "))
    comp = T.collapse_ws(F.regexp_replace(F.regexp_extract("html", COMPANY_RE, 1), "<[^>]+>", " "))
    return c.select("page_id", F.regexp_extract(text, CITY_RE, 0).alias("location"),
                    F.when(comp != "", comp).otherwise(F.lit("104")).alias("company"))
