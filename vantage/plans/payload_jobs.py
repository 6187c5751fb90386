"""Payload jobs: ATS board JSON, search and posting payloads, job-detail documents, source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators import postings as P
from ..operators import scan as SC
from ..sources.bindings import _view, view
from . import sqlrules as Q
from .registry import register

# Search payloads: 1-3 list items per event, alternate key spellings exercised.
_view("spay", ("events",), """
SELECT event_id AS pos, concat('{"data":{"list":[',
  concat('{"jobNo":"', CAST(event_id AS STRING), 'a","jobName":"  ', event_type, '  Engineer ","custName":"Company ', CAST(user_id % 40 AS STRING),
         '","jobAddrNoDesc":"North City"}'),
  CASE WHEN event_id % 3 >= 1 THEN concat(',{"jobno":"', CAST(event_id AS STRING), 'b","name":"', event_type, ' Analyst","companyName":"Co ',
         CAST(user_id % 7 AS STRING), '","location":"East Town","link":{"job":"https://www.104.com.tw/job/', CAST(event_id AS STRING), 'b?src=x"}}') ELSE '' END,
  CASE WHEN event_id % 3 = 2 THEN ',{"name":"Untitled"}' ELSE '' END,
  ']}}') AS json
FROM events
""")

# Rich posting payloads (one job per event).
_view("ppay", ("events",), """
SELECT event_id AS pos, concat('{"jobNo":', CASE WHEN event_id % 17 = 0 THEN '""' ELSE concat('"', CAST(event_id AS STRING), '"') END,
  ',"jobName":"', event_type, ' Engineer","custName":"Company ', CAST(user_id % 40 AS STRING), '","jobAddrNoDesc":"', split_part('West Town|East  Town|', '|', CAST(user_id % 3 AS INT) + 1), '",',
  '"link":{"job":', CASE WHEN event_id % 2 = 0 THEN concat('"https://www.104.com.tw/job/', CAST(event_id AS STRING), '?jobsource=s"') ELSE '""' END, '},',
  '"pcSkills":[{"description":"', split_part('Python|Scala|', '|', CAST(event_id % 3 AS INT) + 1), '"},{"description":""},{"description":"SQL"}],"optionEdu":[', CAST(1 + event_id % 6 AS STRING), ',9],',
  '"remoteWorkType":', CAST(event_id % 3 AS STRING), ',"salaryLow":', CAST((event_id % 4) * 10000 AS STRING), ',"salaryHigh":', CAST((event_id % 3) * 20000 AS STRING),
  ',"appearDate":"2024', lpad(CAST(1 + event_id % 12 AS STRING), 2, '0'), lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '","employeeCount":', CAST(event_id % 700 AS STRING), '}') AS json
FROM events
""")


def pay(spark, sf) -> DataFrame:
    return view(spark, sf, "pay")


GH = Ty.StructType([Ty.StructField("jobs", Ty.ArrayType(Ty.StructType([
    Ty.StructField("title", Ty.StringType()), Ty.StructField("absolute_url", Ty.StringType()),
    Ty.StructField("location", Ty.StructType([Ty.StructField("name", Ty.StringType())]))])))])
ASHBY = Ty.StructType([Ty.StructField("jobs", Ty.ArrayType(Ty.StructType([
    Ty.StructField("title", Ty.StringType()), Ty.StructField("jobUrl", Ty.StringType()),
    Ty.StructField("location", Ty.StringType())])))])
LEVER = Ty.ArrayType(Ty.StructType([
    Ty.StructField("text", Ty.StringType()), Ty.StructField("hostedUrl", Ty.StringType()),
    Ty.StructField("applyUrl", Ty.StringType()),
    Ty.StructField("categories", Ty.StructType([Ty.StructField("location", Ty.StringType())]))]))


def _nz(c):
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def ats_greenhouse(df: DataFrame) -> DataFrame:
    j = df.where(F.col("ats") == "greenhouse").select("pos", "company", F.from_json("json", GH).alias("j"))
    e = j.select("pos", "company", F.posexplode(F.coalesce("j.jobs", F.array())).alias("idx", "x"))
    return e.select("pos", "idx", T.collapse_ws(F.coalesce("x.title", F.lit(""))).alias("title"),
                    F.coalesce(_nz(F.col("x.absolute_url")), F.lit("")).alias("url"), "company",
                    T.collapse_ws(F.coalesce("x.location.name", F.lit(""))).alias("location"))


def ats_ashby(df: DataFrame) -> DataFrame:
    j = df.where(F.col("ats") == "ashby").select("pos", "company", F.from_json("json", ASHBY).alias("j"))
    e = j.select("pos", "company", F.posexplode(F.coalesce("j.jobs", F.array())).alias("idx", "x"))
    return e.select("pos", "idx", T.collapse_ws(F.coalesce("x.title", F.lit(""))).alias("title"),
                    F.coalesce(_nz(F.col("x.jobUrl")), F.lit("")).alias("url"), "company",
                    T.collapse_ws(F.coalesce("x.location", F.lit(""))).alias("location"))


def ats_lever(df: DataFrame) -> DataFrame:
    is_arr = F.col("json").rlike(r"^\s*\[")
    j = df.where((F.col("ats") == "lever") & is_arr).select("pos", "company", F.from_json("json", LEVER).alias("j"))
    e = j.select("pos", "company", F.posexplode(F.coalesce("j", F.array())).alias("idx", "x"))
    return e.select("pos", "idx", T.collapse_ws(F.coalesce("x.text", F.lit(""))).alias("title"),
                    F.coalesce(_nz(F.col("x.hostedUrl")), _nz(F.col("x.applyUrl")), F.lit("")).alias("url"), "company",
                    T.collapse_ws(F.coalesce("x.categories.location", F.lit(""))).alias("location"))


# Registry of payload parsers by ATS type (the reference's extension point).
PARSERS = {"greenhouse": ats_greenhouse, "ashby": ats_ashby, "lever": ats_lever}


def _norm(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '{Q.WS_RE2}+', ' ', 'g'))"


_GH_SQL = f"""gh AS (SELECT pos, company, from_json(json, '{{"jobs":[{{"title":"VARCHAR","absolute_url":"VARCHAR","location":{{"name":"VARCHAR"}}}}]}}').jobs AS l
  FROM pay WHERE ats = 'greenhouse'),
ghx AS (SELECT pos, CAST(i - 1 AS INTEGER) AS idx, {_norm('l[i].title')} AS title, coalesce(nullif(l[i].absolute_url, ''), '') AS url, company,
  {_norm('l[i].location.name')} AS location FROM gh, range(1, CAST(coalesce(len(l), 0) AS BIGINT) + 1) t(i))"""
_ASH_SQL = f"""ash AS (SELECT pos, company, from_json(json, '{{"jobs":[{{"title":"VARCHAR","jobUrl":"VARCHAR","location":"VARCHAR"}}]}}').jobs AS l
  FROM pay WHERE ats = 'ashby'),
ashx AS (SELECT pos, CAST(i - 1 AS INTEGER) AS idx, {_norm('l[i].title')} AS title, coalesce(nullif(l[i].jobUrl, ''), '') AS url, company,
  {_norm('l[i].location')} AS location FROM ash, range(1, CAST(coalesce(len(l), 0) AS BIGINT) + 1) t(i))"""
_LEV_SQL = f"""lev AS (SELECT pos, company, from_json(json, '[{{"text":"VARCHAR","hostedUrl":"VARCHAR","applyUrl":"VARCHAR","categories":{{"location":"VARCHAR"}}}}]') AS l
  FROM pay WHERE ats = 'lever' AND regexp_matches(json, '^\\s*\\[')),
levx AS (SELECT pos, CAST(i - 1 AS INTEGER) AS idx, {_norm('l[i].text')} AS title,
  coalesce(nullif(l[i].hostedUrl, ''), nullif(l[i].applyUrl, ''), '') AS url, company, {_norm('l[i].categories.location')} AS location
  FROM lev, range(1, CAST(coalesce(len(l), 0) AS BIGINT) + 1) t(i))"""


@register("src_ats_greenhouse", ("pay",), f"WITH {_GH_SQL} SELECT * FROM ghx")
def src_ats_greenhouse(spark, sf):
    return ats_greenhouse(pay(spark, sf))


@register("src_ats_ashby", ("pay",), f"WITH {_ASH_SQL} SELECT * FROM ashx")
def src_ats_ashby(spark, sf):
    return ats_ashby(pay(spark, sf))


@register("src_ats_lever", ("pay",), f"WITH {_LEV_SQL} SELECT * FROM levx")
def src_ats_lever(spark, sf):
    return ats_lever(pay(spark, sf))


@register("set_unify_sources", ("pay",), f"""WITH {_GH_SQL}, {_ASH_SQL}, {_LEV_SQL}
SELECT 'greenhouse' AS source, * FROM ghx UNION ALL SELECT 'ashby', * FROM ashx UNION ALL SELECT 'lever', * FROM levx""")
def set_unify_sources(spark, sf):
    p = pay(spark, sf)
    out = None
    for name, fn in PARSERS.items():
        part = fn(p).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


SEARCH = Ty.StructType([Ty.StructField("data", Ty.StructType([Ty.StructField("list", Ty.ArrayType(Ty.StructType([
    Ty.StructField("jobNo", Ty.StringType()),
    Ty.StructField("jobName", Ty.StringType()), Ty.StructField("name", Ty.StringType()),
    Ty.StructField("custName", Ty.StringType()), Ty.StructField("companyName", Ty.StringType()),
    Ty.StructField("jobAddrNoDesc", Ty.StringType()), Ty.StructField("location", Ty.StringType()),
    Ty.StructField("link", Ty.StructType([Ty.StructField("job", Ty.StringType())]))])))]))])
# Spark resolves field names case-insensitively, so the lower-case spelling is parsed on its own.
SEARCH_LOWER = Ty.StructType([Ty.StructField("data", Ty.StructType([Ty.StructField("list", Ty.ArrayType(
    Ty.StructType([Ty.StructField("jobno", Ty.StringType())])))]))])


@register("src_search_payload", ("spay",), f"""
WITH s AS (SELECT pos, json, CAST(coalesce(json_array_length(json, '$.data.list'), 0) AS BIGINT) AS n FROM spay),
x AS (SELECT pos, CAST(i - 1 AS INTEGER) AS idx, json_extract(json, '$.data.list[' || CAST(i - 1 AS VARCHAR) || ']') AS j
      FROM s, range(1, n + 1) t(i)),
y AS (SELECT pos, idx, json_extract_string(j, '$.jobNo') AS jobNo, json_extract_string(j, '$.jobno') AS jobno,
  json_extract_string(j, '$.jobName') AS jobName, json_extract_string(j, '$.name') AS name,
  json_extract_string(j, '$.custName') AS custName, json_extract_string(j, '$.companyName') AS companyName,
  json_extract_string(j, '$.jobAddrNoDesc') AS addr, json_extract_string(j, '$.location') AS location,
  json_extract_string(j, '$.link.job') AS link FROM x)
SELECT pos, idx, {_norm("coalesce(nullif(jobName, ''), name)")} AS title,
  coalesce(nullif(link, ''), CASE WHEN coalesce(nullif(jobNo, ''), nullif(jobno, ''), nullif(link, ''), '') <> ''
    THEN 'https://www.104.com.tw/job/' || coalesce(nullif(jobNo, ''), nullif(jobno, ''), nullif(link, '')) ELSE '' END) AS url,
  {_norm("coalesce(nullif(custName, ''), companyName)")} AS company,
  {_norm("coalesce(nullif(addr, ''), location)")} AS location FROM y""")
def src_search_payload(spark, sf):
    s = view(spark, sf, "spay").select("pos", F.from_json("json", SEARCH).alias("j"),
                                       F.from_json("json", SEARCH_LOWER)["data"]["list"].alias("lo"))
    e = s.select("pos", "lo", F.posexplode(F.coalesce("j.data.list", F.array())).alias("idx", "j"))
    lower_no = F.get(F.col("lo"), F.col("idx"))["jobno"]
    job_no = F.coalesce(_nz(F.col("j.jobNo")), _nz(lower_no), _nz(F.col("j.link.job")))
    url = F.coalesce(_nz(F.col("j.link.job")),
                     F.when(job_no.isNotNull(), F.concat(F.lit("https://www.104.com.tw/job/"), job_no)), F.lit(""))
    return e.select("pos", "idx",
                    T.collapse_ws(F.coalesce(_nz(F.col("j.jobName")), F.col("j.name"), F.lit(""))).alias("title"),
                    url.alias("url"),
                    T.collapse_ws(F.coalesce(_nz(F.col("j.custName")), F.col("j.companyName"), F.lit(""))).alias("company"),
                    T.collapse_ws(F.coalesce(_nz(F.col("j.jobAddrNoDesc")), F.col("j.location"), F.lit(""))).alias("location"))


POSTING = Ty.StructType([
    Ty.StructField("jobNo", Ty.StringType()), Ty.StructField("jobName", Ty.StringType()),
    Ty.StructField("custName", Ty.StringType()), Ty.StructField("jobAddrNoDesc", Ty.StringType()),
    Ty.StructField("link", Ty.StructType([Ty.StructField("job", Ty.StringType())])),
    Ty.StructField("pcSkills", Ty.ArrayType(Ty.StructType([Ty.StructField("description", Ty.StringType())]))),
    Ty.StructField("optionEdu", Ty.ArrayType(Ty.LongType())),
    Ty.StructField("remoteWorkType", Ty.LongType()), Ty.StructField("salaryDesc", Ty.StringType()),
    Ty.StructField("salaryLow", Ty.LongType()), Ty.StructField("salaryHigh", Ty.LongType()),
    Ty.StructField("appearDate", Ty.StringType()), Ty.StructField("employeeCount", Ty.LongType()),
])


@register("src_posting_payload", ("ppay",), f"""
WITH s AS (SELECT pos, from_json(json, '{{"jobNo":"VARCHAR","jobName":"VARCHAR","custName":"VARCHAR","jobAddrNoDesc":"VARCHAR","link":{{"job":"VARCHAR"}},"pcSkills":[{{"description":"VARCHAR"}}],"optionEdu":["BIGINT"],"remoteWorkType":"BIGINT","salaryDesc":"VARCHAR","salaryLow":"BIGINT","salaryHigh":"BIGINT","appearDate":"VARCHAR","employeeCount":"BIGINT"}}') AS j FROM ppay),
u AS (SELECT pos, j, coalesce(j.jobNo, '') AS job_no,
  CASE WHEN starts_with(coalesce(j.link.job, ''), 'http') THEN split_part(j.link.job, '?', 1)
       WHEN coalesce(j.jobNo, '') <> '' THEN 'https://www.104.com.tw/job/' || j.jobNo ELSE '' END AS url FROM s)
SELECT pos, job_no, url, {_norm('j.jobName')} AS title, {_norm('j.custName')} AS company, {_norm('j.jobAddrNoDesc')} AS location,
  array_to_string(list_filter(list_transform(j.pcSkills, lambda x: x.description), lambda x: coalesce(x, '') <> ''), ',') AS skills,
  array_to_string(list_filter(list_transform(j.optionEdu, lambda e: CASE e WHEN 1 THEN '高中' WHEN 2 THEN '專科' WHEN 3 THEN '大學'
    WHEN 4 THEN '碩士' WHEN 5 THEN '博士' WHEN 6 THEN '不拘' END), lambda x: x IS NOT NULL), ',') AS edu,
  CASE coalesce(j.remoteWorkType, 0) WHEN 1 THEN '混合遠端' WHEN 2 THEN '完全遠端' ELSE '' END AS remote_label,
  CASE WHEN coalesce(j.salaryLow, 0) <> 0 AND coalesce(j.salaryHigh, 0) <> 0 THEN format('{{:,}}', j.salaryLow) || '~' || format('{{:,}}', j.salaryHigh)
       WHEN coalesce(j.salaryLow, 0) <> 0 THEN format('{{:,}}', j.salaryLow) || ' 以上' ELSE '面議' END AS salary,
  CASE WHEN length(coalesce(j.appearDate, '')) = 8 THEN substr(j.appearDate, 1, 4) || '-' || substr(j.appearDate, 5, 2) || '-' || substr(j.appearDate, 7, 2)
       ELSE coalesce(j.appearDate, '') END AS appear_date
FROM u WHERE url <> '' AND job_no <> ''""")
def src_posting_payload(spark, sf):
    s = view(spark, sf, "ppay").select("pos", F.from_json("json", POSTING).alias("j"))
    job_no = F.coalesce(F.col("j.jobNo"), F.lit(""))
    link = F.coalesce(F.col("j.link.job"), F.lit(""))
    url = (F.when(link.startswith("http"), F.split(link, r"\?", 2).getItem(0))
           .when(job_no != "", F.concat(F.lit("https://www.104.com.tw/job/"), job_no)).otherwise(F.lit("")))
    skills = F.filter(F.transform(F.coalesce("j.pcSkills", F.array()), lambda x: x["description"]),
                      lambda x: F.coalesce(x, F.lit("")) != "")
    out = s.select(
        "pos", job_no.alias("job_no"), url.alias("url"), T.collapse_ws(F.coalesce("j.jobName", F.lit(""))).alias("title"),
        T.collapse_ws(F.coalesce("j.custName", F.lit(""))).alias("company"),
        T.collapse_ws(F.coalesce("j.jobAddrNoDesc", F.lit(""))).alias("location"),
        F.array_join(skills, ",").alias("skills"),
        F.array_join(P.edu_labels(F.coalesce("j.optionEdu", F.array())), ",").alias("edu"),
        P.remote_label(F.coalesce("j.remoteWorkType", F.lit(0))).alias("remote_label"),
        P.format_salary(F.col("j.salaryDesc"), F.col("j.salaryLow"), F.col("j.salaryHigh")).alias("salary"),
        P.format_date8(F.coalesce("j.appearDate", F.lit(""))).alias("appear_date"))
    return out.where((F.col("url") != "") & (F.col("job_no") != ""))


@register("txt_job_id", ("post",), """
SELECT pos, nullif(regexp_extract('https://www.104.com.tw/job/' || job_no || '?x=1', '104\\.com\\.tw/job/([a-zA-Z0-9]+)', 1), '') AS job_id FROM post""")
def txt_job_id(spark, sf):
    u = F.concat(F.lit("https://www.104.com.tw/job/"), F.col("job_no"), F.lit("?x=1"))
    m = F.regexp_extract(u, r"104\.com\.tw/job/([a-zA-Z0-9]+)", 1)
    return view(spark, sf, "post").select("pos", F.when(m != "", m).alias("job_id"))


@register("cls_ats_endpoint", ("customer",), """
WITH c AS (SELECT c_custkey AS pos,
  CASE WHEN c_custkey % 5 = 0 THEN 'https://boards-api.greenhouse.io/v1/boards/c' || CAST(c_custkey AS VARCHAR) || '/jobs' END AS api,
  CASE c_custkey % 4 WHEN 0 THEN 'https://jobs.ashbyhq.com/c' || CAST(c_custkey AS VARCHAR) || '/roles'
    WHEN 1 THEN 'https://jobs.lever.co/c' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'https://job-boards.eu.greenhouse.io/c' || CAST(c_custkey AS VARCHAR) || '?x=1'
    ELSE 'https://example.com/careers' END AS careers FROM customer)
SELECT pos,
  CASE WHEN strpos(coalesce(api, ''), 'greenhouse') > 0 THEN 'greenhouse' WHEN regexp_extract(careers, 'jobs\\.ashbyhq\\.com/([^/?#]+)', 1) <> '' THEN 'ashby'
       WHEN regexp_extract(careers, 'jobs\\.lever\\.co/([^/?#]+)', 1) <> '' THEN 'lever'
       WHEN regexp_extract(careers, 'job-boards(?:\\.eu)?\\.greenhouse\\.io/([^/?#]+)', 1) <> '' THEN 'greenhouse' END AS type,
  CASE WHEN strpos(coalesce(api, ''), 'greenhouse') > 0 THEN api
       WHEN regexp_extract(careers, 'jobs\\.ashbyhq\\.com/([^/?#]+)', 1) <> '' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || regexp_extract(careers, 'jobs\\.ashbyhq\\.com/([^/?#]+)', 1) || '?includeCompensation=true'
       WHEN regexp_extract(careers, 'jobs\\.lever\\.co/([^/?#]+)', 1) <> '' THEN 'https://api.lever.co/v0/postings/' || regexp_extract(careers, 'jobs\\.lever\\.co/([^/?#]+)', 1)
       WHEN regexp_extract(careers, 'job-boards(?:\\.eu)?\\.greenhouse\\.io/([^/?#]+)', 1) <> '' THEN 'https://boards-api.greenhouse.io/v1/boards/' || regexp_extract(careers, 'job-boards(?:\\.eu)?\\.greenhouse\\.io/([^/?#]+)', 1) || '/jobs' END AS api_url
FROM c""")
def cls_ats_endpoint(spark, sf):
    c = view(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    api = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/c"), k, F.lit("/jobs")))
    careers = (F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://jobs.ashbyhq.com/c"), k, F.lit("/roles")))
               .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://jobs.lever.co/c"), k))
               .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("https://job-boards.eu.greenhouse.io/c"), k, F.lit("?x=1")))
               .otherwise(F.lit("https://example.com/careers")))
    e = SC.ats_endpoint(api, careers)
    return c.select(F.col("c_custkey").alias("pos"), e["type"].alias("type"), e["api_url"].alias("api_url"))
