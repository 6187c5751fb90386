"""Document jobs: lint, required fields, structure, deny-list, paths, phrases, urls, archetypes, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as DO
from ..session import once
from ..sources.bindings import AS_OF_EVENTS, _view, view
from . import sqlrules as Q
from .registry import register

# Documents with an evaluation summary block and worker-log lines appended (the ``docs*`` view).
_view("docx", ("documents",), """
SELECT doc_id, concat(text,
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '---SCORE_SUMMARY---', chr(10), 'COMPANY: Company ', CAST(doc_id % 40 AS STRING), chr(10),
    'ROLE: ', lang, ' writer', chr(10), 'SCORE: ', CAST(doc_id % 5 AS STRING), '.', CAST(doc_id % 10 AS STRING), chr(10),
    'ARCHETYPE: ', source, chr(10),
    CASE WHEN doc_id % 2 = 0 THEN 'LEGITIMACY: High Confidence' ELSE '' END, chr(10), '---END_SUMMARY---') ELSE '' END,
  CASE WHEN doc_id % 4 = 1 THEN concat(chr(10), 'worker start', chr(10), '{"score": ', CAST(doc_id % 5 AS STRING), '.5, "note": "x", "score": 9}',
    chr(10), 'done') ELSE '' END) AS text
FROM documents
""")

# Documents with lint findings, paths, phrases, urls, role signals and structure pieces appended.
_view("dmix", ("documents",), """
SELECT doc_id, source, concat(text,
  CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), 'It took ', CAST(10 + doc_id % 90 AS STRING), '+ hours and 300 tests', chr(10), '# 45 evals', chr(10), 'NEVER hardcode 20 layers') ELSE '' END,
  CASE WHEN doc_id % 7 = 1 THEN concat(chr(10), 'saved in ', split_part('/Users/jane/notes|/home/joe/notes', '|', CAST(doc_id % 2 AS INT) + 1), CAST(doc_id AS STRING)) ELSE '' END,
  CASE WHEN doc_id % 6 = 2 THEN concat(chr(10), 'A ', split_part('Robust|seamless|cutting-edge and INNOVATIVE|spearheaded', '|', CAST(doc_id % 4 AS INT) + 1), ' plan') ELSE '' END,
  CASE WHEN doc_id % 4 = 3 THEN concat(chr(10), 'See https://a.example.com/x?y=', CAST(doc_id AS STRING), ', www.site.example.org/z. and https://www.104.com.tw/job/1') ELSE '' END,
  CASE WHEN doc_id % 9 = 4 THEN concat(chr(10), 'React and Vue dashboard, ', split_part('crypto|cloud observability|roadmap|analytics products', '|', CAST(doc_id % 4 AS INT) + 1)) ELSE '' END,
  CASE WHEN doc_id % 8 = 5 THEN concat(chr(10), split_part('責任制|面議|派遣 駐點', '|', CAST(doc_id % 3 AS INT) + 1)) ELSE '' END,
  CASE WHEN doc_id % 3 = 1 THEN concat(chr(10), 'full_name: x', CASE WHEN doc_id % 2 = 0 THEN ' email: y' ELSE '' END, CASE WHEN doc_id % 12 = 4 THEN ' location: z' ELSE '' END) ELSE '' END,
  CASE WHEN doc_id % 10 = 6 THEN concat(chr(10), chr(92), 'section{Education}', chr(10), chr(92), 'begin{document}', chr(10), chr(92), 'resumeItem{a} {{NAME}}', chr(10),
    CASE WHEN doc_id % 20 = 6 THEN concat(chr(92), 'resumeSubheading{b} {{CITY}} {{NAME}}', chr(10), chr(92), 'resumeItem{c}') ELSE '' END) ELSE '' END) AS text
FROM documents
""")

# Deny-list patterns: every benchmark line (benchmark passages leak into documents).
_BPAT_SQL = """bpat AS (SELECT item_id * 1000 + i AS pattern_id, string_split(text, chr(10))[i] AS pattern
  FROM benchmark, range(1, CAST(len(string_split(text, chr(10))) AS BIGINT) + 1) t(i))"""


def bench_patterns(spark, sf) -> DataFrame:
    b = view(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "pattern"))
    return b.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("pattern_id"), "pattern")


ALLOWED_SOURCES = ["src0"]  # documents exempt from the path check (an allow-list parameter)
HOME_MARKERS = ["/Users/", "/home/"]


def docs(spark, sf) -> DataFrame:
    return view(spark, sf, "dmix")


def _lines_sql(docs: str) -> str:
    return f"""dl AS (SELECT d.doc_id, CAST(i AS INTEGER) AS line_no, string_split(d.text, chr(10))[i] AS line, d.source
  FROM {docs} d, range(1, CAST(len(string_split(d.text, chr(10))) AS BIGINT) + 1) t(i))"""


@register("dq_metric_lint", ("dmix",), f"""WITH {_lines_sql("dmix")}
SELECT doc_id, line_no, regexp_extract(line, {Q.q('(?i)' + DO.METRIC_RE)}, 0) AS match FROM dl
WHERE NOT (strpos(line, 'NEVER hardcode') > 0 OR strpos(line, 'NUNCA hardcode') > 0 OR starts_with(line, '#') OR starts_with(line, '<!--'))
  AND regexp_matches(line, {Q.q('(?i)' + DO.METRIC_RE)})""")
def dq_metric_lint(spark, sf):
    return DO.metric_lint(DO.lines(docs(spark, sf)))


@register("dq_required_fields", ("dmix",), f"""
SELECT doc_id, 'short' AS issue FROM dmix WHERE length(regexp_replace(text, '^{Q.WS_RE2}+|{Q.WS_RE2}+$', '', 'g')) < 100
UNION ALL
SELECT doc_id, 'field:' || CASE WHEN strpos(text, 'full_name') = 0 OR strpos(text, '"Jane Smith"') > 0 THEN 'full_name'
  WHEN strpos(text, 'email') = 0 THEN 'email' ELSE 'location' END FROM dmix
WHERE strpos(text, 'full_name') = 0 OR strpos(text, 'email') = 0 OR strpos(text, 'location') = 0 OR strpos(text, '"Jane Smith"') > 0""")
def dq_required_fields(spark, sf):
    return DO.required_fields(docs(spark, sf))


def _structure_sql():
    miss = " + ".join([f"CASE WHEN regexp_matches(text, {Q.q(p)}) THEN 0 ELSE 1 END" for p in DO.REQUIRED_SECTIONS + DO.REQUIRED_COMMANDS]
                      + [f"CASE WHEN strpos(text, {Q.q(s)}) > 0 THEN 0 ELSE 1 END"
                         for s in ["\\begin{document}", "\\end{document}", "\\pdfgentounicode=1"]])
    return f"""
SELECT doc_id, {miss} AS n_missing,
  array_to_string(list_filter(regexp_extract_all(text, '\\{{\\{{[A-Z_]+\\}}\\}}'), lambda x, i: list_position(regexp_extract_all(text, '\\{{\\{{[A-Z_]+\\}}\\}}'), x) = i), ', ') AS placeholders,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\\\resumeItem\\{{'))) AS resume_items,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\\\resumeSubheading[^C]'))) AS subheadings
FROM dmix"""


@register("dq_document_structure", ("dmix",), _structure_sql())
def dq_document_structure(spark, sf):
    return DO.document_structure(docs(spark, sf))


_DENY_SQL = f"""WITH {_lines_sql("documents")}, {_BPAT_SQL}
SELECT DISTINCT dl.doc_id, dl.line_no, p.pattern_id FROM dl JOIN bpat p ON strpos(dl.line, p.pattern) > 0"""


@register("dq_denylist_scan", ("documents", "benchmark"), _DENY_SQL)
def dq_denylist_scan(spark, sf):
    return DO.denylist_scan(DO.lines(view(spark, sf, "documents")), bench_patterns(spark, sf))


@register("dq_denylist_join", ("documents", "benchmark"), _DENY_SQL)
def dq_denylist_join(spark, sf):
    """The same lines by the join for pattern tables of any size."""
    return DO.denylist_join(DO.lines(view(spark, sf, "documents")), bench_patterns(spark, sf))


@register("dq_absolute_paths", ("dmix",), f"""WITH {_lines_sql("dmix")}
SELECT doc_id, line_no, line AS detail FROM dl
WHERE (strpos(line, '/Users/') > 0 OR strpos(line, '/home/') > 0) AND source NOT IN ('src0')""")
def dq_absolute_paths(spark, sf):
    d = docs(spark, sf).where(~F.col("source").isin(*ALLOWED_SOURCES))
    ln = DO.lines(d)
    hit = F.col("line").contains(HOME_MARKERS[0]) | F.col("line").contains(HOME_MARKERS[1])
    return ln.where(hit).select("doc_id", "line_no", F.col("line").alias("detail"))


@register("dq_banned_phrases", ("dmix",), "SELECT doc_id, phrase FROM dmix, (VALUES "
          + ", ".join(f"({Q.q(p)})" for p in DO.BANNED_PHRASES) + ") v(phrase) WHERE strpos(lower(text), phrase) > 0")
def dq_banned_phrases(spark, sf):
    return DO.banned_phrases(docs(spark, sf))


_URL_RE2 = DO.URL_RE.replace(DO._WS, Q.WS_RE2[1:-1])


@register("txt_urls", ("dmix",), f"""
WITH u AS (SELECT doc_id, regexp_extract_all(text, {Q.q(_URL_RE2)}) AS l FROM dmix),
v AS (SELECT doc_id, list_filter(list_transform(list_transform(l, lambda x: regexp_replace(x, '[.。,，]+$', '')),
        lambda x: CASE WHEN starts_with(x, 'http') THEN x ELSE 'https://' || x END),
        lambda x: strpos(x, '104.com.tw') = 0 AND strpos(x, 'linkedin.com') = 0) AS l FROM u)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, l[i] AS url FROM v, range(1, CAST(len(l) AS BIGINT) + 1) t(i)""")
def txt_urls(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(DO.urls(F.col("text"))).alias("idx", "url"))


def _votes_sql():
    parts = []
    for i, (name, signals) in enumerate(DO.ARCHETYPES):
        pat = "(" + "|".join(r"\b" + DO._re_escape(s.lower()) + r"\b" for s in signals) + ")"
        parts.append(f"SELECT doc_id, {i} AS o, {Q.q(name)} AS archetype, "
                     f"CAST(len(regexp_extract_all(lower(text), {Q.q(pat)})) AS INTEGER) AS votes FROM dmix")
    return ("WITH v AS (" + " UNION ALL ".join(parts) + ")\nSELECT doc_id, CAST(r AS INTEGER) AS rank, archetype, votes FROM ("
            "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, o) AS r FROM v) WHERE r <= 2")


@register("cls_archetype", ("dmix",), _votes_sql())
def cls_archetype(spark, sf):
    low = docs(spark, sf).select("doc_id", once(F.lower("text")).alias("low"))
    v = low.select("doc_id", once(DO.archetype_votes(F.col("low"))).alias("v"))
    top = v.select("doc_id", F.posexplode(F.slice("v", 1, 2)).alias("r", "x"))
    return top.select("doc_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.archetype").alias("archetype"),
                      F.col("x.votes").cast("int").alias("votes"))


@register("cls_risk_phrases", ("dmix",), "SELECT doc_id, phrase FROM dmix, (VALUES "
          + ", ".join(f"({Q.q(p)})" for p in DO.RISK_PHRASES) + ") v(phrase) WHERE strpos(text, phrase) > 0")
def cls_risk_phrases(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(DO.risk_phrases(F.col("text"))).alias("phrase"))


def _summary_sql():
    block = f"regexp_extract(text, {Q.q(DO.SUMMARY_BLOCK)}, 1)"
    cols = []
    for k in DO.SUMMARY_KEYS:
        pat = k + r":\s*(.+)"
        cols.append(f"coalesce(CASE WHEN regexp_matches(text, {Q.q(DO.SUMMARY_BLOCK)}) AND regexp_matches({block}, {Q.q(pat)}) "
                    f"THEN trim(regexp_extract({block}, {Q.q(pat)}, 1)) END, 'unknown') AS {k.lower()}")
    return "SELECT doc_id, " + ", ".join(cols) + " FROM docx"


@register("src_llm_summary", ("docx",), _summary_sql())
def src_llm_summary(spark, sf):
    return view(spark, sf, "docx").select("doc_id", *DO.llm_summary(F.col("text")))


@register("src_log_score", ("docx",), """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls,
  CASE WHEN suffix(text, chr(10)) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS body FROM docx)
SELECT doc_id,
  nullif(regexp_extract(list_filter(ls, lambda x: regexp_matches(x, '"score":[ \\t\\n\\f\\r]*[0-9.]'))[1], '.*"score":[ \\t\\n\\f\\r]*([0-9.]+)', 1), '') AS score,
  array_to_string(body[greatest(len(body) - 4, 1):], ' ') || CASE WHEN suffix(text, chr(10)) THEN ' ' ELSE '' END AS error
FROM l""")
def src_log_score(spark, sf):
    score, err = DO.log_score(F.col("text"))
    return view(spark, sf, "docx").select("doc_id", score.alias("score"), err.alias("error"))


@register("txt_keyword_coverage", ("benchmark", "documents"), """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark),
c AS (SELECT item_id, w, count(*) AS n FROM t GROUP BY ALL),
prof AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents)
SELECT item_id, count(*) AS terms, count(prof.w) AS present, count(prof.w)::DOUBLE / count(*)::DOUBLE AS coverage
FROM c LEFT JOIN prof USING (w) GROUP BY item_id""")
def txt_keyword_coverage(spark, sf):
    """Share of each item's terms that occur in the documents."""
    b = view(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w"))
    prof = view(spark, sf, "documents").select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("w")).distinct() \
        .withColumn("hit", F.lit(1))
    j = b.distinct().join(prof, "w", "left")
    return j.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"), F.count("hit").alias("present")) \
        .withColumn("coverage", F.col("present").cast("double") / F.col("terms").cast("double"))


@register("dat_stale_docs", ("off",), f"""
SELECT pos, date_diff('day', CAST(ts AS DATE), DATE '{AS_OF_EVENTS}') AS age_days,
  date_diff('day', CAST(ts AS DATE), DATE '{AS_OF_EVENTS}') > 30 AS stale FROM off""")
def dat_stale_docs(spark, sf):
    return DO.stale(view(spark, sf, "off"), "pos", "ts", AS_OF_EVENTS)
