"""Queue jobs: state log, eligibility, summary, inbox checklist, queue ids, report numbers, url resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import queue as QU
from ..operators.prefix import running
from ..session import cut_table, once
from ..sources import reports as R
from ..sources.bindings import view
from .registry import register
from .scan_jobs import SPLIT_TS
from .tracker_jobs import dashboard_apps

_LATEST = """latest AS (SELECT id, status, report_num, score, retries, first_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn, min(seq) OVER (PARTITION BY id) AS first_seq FROM qst) WHERE rn = 1)"""


def state(spark, sf) -> DataFrame:
    return QU.latest_state(view(spark, sf, "qst"))


def inputs(spark, sf) -> DataFrame:
    return view(spark, sf, "qin")


@register("upsert_queue_state", ("qst",), f"WITH {_LATEST} SELECT id, status, report_num, score, retries FROM latest")
def upsert_queue_state(spark, sf):
    return state(spark, sf).select("id", "status", "report_num", "score", "retries")


@register("src_state_tsv", ("qst", "qin"), f"""WITH {_LATEST}
SELECT l.id, q.url, l.status, l.report_num, l.score, CASE WHEN l.status = 'failed' THEN 'exit code ' || l.retries END AS error, l.retries FROM latest l LEFT JOIN qin q ON q.id = l.id""")
def src_state_tsv(spark, sf):
    lines = QU.render_state_tsv(state(spark, sf), inputs(spark, sf))
    return QU.src_state_tsv(lines)


@register("flt_queue_eligible", ("qst", "qin"), f"""WITH {_LATEST},
j AS (SELECT q.id, l.status, coalesce(l.retries, 0) AS retries FROM qin q LEFT JOIN latest l ON l.id = q.id WHERE q.id >= 0 AND q.url <> '')
SELECT 'normal' AS mode, id FROM j WHERE NOT coalesce(status = 'completed', FALSE) AND NOT coalesce(status = 'failed' AND retries >= 2, FALSE)
UNION ALL SELECT 'retry', id FROM j WHERE status = 'failed' AND retries < 2""")
def flt_queue_eligible(spark, sf):
    i, s = inputs(spark, sf), state(spark, sf)
    normal = QU.eligible(i, s).select(F.lit("normal").alias("mode"), "id")
    retry = QU.eligible(i, s, retry_failed=True).select(F.lit("retry").alias("mode"), "id")
    return normal.unionByName(retry)


@register("flt_min_score", ("qst",), f"""WITH {_LATEST}
SELECT id, CASE WHEN status = 'completed' AND score < 3.0 THEN 'skipped' ELSE status END AS status,
  CASE WHEN status = 'completed' AND score < 3.0 THEN 'below-min-score' END AS error FROM latest""")
def flt_min_score(spark, sf):
    return QU.min_score_gate(state(spark, sf), 3.0)


@register("agg_queue_summary", ("qst",), f"""WITH {_LATEST}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status NOT IN ('completed', 'failed') OR status IS NULL) AS pending,
  CASE WHEN count(score) FILTER (WHERE status = 'completed') > 0 THEN
    floor(sum(CAST(round(score * 10) AS BIGINT)) FILTER (WHERE status = 'completed') / count(score) FILTER (WHERE status = 'completed')) / 10.0 END AS avg_score
FROM latest""")
def agg_queue_summary(spark, sf):
    return QU.queue_summary(state(spark, sf))


@register("join_queue_notes", ("qin",), """
SELECT id, trim(regexp_extract(split_part(notes, ' | ', 1), '^(.*) @ ', 1)) AS role,
  trim(regexp_extract(split_part(notes, ' | ', 1), '^.* @ (.*)$', 1)) AS company,
  CASE WHEN starts_with(trim(regexp_extract(notes, '.*\\| (.*)$', 1)), 'http') THEN trim(regexp_extract(notes, '.*\\| (.*)$', 1))
       WHEN starts_with(url, 'http') THEN url END AS job_url FROM qin""")
def join_queue_notes(spark, sf):
    q = inputs(spark, sf)
    role, company, u = QU.notes_parts(F.col("notes"), F.col("url"))
    return q.select("id", role.alias("role"), company.alias("company"), u.alias("job_url"))


# --- inbox checklist -------------------------------------------------------------------

CHECK_RE = r"^- \[([ x!])\] (https?://[^ \t\n\f\r]+)(.*)$"


def checklist(spark, sf) -> DataFrame:
    """src_checklist: state, url, company, title, location, date and the enclosing section."""
    lines = view(spark, sf, "inbox")
    head = F.when(F.col("line").startswith("## "), F.trim(F.substr(F.col("line"), F.lit(4))))
    with_sec = running(lines.withColumn("_h", head), ["line_no"], [("section", F.col("_h"), "last")], ["file"])
    parts = F.split(F.col("line"), r" \| ", -1)
    items = with_sec.where(F.col("line").rlike(CHECK_RE))
    return items.select(
        "file", "line_no", "section",
        F.regexp_extract("line", CHECK_RE, 1).alias("state"),
        F.regexp_extract("line", CHECK_RE, 2).alias("url"),
        T.js_trim(F.get(parts, 1)).alias("company"),
        T.js_trim(F.get(parts, 2)).alias("title"),
        T.js_trim(F.get(parts, 3)).alias("location"),
        T.js_trim(F.get(parts, 4)).alias("date"),
    )


_CHECK_SQL = """
hdr AS (SELECT line_no, trim(substr(line, 4)) AS section FROM inbox WHERE starts_with(line, '## ')),
items AS (SELECT i.file, i.line_no, (SELECT h.section FROM hdr h WHERE h.line_no <= i.line_no ORDER BY h.line_no DESC LIMIT 1) AS section,
  regexp_extract(i.line, '^- \\[([ x!])\\] (https?://[^ \\t\\n\\f\\r]+)(.*)$', 1) AS state,
  regexp_extract(i.line, '^- \\[([ x!])\\] (https?://[^ \\t\\n\\f\\r]+)(.*)$', 2) AS url,
  trim(string_split(i.line, ' | ')[2]) AS company, trim(string_split(i.line, ' | ')[3]) AS title,
  trim(string_split(i.line, ' | ')[4]) AS location, trim(string_split(i.line, ' | ')[5]) AS date
  FROM inbox i WHERE regexp_matches(i.line, '^- \\[([ x!])\\] (https?://[^ \\t\\n\\f\\r]+)(.*)$')),
pending AS (SELECT line_no, regexp_extract(line, '^- \\[ \\] (https?://\\S+)\\s*\\|\\s*([^|]+)\\|', 1) AS url,
  trim(regexp_extract(line, '^- \\[ \\] (https?://\\S+)\\s*\\|\\s*([^|]+)\\|', 2)) AS company
  FROM inbox WHERE regexp_matches(line, '^- \\[ \\] (https?://\\S+)\\s*\\|\\s*([^|]+)\\|'))"""


@register("src_checklist", ("inbox",), f"WITH {_CHECK_SQL} SELECT * FROM items")
def src_checklist(spark, sf):
    return checklist(spark, sf)


PENDING_RE = r"^- \[ \] (https?://[^ \t\n\f\r]+)[ \t\n\f\r]*\|[ \t\n\f\r]*([^|]+)\|"


def pending(spark, sf) -> DataFrame:
    lines = view(spark, sf, "inbox").where(F.col("line").rlike(PENDING_RE))
    return lines.select("line_no", F.regexp_extract("line", PENDING_RE, 1).alias("url"),
                        T.js_trim(F.regexp_extract("line", PENDING_RE, 2)).alias("company"))


def queue_candidates(spark, sf) -> DataFrame:
    """join_pending_queue: pending inbox items minus completed urls minus already-queued urls."""
    s = state(spark, sf).where(F.col("status") == "completed").join(inputs(spark, sf).select("id", "url"), "id")
    p = pending(spark, sf)
    return p.join(s.select("url"), "url", "left_anti").join(inputs(spark, sf).select("url"), "url", "left_anti")


_QUEUE_SQL = f"""{_LATEST},
{_CHECK_SQL.strip()},
done AS (SELECT q.url FROM latest l JOIN qin q ON q.id = l.id WHERE l.status = 'completed'),
cand AS (SELECT * FROM pending WHERE url NOT IN (SELECT url FROM done) AND url NOT IN (SELECT url FROM qin))"""


@register("join_pending_queue", ("inbox", "qst", "qin"), f"WITH {_QUEUE_SQL} SELECT line_no, url, company FROM cand")
def join_pending_queue(spark, sf):
    return queue_candidates(spark, sf).select("line_no", "url", "company")


@register("win_queue_ids", ("inbox", "qst", "qin"), f"""WITH {_QUEUE_SQL}
SELECT url, greatest((SELECT max(id) FROM qin), (SELECT max(id) FROM qst)) + row_number() OVER (ORDER BY line_no) AS id FROM cand""")
def win_queue_ids(spark, sf):
    existing = inputs(spark, sf).select("id").unionByName(view(spark, sf, "qst").select("id"))
    return QU.next_ids(queue_candidates(spark, sf), "line_no", existing).select("url", "id")


@register("set_pending_companies", ("inbox",), f"WITH {_CHECK_SQL} SELECT company, min(line_no) AS first_line FROM pending GROUP BY company")
def set_pending_companies(spark, sf):
    return pending(spark, sf).groupBy("company").agg(F.min("line_no").alias("first_line"))


@register("upsert_inbox", ("inbox_old", "off"), f"""WITH
ex AS (SELECT regexp_extract(line, '^- \\[ \\] (https?://\\S+)', 1) AS url, line, line_no FROM inbox_old WHERE regexp_matches(line, '^- \\[ \\] (https?://\\S+)')),
nw AS (SELECT url, '- [ ] ' || url || ' | ' || company || ' | ' || title || ' |  | ' || strftime(seen_date, '%Y-%m-%d') AS line, pos FROM off
       WHERE ts >= TIMESTAMP '{SPLIT_TS}'),
u AS (SELECT url, line, 1 AS pri, pos AS o FROM nw UNION ALL SELECT url, line, 0, line_no FROM ex)
SELECT url, line FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pri DESC, o DESC) AS rn FROM u) WHERE rn = 1""")
def upsert_inbox(spark, sf):
    ex_re = r"^- \[ \] (https?://[^ \t\n\f\r]+)"
    lines = view(spark, sf, "inbox_old").where(F.col("line").rlike(ex_re))
    ex = lines.select(F.regexp_extract("line", ex_re, 1).alias("url"), "line", F.lit(0).alias("pri"),
                      F.col("line_no").alias("o"))
    o = view(spark, sf, "off").where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp"))
    nw = o.select("url", F.concat(F.lit("- [ ] "), "url", F.lit(" | "), "company", F.lit(" | "), "title", F.lit(" |  | "),
                                  F.date_format("seen_date", "yyyy-MM-dd")).alias("line"), F.lit(1).alias("pri"),
                  F.col("pos").alias("o"))
    u = ex.unionByName(nw)
    best = u.groupBy("url").agg(F.max_by("line", F.struct("pri", "o")).alias("line"))
    return best


@register("win_next_report", ("rep", "qst"), f"""WITH {_LATEST}
SELECT lpad(CAST(greatest(
  coalesce((SELECT max(TRY_CAST(nullif(regexp_extract(regexp_extract(path, '[^/]*$', 0), '^([0-9]+)', 1), '') AS BIGINT)) FROM rep), 0),
  coalesce((SELECT max(TRY_CAST(report_num AS BIGINT)) FROM latest WHERE report_num <> '-' AND report_num <> ''), 0)) + 1 AS VARCHAR), 3, '0') AS next_report""")
def win_next_report(spark, sf):
    files = view(spark, sf, "rep").select(
        F.regexp_extract(F.regexp_extract("path", r"[^/]*$", 0), r"^([0-9]+)", 1).try_cast("long").alias("n"))
    st = state(spark, sf).where((F.col("report_num") != "-") & (F.col("report_num") != "")) \
        .select(F.col("report_num").try_cast("long").alias("n"))
    m = files.unionByName(st).agg(F.coalesce(F.max("n"), F.lit(0)).alias("m"))
    return m.select(F.lpad((F.col("m") + 1).cast("string"), 3, "0").alias("next_report"))


# --- job url resolution --------------------------------------------------------------------

def _company_suffix_sql(x):
    from .sqlrules import company_key_suffix
    return company_key_suffix(x)


def _best_role_sql(apps: str, cands: str) -> str:
    return f"""
roles AS (SELECT ckey, lower(cand_role) AS crole, arg_min(url, cand_pos) AS url, min(cand_pos) AS first_pos FROM {cands} GROUP BY ALL),
words AS (SELECT pos, ckey, w FROM (SELECT pos, ckey, unnest(string_split_regex(lower(trim(role)), '\\s+')) AS w FROM {apps}) WHERE strlen(w) > 2),
hits AS (SELECT words.pos, roles.ckey, roles.crole, count(*) AS score FROM words JOIN roles ON roles.ckey = words.ckey
         WHERE strpos(roles.crole, words.w) > 0 GROUP BY ALL),
scored AS (SELECT a.pos, r.url, r.first_pos, coalesce(h.score, 0) AS score FROM {apps} a JOIN roles r ON r.ckey = a.ckey
           LEFT JOIN hits h ON h.pos = a.pos AND h.crole = r.crole AND h.ckey = r.ckey),
best AS (SELECT pos, url, score FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, first_pos) AS rn FROM scored) WHERE rn = 1)"""


_APPS_SQL = f"""apps AS (SELECT pos, role, {_company_suffix_sql('company')} AS ckey FROM trk),
qc AS (SELECT {_company_suffix_sql("trim(regexp_extract(split_part(notes, ' | ', 1), '^.* @ (.*)$', 1))")} AS ckey,
  trim(regexp_extract(split_part(notes, ' | ', 1), '^(.*) @ ', 1)) AS cand_role,
  CASE WHEN starts_with(trim(regexp_extract(notes, '.*\\| (.*)$', 1)), 'http') THEN trim(regexp_extract(notes, '.*\\| (.*)$', 1))
       WHEN starts_with(url, 'http') THEN url END AS url, id AS cand_pos FROM qin WHERE strpos(split_part(notes, ' | ', 1), ' @ ') > 0)"""


def queue_candidates_by_company(spark, sf) -> DataFrame:
    q = inputs(spark, sf)
    role, company, u = QU.notes_parts(F.col("notes"), F.col("url"))
    parts = q.select("id", "url", once(F.col("notes")).alias("notes")).select(
        F.col("id").alias("cand_pos"), once(F.struct(role.alias("cand_role"), company.alias("company"), u.alias("url"))).alias("p"))
    return parts.where("p.cand_role is not null and p.url is not null").select(
        T.company_key_suffix("p.company").alias("ckey"), "p.cand_role", "p.url", "cand_pos")


@register("join_best_role", ("trk", "qin"), f"WITH {_APPS_SQL}, {_best_role_sql('apps', 'qc').strip()} SELECT pos, url, score FROM best")
def join_best_role(spark, sf):
    apps = dashboard_apps(spark, sf).select("pos", "role", T.company_key_suffix("company").alias("ckey"))
    return QU.best_role(apps, queue_candidates_by_company(spark, sf)).select("pos", "url", F.col("score").cast("long"))


@register("join_job_url", ("trk", "rep", "qin", "qst", "off"), f"""WITH {_LATEST}, {_APPS_SQL},
hdr AS (SELECT path, CASE WHEN regexp_matches(text, '(?m)^\\*\\*URL:\\*\\*\\s*(https?://\\S+)') THEN regexp_extract(text, '(?m)^\\*\\*URL:\\*\\*\\s*(https?://\\S+)', 1) END AS url,
  CASE WHEN regexp_matches(text, '(?m)^\\*\\*Batch ID:\\*\\*\\s*([0-9]+)') THEN regexp_extract(text, '(?m)^\\*\\*Batch ID:\\*\\*\\s*([0-9]+)', 1) END AS batch_id FROM rep),
qc2 AS (SELECT id, CASE WHEN starts_with(trim(regexp_extract(notes, '.*\\| (.*)$', 1)), 'http') THEN trim(regexp_extract(notes, '.*\\| (.*)$', 1))
       WHEN starts_with(url, 'http') THEN url END AS url FROM qin),
bmap AS (SELECT CAST(id AS VARCHAR) AS bid, url FROM qc2),
done AS (SELECT report_num, q.url, l.first_seq FROM latest l JOIN qc2 q ON q.id = l.id
         WHERE l.status = 'completed' AND report_num <> '-' AND report_num <> '' AND q.url IS NOT NULL),
rmap AS (SELECT report_num, arg_max(url, first_seq) AS url FROM (SELECT * FROM done
         UNION ALL SELECT lpad(report_num, 3, '0'), url, first_seq FROM done WHERE length(report_num) < 3) GROUP BY report_num),
t AS (SELECT pos, nullif(regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 1), '') AS rnum,
  CASE WHEN regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 1) <> '' THEN regexp_extract(report, '\\[([0-9]+)\\]\\(([^)]+)\\)', 2) END AS rpath FROM trk),
r13 AS (SELECT t.pos, coalesce(h.url, b.url, m.url) AS url,
  CASE WHEN h.url IS NOT NULL THEN 1 WHEN b.url IS NOT NULL THEN 2 WHEN m.url IS NOT NULL THEN 3 END AS tier
  FROM t JOIN hdr h ON h.path = t.rpath LEFT JOIN bmap b ON b.bid = h.batch_id LEFT JOIN rmap m ON m.report_num = t.rnum),
sh AS (SELECT {_company_suffix_sql('company')} AS ckey, title AS cand_role, url, pos AS cand_pos FROM off WHERE starts_with(url, 'http')),
{_best_role_sql('apps', 'sh').strip().replace('roles AS', 'roles4 AS').replace('FROM roles', 'FROM roles4').replace('JOIN roles ', 'JOIN roles4 ').replace('roles.', 'roles4.').replace('words AS', 'words4 AS').replace('FROM words', 'FROM words4').replace('words.', 'words4.').replace('hits AS', 'hits4 AS').replace('JOIN hits', 'JOIN hits4').replace('scored AS', 'scored4 AS').replace('FROM scored', 'FROM scored4').replace('best AS', 'best4 AS')},
{_best_role_sql('apps', 'qc').strip()}
SELECT a.pos, coalesce(r13.url, best4.url, best.url) AS job_url,
  coalesce(r13.tier, CASE WHEN best4.url IS NOT NULL THEN 4 END, CASE WHEN best.url IS NOT NULL THEN 5 END) AS tier
FROM apps a LEFT JOIN r13 ON r13.pos = a.pos AND r13.url IS NOT NULL LEFT JOIN best4 ON best4.pos = a.pos LEFT JOIN best ON best.pos = a.pos""")
def join_job_url(spark, sf):
    apps = dashboard_apps(spark, sf)
    hdr = R.report_header(view(spark, sf, "rep")).withColumnRenamed("path", "report_path")
    q = inputs(spark, sf)
    _, _, qurl = QU.notes_parts(F.col("notes"), F.col("url"))
    # Written once: by their file's size the queue's urls look small enough to be sent to every task through the driver.
    urls = cut_table(q.select("id", once(qurl).alias("qurl")))
    bmap = urls.select(F.col("id").cast("string").alias("batch_id"), F.col("qurl").alias("b_url"))
    st = state(spark, sf).where((F.col("status") == "completed") & (F.col("report_num") != "-") & (F.col("report_num") != ""))
    rmap = QU.report_urls(st.join(urls.where("qurl is not null"), "id"))
    # Written once: both role lookups, the report join and the result read the parsed tracker.
    t = cut_table(apps.select("pos", "role", T.company_key_suffix("company").alias("ckey"), "report_num", "report_path"))
    r13 = (t.join(hdr, "report_path").join(bmap, "batch_id", "left")
           .join(rmap, "report_num", "left")
           .select("pos", F.coalesce("url", "b_url", "m_url").alias("r_url"),
                   F.when(F.col("url").isNotNull(), 1).when(F.col("b_url").isNotNull(), 2)
                   .when(F.col("m_url").isNotNull(), 3).alias("r_tier"))
           .where(F.col("r_url").isNotNull()))
    keyed = t.select("pos", "role", "ckey")
    hist = view(spark, sf, "off").where(F.col("url").startswith("http"))
    sh = hist.select(T.company_key_suffix("company").alias("ckey"), F.col("title").alias("cand_role"), "url",
                     F.col("pos").alias("cand_pos"))
    b4 = QU.best_role(keyed, sh).select("pos", F.col("url").alias("u4"))
    b5 = QU.best_role(keyed, queue_candidates_by_company(spark, sf)).select("pos", F.col("url").alias("u5"))
    out = t.select("pos").join(r13, "pos", "left").join(b4, "pos", "left").join(b5, "pos", "left")
    return out.select("pos", F.coalesce("r_url", "u4", "u5").alias("job_url"),
                      F.coalesce(F.col("r_tier"), F.when(F.col("u4").isNotNull(), 4),
                                 F.when(F.col("u5").isNotNull(), 5)).alias("tier"))
