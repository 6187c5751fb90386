"""Sinks (written, then read back) and the two streaming operators, as registered jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped_text as GT
from ..operators import sinks as SK
from ..sources.bindings import VIEWS, view
from ..streaming import ingest as ST
from .queue_jobs import QU, _LATEST, _QUEUE_SQL, inputs, queue_candidates
from . import sqlrules as Q
from .merge_jobs import MERGED_SQL, merged
from .registry import register
from .scan_jobs import NEGATIVE, POSITIVE, SPLIT_TS, _with_seen, dispositions, history
from .tracker_jobs import script_apps


@register("snk_tracker", ("adds", "trk"), f"WITH {MERGED_SQL}")
def snk_tracker(spark, sf):
    """The merged tracker, written as a new version and read back."""
    path = SK.write_tracker_version(merged(spark, sf), SK.scratch_dir(spark, "tracker"), "1")
    return spark.read.parquet(path)


@register("snk_history_append", ("off", "inbox_old", "trk"), _with_seen("""
SELECT d.url, d.company, d.title, o.seen_date AS first_seen FROM disp d JOIN off o USING (pos) WHERE d.disposition = 'added'"""))
def snk_history_append(spark, sf):
    path = SK.scratch_dir(spark, "history")
    added = dispositions(spark, sf).where(F.col("disposition") == "added").select("pos", "url", "company", "title")
    rows = added.join(view(spark, sf, "off").select("pos", F.col("seen_date").alias("first_seen")), "pos").drop("pos")
    SK.append_history(rows, path)
    back = SK.read_history(spark, path, rows.schema)
    return back.select("url", "company", "title", F.col("first_seen").cast("date").alias("first_seen"))


@register("snk_inbox_grouped", ("off", "inbox_old"), f"""
WITH u AS (SELECT regexp_extract(line, '^- \\[ \\] (https?://[^ \\t\\n\\f\\r]+)', 1) AS url, 0 AS src, line_no AS ord, line,
    coalesce(string_split(line, ' | ')[4], '') AS loc, trim(coalesce(string_split(line, ' | ')[5], '')) AS date
  FROM inbox_old WHERE regexp_matches(line, '^- \\[ \\] (https?://[^ \\t\\n\\f\\r]+)')
  UNION ALL SELECT url, 1, pos, '- [ ] ' || concat_ws(' | ', url, company, title, loc, date), loc, date
  FROM (SELECT *, strftime(seen_date, '%Y-%m-%d') AS date, split_part('North City|East Town|', '|', (pos % 3 + 1)::INT) AS loc FROM off
        WHERE ts >= TIMESTAMP '{SPLIT_TS}')),
e AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, ord) AS f, row_number() OVER (PARTITION BY url ORDER BY src DESC, ord DESC) AS r FROM u),
k AS (SELECT l.line, l.date, coalesce(nullif(l.loc, ''), '其他') AS grp, f.src, f.ord FROM e l JOIN e f USING (url) WHERE l.r = 1 AND f.f = 1),
o AS (SELECT DISTINCT grp, CASE WHEN starts_with(grp, 'North City') THEN 0 WHEN starts_with(grp, 'East Town') THEN 1 ELSE 99 END AS rank FROM k),
x AS (SELECT 0 AS s, 0 AS rank, '' AS grp, 0 AS part, '' AS date, 0 AS src, 0 AS ord, unnest([1, 2, 3, 4, 5]) AS i,
    unnest(['# Job Pipeline', '', '共 ' || (SELECT count(*) FROM k) || ' 筆待評估', '', '## Pending']) AS line
  UNION ALL SELECT 1, rank, grp, 0, '', 0, 0, unnest([1, 2, 3]), unnest(['', '### ' || grp, '']) FROM o
  UNION ALL SELECT 1, rank, grp, 1, date, src, ord, 0, line FROM k JOIN o USING (grp)
  UNION ALL SELECT 2, 0, '', 0, '', 0, line_no, 0, line FROM inbox_old WHERE line_no >= (SELECT min(line_no) FROM inbox_old WHERE starts_with(line, '## Processed')))
SELECT row_number() OVER (ORDER BY s, rank, grp, part, date DESC, src, ord, i) AS line_no, line FROM x""")
def snk_inbox_grouped(spark, sf):
    """The inbox after new offers: pending entries by location, then the processed section, written and read back."""
    off = view(spark, sf, "off").where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp"))
    loc = F.when(F.col("pos") % 3 == 0, "North City").when(F.col("pos") % 3 == 1, "East Town").otherwise("")
    new = off.select("pos", "url", "company", "title", loc.alias("location"), F.date_format("seen_date", "yyyy-MM-dd").alias("date"))
    rows, tail = GT.merged_inbox(view(spark, sf, "inbox_old"), new)
    title = F.array(F.lit("# Job Pipeline"), F.lit(""), F.concat(F.lit("共 "), F.col("n").cast("string"), F.lit(" 筆待評估")), F.lit(""), F.lit("## Pending"))
    path = SK.scratch_dir(spark, "inbox")
    GT.write_document(GT.grouped_document(rows, F.array(F.lit(""), F.concat(F.lit("### "), "grp"), F.lit("")), title, ["North City", "East Town"], tail), path)
    return GT.read_document(spark, path)


@register("snk_queue_file", ("inbox", "qst", "qin"), f"""WITH {_QUEUE_SQL}
SELECT CAST(greatest((SELECT max(id) FROM qin), (SELECT max(id) FROM qst)) + row_number() OVER (ORDER BY line_no) AS VARCHAR) AS id,
  url, 'pipeline' AS source, company AS notes FROM cand""")
def snk_queue_file(spark, sf):
    existing = inputs(spark, sf).select("id").unionByName(view(spark, sf, "qst").select("id"))
    rows = QU.next_ids(queue_candidates(spark, sf), "line_no", existing).select(
        "id", "url", F.lit("pipeline").alias("source"), F.col("company").alias("notes"))
    path = SK.scratch_dir(spark, "queue")
    SK.write_queue_tsv(rows, path)
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    return back.select("id", "url", "source", "notes")


@register("snk_json_result", ("trk",), f"""
SELECT status, CAST(count(*) AS BIGINT) AS count FROM (SELECT {Q.status_alias('status_raw')} AS status FROM trk) GROUP BY status""")
def snk_json_result(spark, sf):
    funnel = script_apps(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("count"))
    path = SK.scratch_dir(spark, "json")
    SK.write_json(funnel.select(F.to_json(F.struct("status", "count")).alias("value")).select(
        F.from_json("value", "status string, count long").alias("r")).select("r.*"), path)
    return spark.read.schema("status string, count long").json(path)


# --- streaming ------------------------------------------------------------------------------

def _events_to_offers(raw):
    """The ``off`` view over a stream (same SQL, streaming relation)."""
    raw.createOrReplaceTempView("events_stream")
    return raw.sparkSession.sql(VIEWS["off"][1].replace("FROM events", "FROM events_stream"))


@register("stm_offer_ingest", ("off",), f"""
WITH o AS (SELECT pos, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS url, trim(regexp_replace(company, '\\s+', ' ', 'g')) AS company,
  trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, ts AS event_time FROM off WHERE ts >= TIMESTAMP '{SPLIT_TS}')
SELECT url, company, title, event_time, pos FROM o
WHERE ((strpos(lower(title), 'engineer') > 0 OR strpos(lower(title), 'developer') > 0)
       AND NOT (strpos(lower(title), 'junior') > 0 OR strpos(lower(title), 'error') > 0))
  AND url <> '' AND url NOT IN (SELECT url FROM off WHERE ts < TIMESTAMP '{SPLIT_TS}')
QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1""")
def stm_offer_ingest(spark, sf):
    schema = view(spark, sf, "events").schema
    stream = ST.offer_stream(spark, sf, "events.parquet", schema, _events_to_offers)
    stream = stream.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp"))
    out = SK.scratch_dir(spark, "ingest")
    table = ST.offer_ingest(stream, history(spark, sf), POSITIVE, NEGATIVE, out, out + "-ckpt")
    return ST.accepted_offers(table)


@register("stm_queue_state", ("qst",), f"WITH {_LATEST} SELECT id, status, report_num, score, retries FROM latest")
def stm_queue_state(spark, sf):
    schema = view(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    raw.createOrReplaceTempView("events_stream")
    events = spark.sql(VIEWS["qst"][1].replace("FROM events", "FROM events_stream"))
    out = SK.scratch_dir(spark, "qstate")
    table = ST.queue_state(events, out, out + "-ckpt")
    return ST.current_states(table).select("id", "s.status", "s.report_num", "s.score", "s.retries")
