"""Fixture views over the driver's test tables.

Each view is one SQL text that runs unchanged in Spark and in DuckDB, so the
Spark job and its oracle read the very same derived rows.  Views may depend on
other views; ``sql_with`` renders the dependency chain as a ``WITH`` prefix
for the oracle, ``view`` builds the Spark DataFrame.

Parameters fixed for every view: ``as_of`` is never the clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed evaluation dates (never the clock).
AS_OF_TRACKER = "2001-09-01"
AS_OF_EVENTS = "2024-02-01"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql.strip())


# --- tracker (orders) -------------------------------------------------------
_view("trk", ("orders",), """
SELECT o_orderkey AS pos,
  CAST(o_orderkey + 1 AS INT) AS num,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
  concat('Customer ', CAST(o_custkey AS STRING),
    split_part('| Inc| (EU)| LLC', '|', CAST(o_orderkey % 4 AS INT) + 1)) AS company,
  concat_ws(' ',
    split_part('Senior|Staff|Lead|Junior', '|', CAST(o_orderkey % 4 AS INT) + 1),
    split_part('Data|Platform|Frontend|Backend|Security', '|', CAST(o_custkey % 5 AS INT) + 1),
    split_part('Pipeline|Product|Growth', '|', CAST(o_orderkey % 3 AS INT) + 1),
    'Developer',
    split_part('London|Remote|Tokyo|Berlin|Zurich', '|', CAST(o_orderkey % 5 AS INT) + 1)) AS role,
  CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 19 = 0 THEN concat(CAST(1 + o_orderkey % 4 AS STRING), ' of 5') WHEN o_orderkey % 23 = 0 THEN 'DUP'
       WHEN o_orderkey % 13 = 0 THEN concat('**', CAST(1 + o_orderkey % 4 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), '/5**')
       ELSE concat(CAST(1 + o_orderkey % 4 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), '/5') END AS score_raw,
  split_part('Evaluated|Applied|Responded|Interview|Offer|Rejected|Discarded|SKIP|**Applied**|Aplicado 2026-03-12|Evaluada|Rechazado|monitor|hold|Duplicado de 12|sent|Geo Blocker|No aplicar|Entrevista|weird',
    '|', CAST(o_orderkey % 20 AS INT) + 1) AS status_raw,
  CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS pdf,
  CASE WHEN o_orderkey % 11 = 0 THEN ''
       WHEN o_orderkey % 9 = 0 THEN concat('[', CAST(o_orderkey + 1 AS STRING), '](reports/gone-', CAST(o_orderkey + 1 AS STRING), '.md)')
       WHEN o_orderkey < 99 THEN concat('[', lpad(CAST(o_orderkey + 1 AS STRING), 3, '0'), '](reports/', CAST(o_orderkey + 1 AS STRING), '.md)')
       ELSE concat('[', CAST(o_orderkey + 1 AS STRING), '](reports/', CAST(o_orderkey + 1 AS STRING), '.md)') END AS report,
  CASE WHEN o_orderkey % 7 = 0 THEN concat(split_part('Emailed Jane Roe at jane|contact: Max Poe @ max|see ', '|', CAST(o_orderkey % 3 AS INT) + 1), CAST(o_custkey AS STRING), '@mail.example.com') ELSE o_orderpriority END AS notes
FROM orders
""")

# --- follow-ups (lineitem) --------------------------------------------------
_view("fol", ("lineitem",), """
SELECT CAST(l_partkey AS INT) AS num, CAST(l_orderkey + 1 AS INT) AS app_num,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS date,
  concat('Customer ', CAST(l_suppkey % 90 AS STRING)) AS company, split_part('Data|Platform|Growth', '|', CAST(l_linenumber % 3 AS INT) + 1) AS role,
  l_returnflag AS channel, l_linestatus AS contact, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat('note ', CAST(l_suppkey % 7 AS STRING)) END AS notes
FROM lineitem
""")

# --- tracker additions (orders) ---------------------------------------------
_view("adds", ("orders",), """
SELECT o_orderkey AS file_no, CAST(o_orderkey AS STRING) || '-x.tsv' AS file,
  concat_ws(chr(9),
    CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey + 100000 END AS STRING),
    CAST(CAST(o_orderdate AS DATE) AS STRING),
    concat('Customer ', CAST(o_custkey AS STRING)),
    concat_ws(' ', 'Principal', split_part('Data|Platform|Frontend|Backend|Security', '|', CAST(o_custkey % 5 AS INT) + 1), 'Product Developer'),
    CASE WHEN o_orderkey % 75 = 0 THEN '4.9/5' ELSE split_part('Evaluada|Aplicado|Rechazado|Oferta', '|', CAST(o_custkey % 4 AS INT) + 1) END,
    CASE WHEN o_orderkey % 75 = 0 THEN 'Evaluated' WHEN o_custkey % 3 = 0 THEN '4.9/5'
         ELSE concat(CAST(1 + o_custkey % 4 AS STRING), '.', CAST(o_orderkey % 9 AS STRING), '/5') END,
    split_part('no|yes', '|', CAST(o_custkey % 2 AS INT) + 1), concat('[', CAST(o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 200000 END AS STRING), '](reports/', CAST(o_orderkey + 7 AS STRING), '.md)'),
    concat('batch ', CAST(o_orderkey % 5 AS STRING))) AS line
FROM orders
""")

# --- tracker and additions whose companies have names of other scripts, full-width letters or none ------------
_view("trk_intl", ("trk", "orders"), """
SELECT pos, num, date,
  CASE WHEN o_orderkey % 97 = 0 THEN '***'
       WHEN o_custkey % 3 = 0 THEN concat(split_part('鴻海精密|台積電|ソニー|삼성전자|Яндекс', '|', CAST(o_custkey % 5 AS INT) + 1), ' ', CAST(o_custkey % 60 AS STRING))
       WHEN o_custkey % 3 = 1 THEN concat('Ｃｕｓｔｏｍｅｒ（', CAST(o_custkey AS STRING), '）')
       ELSE company END AS company,
  role, score_raw, status_raw, pdf, report, notes
FROM trk JOIN orders ON o_orderkey = pos
""")
_view("adds_intl", ("adds", "orders"), """
SELECT file_no, file,
  CASE WHEN o_custkey % 3 = 0 THEN replace(line, concat('Customer ', CAST(o_custkey AS STRING)),
         concat(split_part('鴻海精密|台積電|ソニー|삼성전자|ЯНДЕКС', '|', CAST(o_custkey % 5 AS INT) + 1), CAST(o_custkey % 60 AS STRING)))
       WHEN o_orderkey % 89 = 0 THEN replace(line, concat('Customer ', CAST(o_custkey AS STRING)), '--')
       ELSE replace(line, 'Customer ', 'CUSTOMER ') END AS line
FROM adds JOIN orders ON o_orderkey = file_no
""")

# --- offers and scan history (events) ---------------------------------------
_view("off", ("events",), """
SELECT event_id AS pos, ts, CAST(ts AS DATE) AS seen_date,
  concat('https://jobs.example.com/companies/c', CAST(user_id % 40 AS STRING), '/jobs/', CAST((event_id * 7919) % 4001 AS STRING)) AS url,
  concat('Company ', CAST(user_id % 40 AS STRING)) AS company,
  concat_ws(' ', split_part('Senior|Junior|Staff|', '|', CAST(event_id % 4 AS INT) + 1),
    event_type, split_part('Engineer|Analyst|Developer', '|', CAST(user_id % 3 AS INT) + 1)) AS title,
  split_part('104.com.tw|cakeresume.com|yourator.co|meet.jobs|linkedin.com|other', '|', CAST(event_id % 6 AS INT) + 1) AS source
FROM events
""")

# --- liveness checks of offer urls: before, at or after the offer was seen; 'failed' where the page did not load --
_view("chk", ("off",), """
SELECT pos AS check_id, url,
  CASE CAST(pos % 5 AS INT) WHEN 0 THEN ts - INTERVAL 3 HOUR WHEN 1 THEN ts + INTERVAL 2 HOUR WHEN 2 THEN ts ELSE ts - INTERVAL 9 DAY END AS checked_at,
  split_part('active|expired|uncertain|failed|expired|active|active', '|', CAST(pos % 7 AS INT) + 1) AS result
FROM off WHERE url <> ''
""")

# --- rich postings (events) -------------------------------------------------
_view("post", ("events",), """
SELECT event_id AS pos, CAST((event_id * 31) % 3001 AS STRING) AS job_no,
  concat(event_type, ' Engineer') AS title, concat('Company ', CAST(user_id % 40 AS STRING)) AS company,
  split_part('North City|South City|East Town|West Town', '|', CAST(user_id % 4 AS INT) + 1) AS location,
  CASE WHEN event_id % 5 = 0 THEN 'negotiable'
       ELSE concat(CAST(30000 + (event_id % 60) * 1000 AS STRING), '~', CAST(40000 + (event_id % 90) * 2000 AS STRING)) END AS salary,
  CAST(event_id % 3 AS INT) AS remote_type, CAST(ts AS DATE) AS appear_date,
  CAST(event_id % 700 AS INT) AS employee_count
FROM events
""")

# --- queue input and state log (events) -------------------------------------
_view("qin", ("events",), """
SELECT event_id AS id, concat('https://jobs.example.com/job/', CAST(event_id AS STRING)) AS url,
  'events' AS source,
  concat(split_part('Data Developer|Platform Product Developer|資深 Frontend Growth Developer|Backend', '|', CAST(event_id % 4 AS INT) + 1), ' @ Customer ', CAST(user_id AS STRING), ' | 80% | https://real.example.com/', CAST(event_id AS STRING)) AS notes
FROM events
""")

_view("qst", ("events",), """
SELECT event_id AS seq, event_id % 4000 AS id,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
       WHEN 'signup' THEN 'skipped' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
  CAST(event_id % 999 AS STRING) AS report_num,
  CAST(event_id % 50 AS DOUBLE) / 10 AS score, CAST(event_id % 4 AS INT) AS retries
FROM events
""")

# --- report documents (orders) ----------------------------------------------
_view("rep", ("orders",), """
SELECT concat('reports/', CAST(o_orderkey + 1 AS STRING), '.md') AS path,
  concat('# Evaluation', chr(10),
    CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE concat('**URL:** https://jobs.example.com/r/', CAST(o_orderkey AS STRING), chr(10)) END,
    CASE WHEN o_orderkey % 8 = 1 THEN '' ELSE concat('**Batch ID:** ', CAST(o_orderkey % 4000 AS STRING), chr(10)) END, chr(10),
    '| **Archetype** | ', split_part('Platform|Agentic|Solutions', '|', CAST(o_custkey % 3 AS INT) + 1), ' |', chr(10),
    '| **Remote** | ', split_part('Hybrid in office|Global anywhere|Remote LATAM|US-only|TBD', '|', CAST(o_orderkey % 5 AS INT) + 1), ' |', chr(10),
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('| **Seniority** | ', split_part('Senior|Lead|Mid', '|', CAST(o_orderkey % 3 AS INT) + 1), ' |', chr(10),
      '| **Salary** | ', CAST(40 + o_orderkey % 60 AS STRING), 'k EUR |', chr(10), '| **Domain** | ', split_part('Fintech|Health', '|', CAST(o_custkey % 2 AS INT) + 1), ' |', chr(10)) END,
    '| **Team size** | ', split_part('~8 engineers|200 people|5,000+|small team|n/a', '|', CAST(o_custkey % 5 AS INT) + 1), ' |', chr(10),
    '| CV Match | ', CAST(1 + o_orderkey % 4 AS STRING), '.5/5 |', chr(10),
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('| North Star | ', CAST(1 + o_custkey % 4 AS STRING), '.2/5 |', chr(10), '| Comp | ', CAST(1 + o_orderkey % 5 AS STRING), '/5 |', chr(10),
      '| Cultural signals | 3.', CAST(o_orderkey % 10 AS STRING), '/5 |', chr(10), '| Red flags | -0.', CAST(o_custkey % 10 AS STRING), ' |', chr(10), '| Global | 4.', CAST(o_orderkey % 9 AS STRING), '/5 |', chr(10)) END,
    CASE WHEN o_orderkey % 6 = 1 THEN concat('**Arquetipo detectado** | Agente ', CAST(o_orderkey % 5 AS STRING), ' |', chr(10), '**TL;DR:** ', repeat('señal útil ', CAST(1 + o_orderkey % 15 AS INT)), chr(10), '**Comp** | 90k |', chr(10))
         WHEN o_orderkey % 6 = 2 THEN concat('**Arquetipo:** Plataforma', chr(10), '**TL;DR** | short ', CAST(o_custkey % 7 AS STRING), ' |', chr(10)) ELSE '' END, chr(10),
    '| Gap | Severity | Mitigation |', chr(10), '|-----|----------|------------|', chr(10),
    '| needs ', split_part('Python and Docker|Kubernetes and Go|React|Terraform and Python', '|', CAST(o_custkey % 4 AS INT) + 1), ' | ', split_part('Medium|Nice to have|Hard', '|', CAST(o_orderkey % 3 AS INT) + 1), ' | course |', chr(10),
    '| visa required in region | Hard | none |', chr(10)) AS text
FROM orders
""")

# --- ATS JSON payloads (events) ---------------------------------------------
_view("pay", ("events",), """
SELECT event_id AS pos, concat('Company ', CAST(user_id % 40 AS STRING)) AS company,
  split_part('greenhouse|ashby|lever', '|', CAST(event_id % 3 AS INT) + 1) AS ats,
  CASE CAST(event_id % 3 AS INT)
    WHEN 0 THEN concat('{"jobs":[{"title":" ', event_type, '  Engineer","absolute_url":"https://g.example.com/', CAST(event_id AS STRING), '","location":{"name":"',
      split_part('Oslo| Bergen  Sentrum|', '|', CAST(user_id % 3 AS INT) + 1), '"}}', CASE WHEN user_id % 4 = 0 THEN ',{"title":"Second","location":{}}' ELSE '' END, ']}')
    WHEN 1 THEN concat('{"jobs":[{"title":"', event_type, '","jobUrl":"https://a.example.com/', CAST(event_id AS STRING), '","location":"',
      split_part('Rome|Milano ', '|', CAST(user_id % 2 AS INT) + 1), '"}', CASE WHEN user_id % 4 = 1 THEN ',{"title":"Second","location":"Bari"}' ELSE '' END, ']}')
    ELSE concat('[{"text":"', event_type, '","hostedUrl":"', CASE WHEN user_id % 2 = 0 THEN 'https://h.example.com/x' ELSE '' END, '","applyUrl":"https://l.example.com/', CAST(event_id AS STRING),
      '","categories":{"location":"', split_part('Bonn|Köln', '|', CAST(user_id % 2 AS INT) + 1), '"}}', CASE WHEN user_id % 4 = 2 THEN ',{"text":"Second"}' ELSE '' END, ']') END AS json
FROM events
""")

# --- pipeline inbox: one markdown checklist file built from the seen offers --
def _inbox(where: str) -> str:
    return f"""
SELECT 'data/pipeline.md' AS file, line_no, line FROM (
  SELECT CAST(0 AS BIGINT) AS line_no, '# Pipeline Inbox' AS line
  UNION ALL SELECT CAST(1 AS BIGINT), '## Pending'
  UNION ALL SELECT 2 + pos, concat('- [ ] ', url, ' | ', company, ' | ', title,
    CASE WHEN pos % 8 = 0 THEN concat(' | North City | ', CAST(seen_date AS STRING)) WHEN pos % 8 = 4 THEN ' | East Town' ELSE '' END) FROM off WHERE pos % 2 = 0{where}
  UNION ALL SELECT CAST(1000000000 AS BIGINT), '## Processed'
  UNION ALL SELECT 1000000001 + pos, concat('- [x] ', url, ' | ', company, ' | ', title) FROM off WHERE pos % 2 = 1{where}
) t
"""


# All offers; and the inbox as it stood when the history of the scan flows ended, whose new rows are the rest.
_view("inbox", ("off",), _inbox(""))
_view("inbox_old", ("off",), _inbox(" AND ts < TIMESTAMP '2024-01-11 00:00:00'"))

# --- company directory (customer) -------------------------------------------
_view("cust", ("customer",), """
SELECT c_custkey AS pos, c_name AS name FROM customer
""")


def sql_with(names: list[str] | tuple[str, ...], body: str) -> str:
    """Oracle SQL: ``WITH`` the needed views (dependencies first), then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in order:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    body = body.strip()
    if own := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE):
        return f"WITH {'RECURSIVE ' if own.group(1) else ''}{ctes},\n{body[own.end():]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a fixture view (base tables are read from ``sf_dir``)."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    deps, sql = VIEWS[name]
    for d in deps:
        view(spark, sf_dir, d).createOrReplaceTempView(d)
    # spark.sql analyses eagerly, so the result keeps the relations bound now.
    return spark.sql(sql)
