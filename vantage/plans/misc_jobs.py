"""Remaining tracker/offer jobs: follow-up reader, score bands, tokens, state dictionary, point updates,
targets, quoted terms, company directory lookup and the analysis recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import status as S
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import fuzzy as FZ
from ..operators import versions as VS
from ..session import cut_table
from ..sources import reports as R
from ..sources import tracker as TR
from ..sources.bindings import _view, view
from . import sqlrules as Q
from .merge_jobs import DEDUP_TOKENS_SQL, MERGE_TOKENS_SQL
from .registry import register
from .report_jobs import _ENRICHED_SQL, _GAPS_SQL, _TECH_DUCK, _blocker_sql, enriched
from .tracker_jobs import ALIAS_STATUS, script_apps


@register("src_followups", ("fol",), """
SELECT CAST(app_num AS BIGINT) * 1000000 + num AS pos, num, app_num, date, company, role, channel, contact, notes FROM fol""")
def src_followups(spark, sf):
    return TR.src_followups(TR.render_followups(view(spark, sf, "fol")))


@register("cls_score_band", ("trk",), f"""
SELECT pos, {Q.score_js('score_raw')} AS score,
  CASE WHEN {Q.score_js('score_raw')} >= 4.5 THEN 'strong' WHEN {Q.score_js('score_raw')} >= 4.0 THEN 'good'
       WHEN {Q.score_js('score_raw')} >= 3.5 THEN 'decent' ELSE 'against' END AS band FROM trk""")
def cls_score_band(spark, sf):
    sc = F.col("score")
    band = F.when(sc >= 4.5, "strong").when(sc >= 4.0, "good").when(sc >= 3.5, "decent").otherwise("against")
    return script_apps(spark, sf).select("pos", "score", band.alias("band"))


@register("txt_role_tokens", ("trk",), f"""
SELECT pos, array_to_string({MERGE_TOKENS_SQL.format(x='role')}, ' ') AS merge_tokens,
  array_to_string({DEDUP_TOKENS_SQL.format(x='role')}, ' ') AS dedup_tokens FROM trk""")
def txt_role_tokens(spark, sf):
    return script_apps(spark, sf).select("pos", F.array_join(FZ.merge_tokens("role"), " ").alias("merge_tokens"),
                                         F.array_join(FZ.dedup_tokens("role"), " ").alias("dedup_tokens"))


# Fixed values (states dictionary: id, label, aliases).
STATES = [
    ("evaluated", "Evaluated", []), ("applied", "Applied", ["sent"]), ("responded", "Responded", []),
    ("interview", "Interview", []), ("offer", "Offer", []), ("rejected", "Rejected", []),
    ("discarded", "Discarded", []), ("skip", "SKIP", ["skip"]),
]


def states_dim(spark) -> DataFrame:
    """alias -> state id (labels and aliases, lower case); eight states, a fixed-size dimension."""
    rows = sorted({(lbl.lower(), sid) for sid, lbl, al in STATES} | {(a.lower(), sid) for sid, _, al in STATES for a in al})
    return spark.createDataFrame(rows, "alias string, state_id string")


@register("join_status_alias", ("trk",), f"""
WITH d AS (SELECT * FROM (VALUES {", ".join(f"({Q.q(a)}, {Q.q(i)})" for a, i in sorted({(lbl.lower(), sid) for sid, lbl, al in STATES} | {(a.lower(), sid) for sid, _, al in STATES for a in al}))}) v(alias, state_id))
SELECT t.pos, d.state_id FROM trk t LEFT JOIN d ON d.alias = {Q.status_clean('t.status_raw')}""")
def join_status_alias(spark, sf):
    apps = script_apps(spark, sf).withColumn("alias", S.status_clean("status_raw"))
    return apps.join(F.broadcast(states_dim(spark)), "alias", "left").select("pos", "state_id")


# A status update for every order; some report numbers stand in no tracker row.
_view("status_updates", ("orders",), """
SELECT CAST(o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1000001 ELSE 1 END AS STRING) AS report_num,
  split_part('Interview|Applied|Offer|Rejected|Evaluated', '|', CAST(o_orderkey % 5 AS INT) + 1) AS new_status FROM orders""")

_STATUS_SQL = """
m AS (SELECT u.new_status, min(t.pos) AS pos FROM status_updates u JOIN (
        SELECT pos, regexp_extract(report, '\\[([0-9]+)\\]\\(', 1) AS report_num FROM trk) t USING (report_num)
      GROUP BY u.report_num, u.new_status)"""


def _status_versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    apps = cut_table(TR.src_pipe_table_mixed(TR.render_tracker(view(spark, sf, "trk")), auto_number=False))
    return apps, VS.with_status(apps, view(spark, sf, "status_updates"))


@register("upsert_status", ("trk", "status_updates"), f"""WITH {_STATUS_SQL.strip()}
SELECT t.pos, coalesce(m.new_status, t.status_raw) AS status FROM trk t LEFT JOIN m ON m.pos = t.pos""")
def upsert_status(spark, sf):
    """The tracker line that carries ``[n]`` is found through its parsed report number (first line wins)."""
    return _status_versions(spark, sf)[1].select("pos", F.col("status_raw").alias("status"))


@register("upsert_status_log", ("trk", "status_updates"), f"""WITH {_STATUS_SQL.strip()}
SELECT t.pos, 'update' AS change, 'status_raw' AS "column", t.status_raw AS before, m.new_status AS after
FROM trk t JOIN m ON m.pos = t.pos WHERE t.status_raw <> m.new_status""")
def upsert_status_log(spark, sf):
    """What the updates changed, as the difference of the tracker before and after."""
    before, after = _status_versions(spark, sf)
    return VS.row_diff(before, after, "pos", ["status_raw", "company", "role", "notes"])


# Tracked companies (customer rows) as scan targets: enabled flag and provider.
_view("targets", ("customer",), """
SELECT c_custkey AS pos, c_name AS name, c_custkey % 3 <> 0 AS enabled,
  CASE c_custkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' ELSE NULL END AS provider FROM customer""")


@register("flt_targets", ("targets",), """
SELECT pos, name FROM targets WHERE enabled AND strpos(lower(name), '00001') > 0 AND provider IS NOT NULL""")
def flt_targets(spark, sf):
    t = view(spark, sf, "targets")
    return t.where(F.col("enabled") & F.lower("name").contains("00001") & F.col("provider").isNotNull()).select("pos", "name")


# Search queries built from events: quoted terms, site: filters and repeats.
_view("squery", ("events",), """
SELECT event_id AS pos, concat('"', event_type, ' engineer" "site:linkedin.com" "', upper(event_type), ' Engineer" "x" "data ',
  CAST(user_id % 5 AS STRING), '" "ml" "cloud"') AS query FROM events""")


def quoted_terms(q, cap: int | None = None, min_len: int = 1):
    found = F.regexp_extract_all(q, F.lit('"([^"]+)"'), 1)
    terms = F.filter(F.transform(found, T.collapse_ws), lambda t: (t != "") & ~F.lower(t).startswith("site:")
                     & (F.length(t) >= min_len))
    # unique by lower case, first spelling kept
    uniq = F.aggregate(terms, F.array().cast("array<string>"),
                       lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc)
                       .otherwise(F.concat(acc, F.array(t))))
    return F.slice(uniq, 1, cap) if cap else uniq


@register("txt_quoted_terms", ("squery",), """
WITH t AS (SELECT pos, list_filter(list_transform(regexp_extract_all(query, '"([^"]+)"', 1),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT starts_with(lower(x), 'site:')) AS l FROM squery),
u AS (SELECT pos, list_filter(l, lambda x, i: NOT list_contains(list_transform(l[1:i - 1], lambda y: lower(y)), lower(x))) AS l FROM t)
SELECT pos, array_to_string(l, '|') AS terms, array_to_string(list_filter(l, lambda x: length(x) > 1), '|') AS long_terms FROM u""")
def txt_quoted_terms(spark, sf):
    q = view(spark, sf, "squery")
    all_terms = quoted_terms(F.col("query"))
    return q.select("pos", F.array_join(all_terms, "|").alias("terms"),
                    F.array_join(F.filter(all_terms, lambda x: F.length(x) > 1), "|").alias("long_terms"))


# Names to look up: in the directory as they stand, by their first characters, or not at all.
_view("asked", ("trk", "orders"), """
SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))
  WHEN o_custkey % 5 = 1 THEN concat(lpad(CAST(o_custkey AS STRING), 4, '0'), ' GmbH') WHEN o_custkey % 5 = 2 THEN concat('Zyx ', CAST(o_custkey AS STRING))
  ELSE company END AS company FROM trk JOIN orders ON o_orderkey = pos""")


@register("join_company_lookup", ("asked", "customer"), """
WITH c AS (SELECT DISTINCT company FROM asked),
dir AS (SELECT c_custkey AS pos, c_name AS name FROM customer),
ex AS (SELECT c.company, min(d.pos) AS pos FROM c JOIN dir d ON d.name = c.company GROUP BY 1),
sub AS (SELECT c.company, min(d.pos) AS pos FROM c JOIN dir d ON strpos(d.name, left(c.company, 4)) > 0 GROUP BY 1)
SELECT c.company, coalesce(ex.pos, sub.pos) AS dir_pos, CASE WHEN ex.pos IS NOT NULL THEN 'exact' WHEN sub.pos IS NOT NULL THEN 'prefix4' END AS tier
FROM c LEFT JOIN ex USING (company) LEFT JOIN sub USING (company)""")
def join_company_lookup(spark, sf):
    companies = view(spark, sf, "asked").select("company").distinct()
    d = view(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"))
    exact = d.groupBy("name").agg(F.min("pos").alias("ex_pos")).withColumnRenamed("name", "company")
    # Every substring of up to 4 characters of every directory name, reduced to its first entry:
    # the probe is an equi-join on the company's first 4 characters, no pair of rows is formed.
    n = F.length("name")
    grams = d.select("pos", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(4))), lambda L:
        F.transform(F.sequence(F.lit(1), n - L + 1), lambda i: F.substring("name", i, L))))).alias("gram"))
    first = grams.groupBy("gram").agg(F.min("pos").alias("sub_pos"))
    probe = companies.withColumn("gram", F.substring("company", 1, 4))
    j = probe.join(exact, "company", "left").join(first, "gram", "left")
    return j.select("company", F.coalesce("ex_pos", "sub_pos").alias("dir_pos"),
                    F.when(F.col("ex_pos").isNotNull(), "exact").when(F.col("sub_pos").isNotNull(), "prefix4").alias("tier"))


# Fixed values (recommendation texts: rule, impact, action, reasoning).
RECOMMENDATIONS = {
    "geo": ("high", "Tighten location filters in portals.yml -- %d%% of applications hit a geo-restriction blocker",
            "%d of %d offers are location-restricted (US/Canada-only). These are wasted evaluation effort."),
    "stack": ("high", "Filter out roles requiring %s as primary stack -- %d%% hit stack mismatch",
              "Core stack gaps (%s) are the most common technical blockers in negative outcomes."),
    "threshold": ("medium", "Set minimum score threshold at %s/5 before generating PDFs",
                  "No positive outcomes below %s/5. Scores below this are wasted effort."),
    "archetype": ("medium", "Double down on \"%s\" roles (%d%% conversion rate)",
                  "%d of %d applications in this archetype led to positive outcomes."),
    "remote": ("medium", "Avoid \"%s\" roles (0%% conversion across %d applications)",
               "None of the %d applications with \"%s\" policy led to progress."),
}


def _rec_sql():
    def row(rule: str, action: str, reasoning: str, tail: str) -> str:
        impact, a, r = RECOMMENDATIONS[rule]
        return (f"SELECT {Q.q(rule)} AS rule, {Q.q(impact)} AS impact, printf({Q.q(a)}, {action}) AS action, "
                f"printf({Q.q(r)}, {reasoning}) AS reasoning FROM {tail}")

    num = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    top = "(SELECT string_agg(skill, ', ' ORDER BY frequency DESC, skill) FROM tg)"
    rate = ("count(*) AS total, count(*) FILTER (WHERE outcome = 'positive') AS positive, min(pos) AS first_pos, "
            "CAST(floor((count(*) FILTER (WHERE outcome = 'positive'))::DOUBLE / count(*)::DOUBLE * 100 + 0.5) AS BIGINT) AS rate FROM en")
    return f"""WITH {_ENRICHED_SQL}, {_GAPS_SQL},
n AS (SELECT count(*) AS total FROM trk),
b AS (SELECT {_blocker_sql('g.description', 'g.severity')} AS blocker FROM en JOIN gaps g ON g.path = en.report_path),
bl AS (SELECT blocker, count(*) AS frequency, CAST(floor(count(*)::DOUBLE / (SELECT total FROM n)::DOUBLE * 100 + 0.5) AS BIGINT) AS pct
       FROM b WHERE blocker IS NOT NULL GROUP BY blocker),
tt AS (SELECT unnest(regexp_extract_all(g.description, {Q.q(_TECH_DUCK)}, 1)) AS tech
       FROM en JOIN gaps g ON g.path = en.report_path WHERE en.outcome IN ('negative', 'self_filtered')),
tg AS (SELECT upper(substr(tech, 1, 1)) || substr(tech, 2) AS skill, count(*) AS frequency FROM tt GROUP BY 1 ORDER BY frequency DESC, skill LIMIT 3),
mp AS (SELECT min({Q.score_js('score_raw')}) FILTER (WHERE {Q.outcome(ALIAS_STATUS)} = 'positive' AND {Q.score_js('score_raw')} > 0) AS lo FROM trk),
ar AS (SELECT archetype, {rate} GROUP BY archetype),
rp AS (SELECT remote_bucket AS policy, {rate} GROUP BY remote_bucket),
best AS (SELECT * FROM ar WHERE total >= 2 ORDER BY rate DESC, total DESC, first_pos LIMIT 1),
worst AS (SELECT * FROM rp WHERE total >= 2 AND rate = 0 ORDER BY total DESC, first_pos LIMIT 1)
{row('geo', 'pct', 'frequency, (SELECT total FROM n)', "bl WHERE blocker = 'geo-restriction' AND pct >= 20")}
UNION ALL {row('stack', f'{top}, pct', top, "bl WHERE blocker = 'stack-mismatch' AND pct >= 15")}
UNION ALL {row('threshold', num('floor(lo * 10) / 10'), num('lo'), 'mp WHERE lo > 3.0')}
UNION ALL {row('archetype', 'archetype, rate', 'positive, total', 'best WHERE rate > 0')}
UNION ALL {row('remote', 'policy, total', 'total, policy', 'worst')}"""


def _recommendation(df, rule: str, action: list, reasoning: list):
    impact, a, r = RECOMMENDATIONS[rule]
    return df.select(F.lit(rule).alias("rule"), F.lit(impact).alias("impact"), F.format_string(a, *action).alias("action"),
                     F.format_string(r, *reasoning).alias("reasoning"))


@register("agg_recommendations", ("trk", "rep"), _rec_sql())
def agg_recommendations(spark, sf):
    """The rules read two tables written once: the enriched tracker and its gaps."""
    e = cut_table(enriched(spark, sf).select("pos", "outcome", "score", "archetype", "remote_bucket", F.col("report_path").alias("path")))
    gaps = cut_table(e.select("outcome", "path").join(R.report_gaps(view(spark, sf, "rep")).select("path", "description", "severity"), "path"))
    total = e.agg(F.count(F.lit(1)).alias("n"))
    bl = A.with_scalars(gaps.select(K.blocker("description", "severity").alias("blocker")).where("blocker is not null")
                        .groupBy("blocker").agg(F.count(F.lit(1)).alias("frequency")), total) \
        .withColumn("pct", T.js_round(F.col("frequency") / F.col("n") * 100).cast("long"))
    skills = (gaps.where(F.col("outcome").isin("negative", "self_filtered")).select(F.explode(K.tech_mentions("description")).alias("skill"))
              .groupBy("skill").agg(F.count(F.lit(1)).alias("frequency")))
    top3 = skills.orderBy(F.col("frequency").desc(), "skill").limit(3).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "skill"))), lambda x: x["skill"]), ", ").alias("top"))
    geo = _recommendation(bl.where("blocker = 'geo-restriction' and pct >= 20"), "geo", ["pct"], ["frequency", "n"])
    stack = _recommendation(A.with_scalars(bl.where("blocker = 'stack-mismatch' and pct >= 15"), top3), "stack", ["top", "pct"], ["top"])
    lo = e.agg(F.min(F.when((F.col("outcome") == "positive") & (F.col("score") > 0), F.col("score"))).alias("lo")).where("lo > 3.0")
    thr = _recommendation(lo, "threshold", [T.js_number(F.floor(F.col("lo") * 10) / 10)], [T.js_number("lo")])
    positive = F.count_if(F.col("outcome") == "positive")
    rates = [F.count(F.lit(1)).alias("total"), positive.alias("positive"), F.min("pos").alias("first_pos"),
             T.js_round(positive / F.count(F.lit(1)) * 100).cast("long").alias("rate")]
    best = (e.groupBy("archetype").agg(*rates).where("total >= 2").orderBy(F.col("rate").desc(), F.col("total").desc(), "first_pos").limit(1)
            .where("rate > 0"))
    worst = (e.groupBy(F.col("remote_bucket").alias("policy")).agg(*rates).where("total >= 2 and rate = 0")
             .orderBy(F.col("total").desc(), "first_pos").limit(1))
    return (geo.unionByName(stack).unionByName(thr).unionByName(_recommendation(best, "archetype", ["archetype", "rate"], ["positive", "total"]))
            .unionByName(_recommendation(worst, "remote", ["policy", "total"], ["total", "policy"])))
