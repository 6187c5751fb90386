"""Tracker dedup jobs: fuzzy edges, greedy leader clusters, keeper + status promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T
from ..operators import fuzzy as FZ
from ..operators import greedy as G
from ..session import cut_table
from ..sources import tracker as TR
from ..sources.bindings import view
from .merge_jobs import DEDUP_TOKENS_SQL, _match_sql
from . import sqlrules as Q
from .registry import register


def dedup_tracker(spark, sf, name: str = "trk", policy: str = "parity") -> DataFrame:
    """Parsed tracker with block key and tokens, materialised once: every later step reads it several times.

    Under the ``safe`` policy a row whose company has no key is in no block.
    """
    t = TR.src_pipe_table(TR.render_tracker(view(spark, sf, name)), "positive")
    return cut_table(t.select("pos", "num", "company", "role", "score_raw", "status_raw",
                                T.DEDUP_KEYS[policy]("company").alias("ckey"), FZ.dedup_tokens("role").alias("tokens"))
                     .where("ckey is not null"))


def dedup_classes(rows: DataFrame) -> DataFrame:
    """(ckey, tokens, pos): rows with equal company key and token list are one class, named by its first position."""
    return rows.groupBy("ckey", "tokens").agg(F.min("pos").alias("pos"))


def dedup_edges(classes: DataFrame) -> DataFrame:
    """(ckey, a, b) with a earlier than b in the same company block and a~b, between classes."""
    left = classes.select(F.col("pos").alias("a"), "ckey", "tokens")
    right = classes.select(F.col("pos").alias("b"), "ckey", "tokens")
    m = FZ.fuzzy_join(left, right, "ckey", "tokens", "a", "b")
    return m.where(F.col("a") < F.col("b")).select("ckey", "a", "b")


@register("join_role_fuzzy_dedup", ("trk",), f"""
WITH r AS (SELECT pos, trim(regexp_replace(regexp_replace(regexp_replace(lower(company), '[()]', '', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS ckey,
  {DEDUP_TOKENS_SQL.format(x='role')} AS tokens FROM trk WHERE num > 0),
c AS (SELECT ckey, tokens, min(pos) AS rep FROM r GROUP BY ckey, tokens)
SELECT 'pair' AS kind, x.ckey, x.rep AS a, y.rep AS b FROM c x JOIN c y ON x.ckey = y.ckey AND x.rep < y.rep
WHERE {_match_sql('x.tokens', 'y.tokens')}
UNION ALL SELECT 'member', r.ckey, c.rep, r.pos FROM r JOIN c USING (ckey, tokens)
""")
def join_role_fuzzy_dedup(spark, sf):
    """Pairs between the first rows of classes of equal roles, and every row's membership in its class."""
    rows = dedup_tracker(spark, sf)
    classes = cut_table(dedup_classes(rows))
    member = rows.join(classes.withColumnRenamed("pos", "a"), ["ckey", "tokens"]).select(
        F.lit("member").alias("kind"), "ckey", "a", F.col("pos").alias("b"))
    return dedup_edges(classes).select(F.lit("pair").alias("kind"), "ckey", "a", "b").unionByName(member)


def clusters(rows: DataFrame) -> DataFrame:
    """(pos, leader) of every row that matches another.

    The rows of a class match one another (lists of two or more tokens do), so whoever leads its first row
    leads them all: the greedy rounds run over classes and their pairs, and rows take their class's leader.
    """
    classes = cut_table(dedup_classes(rows))
    edges = cut_table(dedup_edges(classes))
    led = G.leader_clusters(classes, edges, "pos").withColumnRenamed("pos", "rep")
    c = classes.withColumnRenamed("pos", "rep").join(led, "rep")
    # Narrow and written: sizes and the result are two readings.
    assigned = cut_table(rows.select("pos", "ckey", "tokens").join(c, ["ckey", "tokens"]).where(F.size("tokens") >= 2).select("pos", "leader"))
    sizes = assigned.groupBy("leader").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    linked = edges.select(F.col("a").alias("leader")).unionByName(edges.select(F.col("b").alias("leader"))).distinct()
    matched = sizes.select("leader").unionByName(linked).distinct()
    return assigned.join(matched, "leader", "left_semi").select("pos", "leader")


# In order of position, a row leads unless an earlier leader matches it: the earliest class of a block leads
# and claims its matches, then the earliest of the rest, and so on, as one recursion step per leader of a block.
# Rows of a class (company key, token list) match one another and share their first row's leader.
def _leader_sql(trk: str = "trk", key=Q.company_key_spaced) -> str:
    return f"""
r AS MATERIALIZED (SELECT * FROM (SELECT pos, {key('company')} AS ckey, {DEDUP_TOKENS_SQL.format(x='role')} AS tokens, score_raw, status_raw
  FROM {trk} WHERE num > 0) WHERE ckey IS NOT NULL),
cl AS MATERIALIZED (SELECT ckey, tokens, min(pos) AS rep, count(*) AS n FROM r GROUP BY ckey, tokens),
e AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b, x.ckey FROM cl x JOIN cl y ON x.ckey = y.ckey AND x.rep < y.rep WHERE {_match_sql('x.tokens', 'y.tokens')}),
adj AS MATERIALIZED (SELECT a, list(b) AS bs FROM e GROUP BY a),
nodes AS (SELECT ckey, list(DISTINCT p ORDER BY p) AS ps FROM (SELECT ckey, a AS p FROM e UNION SELECT ckey, b FROM e) GROUP BY ckey),
st(lead, claimed, rest) AS (
  SELECT CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), ps FROM nodes
  UNION ALL
  SELECT st.rest[1], list_filter(coalesce(adj.bs, []), lambda x: list_contains(st.rest, x)),
    list_filter(st.rest, lambda x: x <> st.rest[1] AND NOT list_contains(coalesce(adj.bs, []), x))
  FROM st LEFT JOIN adj ON adj.a = st.rest[1] WHERE len(st.rest) > 0),
led AS (SELECT lead AS rep, lead AS leader FROM st WHERE lead IS NOT NULL
  UNION ALL SELECT unnest(claimed), lead FROM st WHERE lead IS NOT NULL
  UNION ALL SELECT rep, rep FROM cl WHERE n > 1 AND rep NOT IN (SELECT unnest(ps) FROM nodes)),
lead AS MATERIALIZED (SELECT r.pos, led.leader FROM r JOIN cl USING (ckey, tokens) JOIN led USING (rep) WHERE len(tokens) >= 2)"""


_LEADER_SQL = _leader_sql()


@register("ddp_tracker_cluster", ("trk",), f"WITH RECURSIVE {_LEADER_SQL.strip()}\nSELECT pos, leader FROM lead")
def ddp_tracker_cluster(spark, sf):
    """(pos, leader) for every row that has a fuzzy match."""
    return clusters(dedup_tracker(spark, sf))


@register("ddp_tracker_cluster_safe", ("trk_intl",),
          f"WITH RECURSIVE {_leader_sql('trk_intl', Q.company_key_safe_spaced).strip()}\nSELECT pos, leader FROM lead")
def ddp_tracker_cluster_safe(spark, sf):
    """Clusters over company names of any script, blocked by the script-aware key."""
    return clusters(dedup_tracker(spark, sf, "trk_intl", "safe"))


def keep_plan(rows: DataFrame, assign: DataFrame) -> DataFrame:
    """ddp_tracker_keep: keeper = highest score (stable), status promoted to the most advanced."""
    # Written once, for the sizes, the keeper's and the best status and the plan all read it.
    c = cut_table(rows.join(assign, "pos").select("pos", "leader", "status_raw", T.score_loose("score_raw").alias("score"),
                                                  S.status_rank_raw("status_raw").alias("rank")))
    sizes = c.groupBy("leader").agg(F.count(F.lit(1)).alias("n"),
                                    F.max(F.struct("score", (-F.col("pos")).alias("neg_pos"))).alias("k"))
    c = c.join(sizes.where(F.col("n") >= 2), "leader")
    c = c.withColumn("keeper", -F.col("k.neg_pos"))
    keeper_rank = c.where(F.col("pos") == F.col("keeper")).select("leader", F.col("rank").alias("keeper_rank"),
                                                                F.col("status_raw").alias("keeper_status"))
    # first (score desc, pos asc) among non-keepers with the best rank above the keeper's
    best = (c.where(F.col("pos") != F.col("keeper"))
            .groupBy("leader").agg(F.max(F.struct("rank", "score", (-F.col("pos")).alias("np"), "status_raw")).alias("b")))
    plan = c.join(keeper_rank, "leader").join(best, "leader", "left")
    promoted = F.when(F.col("b.rank") > F.col("keeper_rank"), F.col("b.status_raw")).otherwise(F.col("keeper_status"))
    return plan.select(
        "pos", "leader", "keeper",
        F.when(F.col("pos") == F.col("keeper"), "keep").otherwise("remove").alias("action"),
        F.when(F.col("pos") == F.col("keeper"), promoted).alias("status"),
    )


@register("ddp_tracker_keep", ("trk",), f"""WITH RECURSIVE {_LEADER_SQL.strip()},
c AS MATERIALIZED (SELECT lead.pos, leader, {Q.score_loose('score_raw')} AS score, {Q.status_rank_raw('status_raw')} AS rank, status_raw FROM lead JOIN r ON r.pos = lead.pos),
k AS (SELECT *, first_value(pos) OVER (PARTITION BY leader ORDER BY score DESC, pos) AS keeper, count(*) OVER (PARTITION BY leader) AS n FROM c),
kr AS (SELECT leader, rank AS krank, status_raw AS kstatus FROM k WHERE pos = keeper),
b AS (SELECT leader, rank AS brank, status_raw AS bstatus FROM k WHERE pos <> keeper
  QUALIFY row_number() OVER (PARTITION BY leader ORDER BY rank DESC, score DESC, pos) = 1)
SELECT pos, k.leader, keeper, CASE WHEN pos = keeper THEN 'keep' ELSE 'remove' END AS action,
  CASE WHEN pos = keeper THEN CASE WHEN brank > krank THEN bstatus ELSE kstatus END END AS status
FROM k JOIN kr USING (leader) LEFT JOIN b USING (leader) WHERE n >= 2""")
def ddp_tracker_keep(spark, sf):
    rows = dedup_tracker(spark, sf)
    return keep_plan(rows, clusters(rows))
