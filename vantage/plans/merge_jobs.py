"""Merge jobs: additions reader, file order, duplicate tiers, fuzzy role join, upsert, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T
from ..operators import first_match as FM
from ..operators import fuzzy as FZ
from ..operators import upsert as U
from ..operators.prefix import row_number_global
from ..sources import additions as AD
from ..session import cut_table
from ..sources import tracker as TR
from ..sources.bindings import view
from . import sqlrules as Q
from .registry import register


def additions(spark, sf, name: str = "adds") -> DataFrame:
    parsed = AD.src_additions(view(spark, sf, name))
    keyed = parsed.withColumn("_k", AD.file_order_key()).withColumn("add_id", F.col("file_no"))
    # Written before it is ranked: a range partitioning reads its input twice, once for the bounds.  Only the order
    # key and the row's number in that table are ranked, so that whole rows are shuffled once, to meet their rank.
    written = cut_table(keyed.withColumn("_row", F.monotonically_increasing_id()))
    ranks = row_number_global(written.select("_row", "_k", "file"), ["_k", "file"], "add_order").select("_row", "add_order")
    return written.drop("_k").join(ranks, "_row").drop("_row")


def merge_tracker(spark, sf, name: str = "trk") -> DataFrame:
    """The tracker as the merge sees it, materialised once (matched three ways, then joined back)."""
    lines = U.merge_view(TR.render_tracker(view(spark, sf, name)))
    return cut_table(TR.src_pipe_table(lines, "nonzero"))


def _stop_sql(words):
    return "[" + ", ".join(Q.q(w) for w in sorted(set(words))) + "]"


MERGE_TOKENS_SQL = (
    "list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), "
    "lambda w: length(w) > 3 AND NOT list_contains(" + _stop_sql(FZ.MERGE_STOPWORDS) + ", w))")
DEDUP_TOKENS_SQL = (
    "list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[()]', ' ', 'g'), "
    "'\\s+', ' ', 'g'), '[^a-z0-9 /]', '', 'g')), '\\s+'), "
    "lambda w: length(w) > 2 AND NOT list_contains(" + _stop_sql(FZ.DEDUP_ROLE_STOPWORDS + FZ.DEDUP_LOCATION_STOPWORDS)
    + ", w))")


def _match_sql(lt: str, rt: str) -> str:
    ov = f"len(list_filter({lt}, lambda w: list_contains({rt}, w)))"
    return (f"(len({lt}) > 0 AND len({rt}) > 0 AND {ov} >= 2 AND "
            f"{ov}::DOUBLE / least(len({lt}), len({rt}))::DOUBLE >= 0.6)")


_STATUS_RE = "^(" + "|".join(S.STATUS_PREFIXES) + ")"


def _adds_sql(adds: str = "adds") -> str:
    return f"""
a0 AS (SELECT file_no, file, string_split(trim(line), chr(9)) AS p FROM {adds} WHERE trim(line) <> ''),
a1 AS (SELECT *, trim(p[5]) AS c4, trim(p[6]) AS c5 FROM a0 WHERE len(p) >= 8),
a2 AS (SELECT *, (regexp_matches(c4, '^[0-9]+\\.?[0-9]*/5$') OR c4 IN ('N/A', 'DUP')) AS c4s,
  (regexp_matches(c5, '^[0-9]+\\.?[0-9]*/5$') OR c5 IN ('N/A', 'DUP')) AS c5s,
  regexp_matches(lower(c4), '{_STATUS_RE}') AS c4t, regexp_matches(lower(c5), '{_STATUS_RE}') AS c5t FROM a1),
a3 AS (SELECT file_no, file, TRY_CAST(regexp_extract(p[1], '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) AS num, p[2] AS date, p[3] AS company,
  p[4] AS role, CASE WHEN NOT (c4t AND NOT c4s) AND c4s AND c5t THEN c4 ELSE c5 END AS score_raw,
  {Q.status_strict("CASE WHEN NOT (c4t AND NOT c4s) AND c4s AND c5t THEN c5 ELSE c4 END")} AS status,
  p[7] AS pdf, p[8] AS report, coalesce(p[9], '') AS notes FROM a2),
ad AS (SELECT *, file_no AS add_id,
  row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_replace(file, '[^0-9]', '', 'g'), '') AS BIGINT), 0), file) AS add_order
  FROM a3 WHERE num IS NOT NULL AND num <> 0)"""



def _dup_sql(trk: str = "trk", adds: str = "adds", key=Q.company_key_alnum) -> str:
    return f"""{_adds_sql(adds)},
ex AS MATERIALIZED (SELECT pos, num, score_raw, TRY_CAST(nullif(regexp_extract(report, '\\[([0-9]+)\\]', 1), '') AS INTEGER) AS rnum,
  {key('company')} AS ckey, {MERGE_TOKENS_SQL.format(x='role')} AS tokens FROM {trk} WHERE num <> 0),
ak AS MATERIALIZED (SELECT add_id, num, TRY_CAST(nullif(regexp_extract(report, '\\[([0-9]+)\\]', 1), '') AS INTEGER) AS rnum,
  {key('company')} AS ckey, {MERGE_TOKENS_SQL.format(x='role')} AS tokens FROM ad),
c AS (SELECT ak.add_id, ex.pos, 1 AS tier FROM ak JOIN ex ON ak.rnum = ex.rnum WHERE ak.rnum IS NOT NULL AND ak.rnum <> 0
  UNION ALL SELECT ak.add_id, ex.pos, 2 FROM ak JOIN ex ON ak.num = ex.num
  UNION ALL SELECT ak.add_id, ex.pos, 3 FROM ak JOIN ex ON ak.ckey = ex.ckey WHERE {_match_sql('ak.tokens', 'ex.tokens')}),
dup AS (SELECT add_id, pos AS target_pos, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY add_id ORDER BY tier, pos) AS rn FROM c) WHERE rn = 1)"""


_DUP_SQL = _dup_sql()


def _loose(x: str) -> str:
    return Q.score_loose(x)


def _upsert_sql(trk: str = "trk", adds: str = "adds", key=Q.company_key_alnum) -> str:
    return f"""{_dup_sql(trk, adds, key)},
j AS (SELECT ad.add_order, ad.add_id, ad.file, ad.num, dup.target_pos, dup.tier, ex.num AS target_num,
  {_loose('ex.score_raw')} AS old_score, {_loose('ad.score_raw')} AS new_score
  FROM ad LEFT JOIN dup ON dup.add_id = ad.add_id LEFT JOIN ex ON ex.pos = dup.target_pos),
fu AS (SELECT target_pos, min(add_order) AS first_order FROM j WHERE target_pos IS NOT NULL AND new_score > old_score GROUP BY target_pos),
ins AS (SELECT *, row_number() OVER (ORDER BY add_order) AS k FROM j WHERE target_pos IS NULL),
ins2 AS (SELECT *, max(num - k) OVER (ORDER BY add_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap_max FROM ins),
log AS (
  SELECT j.add_order, j.add_id, j.file, j.target_pos, j.tier, j.old_score, j.new_score,
    CASE WHEN j.new_score <= j.old_score THEN 'skip' WHEN j.add_order = fu.first_order THEN 'update' ELSE 'lost' END AS action,
    CAST(j.target_num AS BIGINT) AS entry_num
  FROM j LEFT JOIN fu ON fu.target_pos = j.target_pos WHERE j.target_pos IS NOT NULL
  UNION ALL
  SELECT add_order, add_id, file, NULL, NULL, NULL, NULL, 'insert',
    CAST(k + greatest((SELECT max(num) FROM {trk} WHERE num <> 0), gap_max) AS BIGINT) FROM ins2)"""


_UPSERT_SQL = _upsert_sql()


@register("src_additions", ("adds",), f"WITH {_adds_sql()} SELECT add_id, add_order, num, date, company, role, score_raw, status, pdf, report, notes FROM ad")
def src_additions(spark, sf):
    return additions(spark, sf).select("add_id", F.col("add_order").cast("long"), "num", "date", "company", "role",
                                       "score_raw", "status", "pdf", "report", "notes")


@register("srt_additions", ("adds",), """
SELECT file, coalesce(TRY_CAST(nullif(regexp_replace(file, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS order_key,
  row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_replace(file, '[^0-9]', '', 'g'), '') AS BIGINT), 0), file) AS rank
FROM adds
""")
def srt_additions(spark, sf):
    files = view(spark, sf, "adds").select("file", AD.file_order_key().alias("order_key"))
    return row_number_global(files, ["order_key", "file"], "rank").withColumn("rank", F.col("rank").cast("long"))


@register("join_dup_priority", ("adds", "trk"), f"WITH {_DUP_SQL} SELECT add_id, target_pos, tier FROM dup")
def join_dup_priority(spark, sf):
    return U.dup_priority(additions(spark, sf), merge_tracker(spark, sf))


@register("join_role_fuzzy", ("adds", "trk"), f"""WITH {_DUP_SQL},
l AS (SELECT ckey, tokens, min(add_id) AS id FROM ak WHERE len(tokens) > 0 GROUP BY ALL),
r AS (SELECT ckey, tokens, min(pos) AS pos FROM ex WHERE len(tokens) > 0 AND ckey IN (SELECT ckey FROM l) GROUP BY ALL)
SELECT 'match' AS kind, id AS add_id, pos FROM l JOIN r ON l.ckey = r.ckey WHERE {_match_sql('l.tokens', 'r.tokens')}
UNION ALL SELECT 'left', add_id, id FROM ak JOIN l USING (ckey, tokens)
UNION ALL SELECT 'right', r.pos, ex.pos FROM ex JOIN r USING (ckey, tokens)""")
def join_role_fuzzy(spark, sf):
    """Matches between classes of equal company key and role, and every row's membership in its class."""
    a = additions(spark, sf).select("add_id", T.company_key_alnum("company").alias("ckey"), FZ.merge_tokens("role").alias("tokens"))
    e = merge_tracker(spark, sf).select("pos", T.company_key_alnum("company").alias("ckey"), FZ.merge_tokens("role").alias("tokens"))
    return FM.match_classes(cut_table(a), cut_table(e), "ckey", "tokens", "add_id", "pos")


def _log(adds: DataFrame, existing: DataFrame, policy: str = "parity") -> DataFrame:
    return U.upsert(adds, existing, policy).select(
        F.col("add_order").cast("long"), "add_id", "file", F.col("target_pos").cast("long"), F.col("tier").cast("int"),
        "old_score", "new_score", "action", F.col("entry_num").cast("long"))


@register("upsert_tracker", ("adds", "trk"), f"WITH {_UPSERT_SQL} SELECT * FROM log")
def upsert_tracker(spark, sf):
    return _log(cut_table(additions(spark, sf)), merge_tracker(spark, sf))


@register("upsert_tracker_safe", ("adds_intl", "trk_intl"),
          f"WITH {_upsert_sql('trk_intl', 'adds_intl', Q.company_key_safe)} SELECT * FROM log")
def upsert_tracker_safe(spark, sf):
    """The merge over company names of any script, matched by the script-aware key."""
    return _log(cut_table(additions(spark, sf, "adds_intl")), merge_tracker(spark, sf, "trk_intl"), "safe")


@register("upsert_tracker_intl", ("adds_intl", "trk_intl"), f"WITH {_upsert_sql('trk_intl', 'adds_intl')} SELECT * FROM log")
def upsert_tracker_intl(spark, sf):
    """The same rows under the parity key, which takes all names without ASCII letters or digits for one company."""
    return _log(cut_table(additions(spark, sf, "adds_intl")), merge_tracker(spark, sf, "trk_intl"))


def _js(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


MERGED_SQL = f"""{_UPSERT_SQL},
tk AS (SELECT *, CASE WHEN pdf = 'yes' THEN '✅' ELSE '❌' END AS mark FROM trk WHERE num <> 0),
up AS (SELECT log.target_pos, ad.*, log.old_score, log.new_score FROM log JOIN ad ON ad.add_id = log.add_id WHERE action = 'update')
SELECT tk.pos, CASE WHEN up.add_id IS NULL THEN 'kept' ELSE 'updated' END AS origin, CAST(tk.num AS BIGINT) AS num, coalesce(up.date, tk.date) AS date,
  coalesce(up.company, tk.company) AS company, coalesce(up.role, tk.role) AS role, coalesce(up.score_raw, tk.score_raw) AS score_raw,
  tk.status_raw, tk.mark AS pdf, CASE WHEN up.add_id IS NULL THEN tk.report ELSE up.report END AS report,
  CASE WHEN up.add_id IS NULL THEN tk.notes ELSE 'Re-eval ' || up.date || ' (' || {_js('up.old_score')} || '→' || {_js('up.new_score')} || '). ' || up.notes END AS notes
FROM tk LEFT JOIN up ON up.target_pos = tk.pos
UNION ALL SELECT NULL, 'inserted', entry_num, date, company, role, score_raw, status, pdf, report, notes FROM log JOIN ad USING (add_id) WHERE action = 'insert'"""


def merged(spark, sf) -> DataFrame:
    adds, existing = cut_table(additions(spark, sf)), merge_tracker(spark, sf)
    return U.merged_tracker(adds, existing, cut_table(U.upsert(adds, existing)))


@register("win_entry_number", ("adds", "trk"), f"WITH {_UPSERT_SQL} SELECT add_id, entry_num FROM log WHERE action = 'insert'")
def win_entry_number(spark, sf):
    log = upsert_tracker(spark, sf)
    return log.where(F.col("action") == "insert").select("add_id", "entry_num")
