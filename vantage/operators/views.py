"""Dashboard views: tab filters, sort modes, weighted ranking and truncation.

A sort result is returned with an explicit ``rank`` column (its position in
the order) computed by the range-partitioned prefix count, so the order
survives any later shuffle and no single task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from .prefix import row_number_global

TABS = ["all", "evaluated", "applied", "interview", "top", "skip", "rejected", "discarded"]
TAB_LABELS = ["ALL", "EVALUATED", "APPLIED", "INTERVIEW", "TOP ≥4", "SKIP", "REJECTED", "DISCARDED"]


def tab_predicate(tab: str, status: Column, score: Column) -> Column:
    if tab == "all":
        return F.lit(True)
    if tab == "top":
        return (score >= 4.0) & (status != "skip")
    return status == tab


def flt_view_tab(apps: DataFrame, status: str = "status", score: str = "score") -> DataFrame:
    """flt_view_tab: a row per tab that shows the application (all / top: score ≥ 4 and not skip / status equals the tab)."""
    s, sc = F.col(status), F.col(score)
    shown = F.filter(F.array(*[F.when(tab_predicate(t, s, sc), F.lit(t)) for t in TABS]), lambda x: x.isNotNull())
    return apps.select("*", F.explode(shown).alias("tab"))


def tab_counts(apps: DataFrame, status: str = "status", score: str = "score") -> DataFrame:
    """agg_tab_counts: one pass of conditional counts, unpivoted to (tab, label, count)."""
    s, sc = F.col(status), F.col(score)
    c = apps.agg(*[F.count_if(tab_predicate(t, s, sc)).alias(t) for t in TABS])
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("tab_order"), F.lit(t).alias("tab"), F.lit(lbl).alias("label"), F.col(t).alias("count"))
        for i, (t, lbl) in enumerate(zip(TABS, TAB_LABELS))
    ])))


SORT_MODES = ["score", "date", "company", "status"]


def srt_view(apps: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """srt_view: (mode, grouped, pos, rank) of every application in each sort mode, plain and grouped by status.

    All orders are ranked in one pass over narrow rows: a row per mode carries the keys its order uses and
    nulls for the others.  Ties keep file order (stable sort), so ``pos`` closes every order.
    """
    def keys(mode: str, grouped: bool) -> Column:
        use = {mode} | ({"status"} if grouped else set())
        if grouped and mode == "status":
            use.add("score")
        pick = lambda k, c, t: (c if k in use else F.lit(None)).cast(t)
        return F.struct(F.lit(mode).alias("mode"), F.lit(grouped).alias("grouped"), pick("status", F.col("_pri"), "int").alias("k_pri"),
                        pick("score", F.col("score"), "double").alias("k_score"), pick("date", F.col("date"), "string").alias("k_date"),
                        pick("company", F.lower("company"), "string").alias("k_company"))

    rows = apps.select("pos", "score", "date", "company", S.status_priority("status_raw").alias("_pri"))
    wide = rows.select("pos", F.explode(F.array(*[keys(m, g) for m in modes or SORT_MODES for g in (False, True)])).alias("k")).select("pos", "k.*")
    order = [F.col("k_pri").asc(), F.col("k_score").desc(), F.col("k_date").desc(), F.col("k_company").asc(), F.col("pos").asc()]
    return row_number_global(wide, order, "rank", ["mode", "grouped"]).select("mode", "grouped", "pos", "rank")


# Fixed values (offer scoring matrix weights, percent).
OFFER_WEIGHTS = {
    "target": 25, "match": 15, "level": 15, "pay": 10, "growth": 10,
    "remote": 5, "reputation": 5, "stack": 5, "speed": 5, "culture": 5,
}
# Fixed values (project scoring matrix weights, percent).
PROJECT_WEIGHTS = {"signal": 25, "uniqueness": 20, "demo": 20, "metrics": 15, "time": 10, "story": 10}


def weighted_score(weights: dict[str, int]) -> Column:
    total = None
    for dim, w in weights.items():
        term = F.col(dim).cast("double") * F.lit(float(w))
        total = term if total is None else total + term
    return total / F.lit(100.0)


def top_weighted_rank(df: DataFrame, weights: dict[str, int]) -> DataFrame:
    """top_weighted_rank: weighted score (2 dp) and its rank, highest first, ties by ``pos``."""
    scored = df.withColumn("weighted", F.round(weighted_score(weights), 2))
    return row_number_global(scored, [F.col("weighted").desc(), F.col("pos").asc()], "rank")
