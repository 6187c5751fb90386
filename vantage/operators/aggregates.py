"""Aggregations over the tracker, reports, queue and scan results.

Every aggregate is one grouped or global ``agg`` (map-side partial
aggregation, one small shuffle); multi-row results of a global aggregate are
unpivoted with ``inline`` over the one result row, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

APPLIED_STAGE = ["applied", "responded", "interview", "offer", "rejected"]
RESPONDED_STAGE = ["responded", "interview", "offer"]
INTERVIEW_STAGE = ["interview", "offer"]
INACTIVE = ["skip", "rejected", "discarded"]
OUTCOMES = ["positive", "negative", "self_filtered", "pending"]


def safe_pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * F.lit(100.0))


def _rows(*structs: Column) -> Column:
    return F.inline(F.array(*structs))


def cumulative_funnel(apps: DataFrame, status: str = "status") -> DataFrame:
    """agg_cumulative_funnel: five stages, each counting rows that reached it."""
    s = F.col(status)
    c = apps.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s.isin(*APPLIED_STAGE)).alias("applied"),
        F.count_if(s.isin(*RESPONDED_STAGE)).alias("responded"),
        F.count_if(s.isin(*INTERVIEW_STAGE)).alias("interview"),
        F.count_if(s == "offer").alias("offer"),
    )
    a = F.col("applied")

    def stage(i, label, cnt, pct):
        return F.struct(F.lit(i).alias("stage_order"), F.lit(label).alias("stage"),
                        cnt.alias("count"), pct.alias("pct"))

    return c.select(_rows(
        stage(1, "Evaluated", F.col("total"), F.lit(100.0)),
        stage(2, "Applied", a, safe_pct(a, F.col("total"))),
        stage(3, "Responded", F.col("responded"), safe_pct(F.col("responded"), a)),
        stage(4, "Interview", F.col("interview"), safe_pct(F.col("interview"), a)),
        stage(5, "Offer", F.col("offer"), safe_pct(F.col("offer"), a)),
    ))


def rates(apps: DataFrame, status: str = "status", score: str = "score") -> DataFrame:
    """agg_rates: response / interview / offer rate over applied, offers, active, avg/top score."""
    s = F.col(status)
    sc = F.col(score)
    c = apps.agg(
        F.count_if(s.isin(*APPLIED_STAGE)).alias("applied"),
        F.count_if(s.isin(*RESPONDED_STAGE)).alias("responded"),
        F.count_if(s.isin(*INTERVIEW_STAGE)).alias("interview"),
        F.count_if(s == "offer").alias("total_offers"),
        F.count_if(~s.isin(*INACTIVE)).alias("active_apps"),
        F.avg(F.when(sc > 0, sc)).alias("avg_score"),
        F.max(F.when(sc > 0, sc)).alias("top_score"),
    )
    a = F.col("applied")

    def rate(x):
        return F.when(a > 0, F.col(x).cast("double") / a.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))

    return c.select(
        rate("responded").alias("response_rate"),
        rate("interview").alias("interview_rate"),
        rate("total_offers").alias("offer_rate"),
        "total_offers", "active_apps",
        F.coalesce(F.col("avg_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.col("top_score"), F.lit(0.0)).alias("top_score"),
    )


# Fixed values (dashboard score bands: label, lower bound; scores <= 0 excluded).
SCORE_BANDS = [("4.5-5.0", 4.5), ("4.0-4.4", 4.0), ("3.5-3.9", 3.5), ("3.0-3.4", 3.0), ("  <3.0", None)]


def score_band(score: Column) -> Column:
    out = None
    for label, lo in SCORE_BANDS:
        if lo is None:
            out = out.otherwise(F.lit(label))
        else:
            out = (F.when if out is None else out.when)(score >= lo, F.lit(label))
    return F.when(score > 0, out)


def score_buckets(apps: DataFrame, score: str = "score") -> DataFrame:
    """agg_score_buckets: five fixed bands, zero-count bands included (one pass, no join)."""
    sc = F.col(score)
    aggs = []
    for i, (label, lo) in enumerate(SCORE_BANDS):
        hi = SCORE_BANDS[i - 1][1] if i > 0 else None
        cond = sc > 0
        if lo is not None:
            cond = cond & (sc >= lo)
        if hi is not None:
            cond = cond & (sc < hi)
        aggs.append(F.count_if(cond).alias(f"b{i}"))
    c = apps.agg(*aggs)
    return c.select(_rows(*[
        F.struct(F.lit(i + 1).alias("band_order"), F.lit(label).alias("band"), F.col(f"b{i}").alias("count"))
        for i, (label, _) in enumerate(SCORE_BANDS)
    ]))


def iso_week(d: Column) -> Column:
    """``YYYY-Wnn`` ISO week key."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def weekly_activity(apps: DataFrame, date: str = "date", last_n: int = 8) -> DataFrame:
    """agg_weekly_activity: count per ISO week, the last ``last_n`` weeks that have data."""
    d = F.when(F.col(date).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(F.col(date), "yyyy-MM-dd"))
    weeks = apps.select(iso_week(d).alias("week")).where(F.col("week").isNotNull()).groupBy("week").count()
    # A top-k report: the number of distinct weeks is small, the limit is the feature.
    return weeks.orderBy(F.col("week").desc()).limit(last_n).select("week", F.col("count"))


def _by_status(apps: DataFrame, status: str, *columns: Column) -> DataFrame:
    """One pass over all rows: a row of the whole (level ``all``) and one per status (level ``status``)."""
    rolled = apps.withColumn("_s", F.coalesce(F.col(status), F.lit(""))).rollup("_s").agg(F.grouping("_s").alias("_all"), *columns)
    return rolled.withColumn("level", F.when(F.col("_all") == 1, "all").otherwise("status")).withColumnRenamed("_s", "status").drop("_all")


def pipeline_metrics(apps: DataFrame, status: str = "status", score: str = "score",
                     has_pdf: str = "has_pdf") -> DataFrame:
    """agg_pipeline_metrics: totals, avg/top score, with pdf, actionable, over all and by status."""
    s, sc = F.col(status), F.col(score)
    return _by_status(
        apps, status,
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(F.when(sc > 0, sc)), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max(F.when(sc > 0, sc)), F.lit(0.0)).alias("top_score"),
        F.count_if(F.col(has_pdf)).alias("with_pdf"),
        F.count_if(~s.isin(*INACTIVE)).alias("actionable"),
    )


def status_counts(apps: DataFrame, status: str = "status") -> DataFrame:
    return apps.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast of exactly one row)."""
    return df.withColumn("_vx_one", F.lit(1)).join(
        F.broadcast(scalars.withColumn("_vx_one", F.lit(1))), "_vx_one").drop("_vx_one")


def status_funnel(apps: DataFrame, status: str = "status") -> DataFrame:
    """agg_status_funnel: count per normalised status and its rounded share of all rows."""
    counts = status_counts(apps, status)
    total = counts.agg(F.sum("count").alias("_total"))  # from the grouped rows: no second pass over the input
    return with_scalars(counts, total).select(
        "status", "count", T.js_round(F.col("count") / F.col("_total") * 100).cast("long").alias("pct"))


def score_by_outcome(apps: DataFrame, outcome: str = "outcome", score: str = "score") -> DataFrame:
    """agg_score_by_outcome: avg (2 dp), min, max, count of scores > 0; all four outcomes present."""
    sc = F.col(score)
    o = F.col(outcome)
    aggs = []
    for name in OUTCOMES:
        v = F.when((o == name) & (sc > 0), sc)
        aggs += [F.avg(v).alias(f"{name}_avg"), F.min(v).alias(f"{name}_min"),
                 F.max(v).alias(f"{name}_max"), F.count(v).alias(f"{name}_n")]
    c = apps.agg(*aggs)
    return c.select(_rows(*[
        F.struct(
            F.lit(name).alias("outcome"),
            F.coalesce(T.round_to(F.col(f"{name}_avg"), 2), F.lit(0.0)).alias("avg"),
            F.coalesce(F.col(f"{name}_min"), F.lit(0.0)).alias("min"),
            F.coalesce(F.col(f"{name}_max"), F.lit(0.0)).alias("max"),
            F.col(f"{name}_n").alias("count"),
        ) for name in OUTCOMES
    ]))


def breakdown(apps: DataFrame, dims: list[str], outcome: str = "outcome") -> DataFrame:
    """Total, per-outcome counts and conversion % per value of each dimension.

    One ``GROUPING SETS`` pass serves all dimensions; ``dimension`` names the
    set a row belongs to, ``value`` its key.
    """
    o = F.col(outcome)
    g = apps.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(o == name).alias(name) for name in OUTCOMES],
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    dim_name = None
    value = None
    for d in dims:
        hit = F.col(f"_g_{d}") == 0
        dim_name = (F.when if dim_name is None else dim_name.when)(hit, F.lit(d))
        value = (F.when if value is None else value.when)(hit, F.col(d))
    return g.select(
        dim_name.alias("dimension"), value.alias("value"), "total", *OUTCOMES,
        F.when(F.col("total") > 0, T.js_round(F.col("positive") / F.col("total") * 100)).otherwise(0)
        .cast("long").alias("conversion_rate"),
    )


def score_threshold(apps: DataFrame, outcome: str = "outcome", score: str = "score") -> DataFrame:
    """agg_score_threshold: lowest positive score floored to 0.1 (3.5 if none) and the range."""
    sc = F.col(score)
    pos = F.when((F.col(outcome) == "positive") & (sc > 0), sc)
    c = apps.agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    lo = F.col("lo")
    return c.select(
        F.when(lo > 0, F.floor(lo * F.lit(10.0)) / F.lit(10.0)).otherwise(F.lit(3.5)).alias("recommended"),
        F.coalesce(lo, F.lit(0.0)).alias("min_positive"),
        F.when(lo.isNotNull(), F.concat(T.js_number(lo), F.lit(" - "), T.js_number(F.col("hi"))))
        .otherwise(F.lit("N/A")).alias("positive_range"),
    )


def analysis_meta(apps: DataFrame, date: str = "date", outcome: str = "outcome") -> DataFrame:
    """agg_analysis_meta: total, first / last non-empty date, count per outcome."""
    d = F.when(F.col(date) != "", F.col(date))
    o = F.col(outcome)
    return apps.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(d).alias("date_from"),
        F.max(d).alias("date_to"),
        *[F.count_if(o == name).alias(name) for name in OUTCOMES],
    )


def tracker_summary(apps: DataFrame, score: str = "score", has_pdf: str = "has_pdf",
                    report_num: str = "report_num", status: str = "status") -> DataFrame:
    """agg_tracker_summary: total, avg score, % with pdf, % with a report link, over all and by status."""
    sc = F.col(score)
    c = _by_status(apps, status, F.count(F.lit(1)).alias("total"),
                   F.coalesce(F.avg(F.when(sc > 0, sc)), F.lit(0.0)).alias("avg_score"),
                   F.count_if(F.col(has_pdf)).alias("pdf_n"),
                   F.count_if(F.col(report_num).isNotNull()).alias("report_n"))
    return c.select("level", "status", "total", F.round("avg_score", 9).alias("avg_score"),
                    safe_pct(F.col("pdf_n"), F.col("total")).alias("pdf_pct"),
                    safe_pct(F.col("report_n"), F.col("total")).alias("report_pct"))
