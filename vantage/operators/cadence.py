"""Follow-up cadence: urgency, next follow-up date, contacts.

Follow-ups are pre-aggregated per application (count, latest date) before
the join, so the join is one row per application on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D

# Fixed values (cadence in days).
CADENCE = {
    "applied_first": 7,
    "applied_subsequent": 7,
    "applied_max_followups": 2,
    "responded_initial": 1,
    "responded_subsequent": 3,
    "interview_thankyou": 1,
}
URGENCY_ORDER = {"urgent": 0, "overdue": 1, "waiting": 2, "cold": 3}
ACTIONABLE = ["applied", "responded", "interview"]


def followup_summary(fol: DataFrame) -> DataFrame:
    """Per application: follow-up count and the latest follow-up date string."""
    return fol.groupBy("app_num").agg(F.count(F.lit(1)).alias("followup_count"),
                                      F.max("date").alias("last_followup"))


def join_followups(apps: DataFrame, fol: DataFrame) -> DataFrame:
    """join_followups: tracker ⟕ per-application follow-up aggregate."""
    s = followup_summary(fol).withColumnRenamed("app_num", "num")
    return (apps.join(s, "num", "left")
            .withColumn("followup_count", F.coalesce(F.col("followup_count"), F.lit(0)).cast("int")))


def urgency(status: Column, days_app: Column, days_fu: Column, n: Column, cad: dict = CADENCE) -> Column:
    """cls_urgency."""
    applied = (F.when(n >= cad["applied_max_followups"], "cold")
               .when((n == 0) & (days_app >= cad["applied_first"]), "overdue")
               .when((n > 0) & days_fu.isNotNull() & (days_fu >= cad["applied_subsequent"]), "overdue")
               .otherwise("waiting"))
    responded = (F.when(days_app < cad["responded_initial"], "urgent")
                 .when(days_app >= cad["responded_subsequent"], "overdue").otherwise("waiting"))
    interview = F.when(days_app >= cad["interview_thankyou"], "overdue").otherwise("waiting")
    return (F.when(status == "applied", applied).when(status == "responded", responded)
            .when(status == "interview", interview).otherwise("waiting"))


def next_followup(status: Column, app_date: Column, last_fu: Column, n: Column, cad: dict = CADENCE) -> Column:
    """dat_next_followup: the next date by status (null when cold or not actionable)."""
    applied = (F.when(n >= cad["applied_max_followups"], F.lit(None).cast("date"))
               .when(n == 0, F.date_add(app_date, cad["applied_first"]))
               .when(last_fu.isNotNull(), F.date_add(last_fu, cad["applied_subsequent"]))
               .otherwise(F.date_add(app_date, cad["applied_first"])))
    responded = F.coalesce(F.date_add(last_fu, cad["responded_subsequent"]),
                           F.date_add(app_date, cad["responded_subsequent"]))
    return (F.when(status == "applied", applied).when(status == "responded", responded)
            .when(status == "interview", F.date_add(app_date, cad["interview_thankyou"])))


def cadence(apps: DataFrame, fol: DataFrame, as_of: str) -> DataFrame:
    """Actionable applications with urgency, next date and days until it."""
    now = F.lit(as_of).cast("date")
    act = apps.where(F.col("status").isin(*ACTIONABLE)).withColumn("app_date", D.parse_strict("date")) \
        .where(F.col("app_date").isNotNull())
    j = join_followups(act, fol)
    last_d = D.parse_strict("last_followup")
    days_app = F.datediff(now, F.col("app_date"))
    days_fu = F.datediff(now, last_d)
    nxt = next_followup(F.col("status"), F.col("app_date"), last_d, F.col("followup_count"))
    return j.select(
        "pos", "num", "date", "company", "role", "status",
        days_app.alias("days_since_application"),
        days_fu.alias("days_since_last_followup"),
        "followup_count",
        urgency(F.col("status"), days_app, days_fu, F.col("followup_count")).alias("urgency"),
        nxt.alias("next_followup_date"),
        F.datediff(nxt, now).alias("days_until_next"),
    )


def urgency_rank(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in URGENCY_ORDER.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(9))
