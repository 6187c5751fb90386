"""Merge of tracker additions: duplicate matching, update / skip / lost / insert, numbering.

Matching is three lookups of a first tracker row (by report number, by entry
number, by company block + fuzzy role), each tagged with its tier; the duplicate
of an addition is the minimum of (tier, tracker position).  Inserts are numbered with the
closed form of the reference's running maximum,
``n_k = k + max(max0, max_{j<=k}(num_j - j))``, evaluated with range-partitioned
prefix scans (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_table
from . import fuzzy as FZ
from .first_match import first_match
from .skew import lookup


def merge_view(tracker: DataFrame) -> DataFrame:
    """Tracker rows the merge can see: header-like rows (``---`` / ``Empresa``) are invisible."""
    return tracker.where(~F.col("line").contains("---") & ~F.col("line").contains("Empresa"))


def _keyed(rows: DataFrame, key: str, policy: str) -> DataFrame:
    return rows.select(key, "num", T.report_number("report").alias("rnum"), T.MERGE_KEYS[policy]("company").alias("ckey"),
                       FZ.merge_tokens("role").alias("tokens"))


def dup_priority(adds: DataFrame, existing: DataFrame, policy: str = "parity") -> DataFrame:
    """join_dup_priority: (add_id, target_pos, tier) for additions that match a tracker row.

    Every tier looks up the first tracker row of a key, never row pairs.  ``policy`` chooses the company
    key of the role tier: ``parity`` keeps ASCII letters and digits, so that all names of other scripts
    are one company; ``safe`` keeps the letters of every script.
    """
    e, a = cut_table(_keyed(existing, "pos", policy)), cut_table(_keyed(adds, "add_id", policy))
    by_report = e.where("rnum is not null").groupBy("rnum").agg(F.min("pos").alias("pos"))
    by_entry = e.where("num is not null").groupBy("num").agg(F.min("pos").alias("pos"))
    t1 = lookup(a.where("rnum <> 0").select("add_id", "rnum"), by_report, ["rnum"]).select("add_id", "pos", F.lit(1).alias("tier"))
    t2 = lookup(a.where("num is not null").select("add_id", "num"), by_entry, ["num"]).select("add_id", "pos", F.lit(2).alias("tier"))
    settled = cut_table(t1.unionByName(t2).groupBy("add_id").agg(F.min(F.struct("tier", "pos")).alias("b")).select("add_id", "b.*"))
    # Only additions that neither number settles are matched by role.
    rest = a.join(settled, "add_id", "left_anti")
    t3 = first_match(cut_table(rest.select("add_id", "ckey", "tokens")), e.select("pos", "ckey", "tokens"), "ckey", "tokens", "add_id", "pos")
    return settled.unionByName(t3.select("add_id", F.lit(3).alias("tier"), "pos")).select("add_id", F.col("pos").alias("target_pos"), "tier")


def entry_numbers(inserts: DataFrame, max0: DataFrame, order_col: str = "add_order") -> DataFrame:
    """win_entry_number: number every insert; ``max0`` is a one-row frame with column ``max0``."""
    # One pass: with local ranks, the running maximum of num - k is that of num - local k less the rows before.
    parts = int(inserts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_table(inserts.repartitionByRange(parts, order_col).withColumn("_pid", F.spark_partition_id()))
    so_far = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_lk", F.row_number().over(so_far).cast("long"))
    local = local.withColumn("_lg", F.max(F.col("num").cast("long") - F.col("_lk")).over(so_far))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    carry = (local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.max("_lg").alias("_m"))
             .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .withColumn("_g", F.max(F.col("_m") - F.col("_off")).over(before)))
    carry = carry.withColumn("_one", F.lit(1)).join(F.broadcast(max0.withColumn("_one", F.lit(1))), "_one").drop("_one")
    j = local.join(F.broadcast(carry), "_pid").withColumn("k", F.col("_off") + F.col("_lk"))
    gap = F.greatest(F.coalesce(F.col("max0"), F.lit(0)).cast("long"), F.col("_g"), F.col("_lg") - F.col("_off"))
    return j.select(*inserts.columns, "k", (F.col("k") + gap).alias("entry_num"))


def upsert(adds: DataFrame, existing: DataFrame, policy: str = "parity") -> DataFrame:
    """upsert_tracker action log: update (first qualifying), skip, lost, insert (numbered)."""
    dup = dup_priority(adds, existing, policy)
    a = adds.join(dup, "add_id", "left")
    ex = existing.select(F.col("pos").alias("target_pos"), F.col("num").alias("target_num"),
                         T.score_loose("score_raw").alias("old_score"))
    a = cut_table(a.join(ex, "target_pos", "left").withColumn("new_score", T.score_loose("score_raw")))
    matched = a.where(F.col("target_pos").isNotNull())
    better = matched.where(F.col("new_score") > F.col("old_score"))
    first_upd = better.groupBy("target_pos").agg(F.min("add_order").alias("first_order"))
    m = matched.join(first_upd, "target_pos", "left")
    acted = m.select(
        "add_order", "add_id", "file", "target_pos", "tier", "old_score", "new_score",
        F.when(F.col("new_score") <= F.col("old_score"), "skip")
        .when(F.col("add_order") == F.col("first_order"), "update").otherwise("lost").alias("action"),
        F.col("target_num").cast("long").alias("entry_num"),
    )
    ins = a.where(F.col("target_pos").isNull()).select("add_order", "add_id", "file", "num")
    max0 = existing.agg(F.max("num").alias("max0"))
    numbered = entry_numbers(ins, max0).select(
        "add_order", "add_id", "file", F.lit(None).cast("long").alias("target_pos"), F.lit(None).cast("int").alias("tier"),
        F.lit(None).cast("double").alias("old_score"), F.lit(None).cast("double").alias("new_score"),
        F.lit("insert").alias("action"), "entry_num")
    return acted.unionByName(numbered.withColumn("new_score", F.col("new_score")))


TRACKER_COLUMNS = ["num", "date", "company", "role", "score_raw", "status_raw", "pdf", "report", "notes"]


def merged_tracker(adds: DataFrame, existing: DataFrame, log: DataFrame) -> DataFrame:
    """The tracker after the merge: (pos, origin, columns), ``pos`` null for inserted rows.

    An update keeps the old number, status and pdf and notes the re-evaluation; inserted rows have the
    number the log gave them.
    """
    new = adds.select("add_id", *[F.col(c).alias("new_" + c) for c in ("date", "company", "role", "score_raw", "report", "notes")])
    upd = log.where("action = 'update'").select(F.col("target_pos").alias("pos"), "add_id", "old_score", F.col("new_score").alias("newer")).join(new, "add_id")
    j = existing.select("pos", *TRACKER_COLUMNS).join(upd, "pos", "left")
    hit = F.col("add_id").isNotNull()
    note = F.concat(F.lit("Re-eval "), "new_date", F.lit(" ("), T.js_number("old_score"), F.lit("→"), T.js_number("newer"), F.lit("). "), "new_notes")
    pick = lambda c: F.when(hit, F.col("new_" + c)).otherwise(F.col(c)).alias(c)
    kept = j.select("pos", F.when(hit, "updated").otherwise("kept").alias("origin"), F.col("num").cast("long").alias("num"), pick("date"), pick("company"),
                    pick("role"), pick("score_raw"), "status_raw", "pdf", pick("report"), F.when(hit, note).otherwise(F.col("notes")).alias("notes"))
    ins = log.where("action = 'insert'").select("add_id", F.col("entry_num").alias("num")).join(adds.drop("num"), "add_id").select(
        F.lit(None).cast("long").alias("pos"), F.lit("inserted").alias("origin"), "num", "date", "company", "role", "score_raw",
        F.col("status").alias("status_raw"), "pdf", "report", "notes")
    return kept.select(F.col("pos").cast("long").alias("pos"), "origin", *TRACKER_COLUMNS).unionByName(ins)
