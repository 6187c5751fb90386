"""Data-quality checks.  Each returns ``(check, severity, key, detail)`` rows so
that all checks union into one report and ``dq_summary`` is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T

FINDING_COLS = ["check", "severity", "key", "detail"]


def _finding(df: DataFrame, check: str, severity: str, key, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                     key.cast("string").alias("key"), detail.alias("detail"))


CANONICAL_LOWER = ["evaluated", "applied", "responded", "interview", "offer", "rejected", "discarded", "skip"]


def dq_status(apps: DataFrame) -> DataFrame:
    """Non-canonical status, bold in status, date in status (one row per flag)."""
    clean = S.status_clean("status_raw")
    flags = F.array(
        F.when(~clean.isin(*CANONICAL_LOWER) & ~clean.isin(*S.ALIASES.keys()), F.lit("non_canonical")),
        F.when(F.col("status_raw").contains("**"), F.lit("bold")),
        F.when(F.col("status_raw").rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit("date")),
    )
    exploded = apps.select("num", "status_raw", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("flag"))
    return exploded.select(F.lit("status").alias("check"), F.lit("error").alias("severity"),
                           F.col("num").cast("string").alias("key"),
                           F.concat(F.col("flag"), F.lit(": "), F.col("status_raw")).alias("detail"))


def duplicate_key():
    return F.concat(T.company_key_alnum("company"), F.lit("::"),
                    F.regexp_replace(F.lower(F.col("role")), r"[^a-z0-9 ]", ""))


def dq_duplicates(apps: DataFrame) -> DataFrame:
    """One finding per normalised company::role that several rows share: how many, the smallest and the largest number.

    Counts and ends are map-side-combined, so a hot key never has to be materialised as one list.
    """
    groups = (apps.groupBy(duplicate_key().alias("dup_key"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("first"), F.max("num").alias("last")).where(F.col("n") > 1))
    return _finding(groups, "duplicates", "warning", F.col("dup_key"),
                    F.concat(F.col("n").cast("string"), F.lit(" rows, #"), F.col("first").cast("string"), F.lit(" to #"), F.col("last").cast("string")))


def duplicate_members(apps: DataFrame) -> DataFrame:
    """(dup_key, num) of every row of the groups that ``dq_duplicates`` finds: rows joined to their group, no list is collected."""
    rows = apps.select(duplicate_key().alias("dup_key"), "num")
    groups = rows.groupBy("dup_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return rows.join(groups.select("dup_key"), "dup_key").select("dup_key", "num")


def dq_report_links(apps: DataFrame, listing: DataFrame) -> DataFrame:
    """Report links whose target is not in the file listing (``path`` column)."""
    linked = apps.select("num", T.report_path("report").alias("path")).where(F.col("path").isNotNull())
    missing = linked.join(listing.select("path").distinct(), "path", "left_anti")
    return _finding(missing, "report_links", "error", F.col("num"), F.col("path"))


def dq_score_format(apps: DataFrame) -> DataFrame:
    s = T.js_trim(T.strip_bold(F.col("score_raw")))
    bad = apps.where(~s.rlike(r"^[0-9]+\.?[0-9]*/5$") & (s != "N/A") & (s != "DUP"))
    return _finding(bad, "score_format", "error", F.col("num"), F.col("score_raw"))


def dq_bold_score(apps: DataFrame) -> DataFrame:
    bad = apps.where(F.col("score_raw").contains("**"))
    return _finding(bad, "bold_score", "warning", F.col("num"), F.col("score_raw"))


def dq_row_format(lines: DataFrame) -> DataFrame:
    """Pipe lines with fewer than 9 split parts (separator / header lines skipped)."""
    ln = F.col("line")
    bad = lines.where(ln.startswith("|") & ~ln.contains("---") & ~ln.contains("Empresa")
                      & (F.size(F.split(ln, r"\|", -1)) < 9))
    return _finding(bad, "row_format", "error", F.col("pos"), ln)


def dq_pending_files(files: DataFrame) -> DataFrame:
    """Unmerged addition files (one warning row with the count when any exist)."""
    c = files.where(F.col("file").endswith(".tsv")).agg(F.count(F.lit(1)).alias("n"))
    return _finding(c.where(F.col("n") > 0), "pending_files", "warning", F.lit("tracker-additions"),
                    F.concat(F.col("n").cast("string"), F.lit(" pending TSVs")))


def finding_counts(apps: DataFrame) -> DataFrame:
    """(errors, warnings) of the checks that look at one row at a time: status, score format and bold scores in one scan."""
    clean, score = S.status_clean("status_raw"), T.js_trim(T.strip_bold(F.col("score_raw")))
    one = lambda c: F.when(c, 1).otherwise(0)
    errors = (one(~clean.isin(*CANONICAL_LOWER) & ~clean.isin(*S.ALIASES.keys())) + one(F.col("status_raw").contains("**"))
              + one(F.col("status_raw").rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"))
              + one(~score.rlike(r"^[0-9]+\.?[0-9]*/5$") & (score != "N/A") & (score != "DUP")))
    return apps.agg(F.sum(errors).alias("errors"), F.sum(one(F.col("score_raw").contains("**"))).alias("warnings"))


def dq_summary(counts: DataFrame, findings: list[DataFrame]) -> DataFrame:
    """errors, warnings, verdict clean / warn / error, from counts and findings of several checks."""
    parts = counts.select("errors", "warnings")
    for f in findings:
        parts = parts.unionByName(f.agg(F.count_if(F.col("severity") == "error").alias("errors"),
                                        F.count_if(F.col("severity") == "warning").alias("warnings")))
    c = parts.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return c.select("errors", "warnings",
                    F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warn")
                    .otherwise("clean").alias("verdict"))
