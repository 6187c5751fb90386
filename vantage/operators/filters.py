"""Row filters and predicate rules (title, posting reasons, queue eligibility, evidence floor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def min_evidence(apps: DataFrame, threshold: int = 5, status: str = "status") -> DataFrame:
    """flt_min_evidence: rows beyond ``evaluated`` against the floor (one row)."""
    c = apps.agg(F.count_if(F.col(status) != "evaluated").alias("current"))
    return c.select("current", F.lit(threshold).alias("threshold"),
                    (F.col("current") >= threshold).alias("enough"))


def title_predicate(title: Column, positive: list[str], negative: list[str]) -> Column:
    """flt_title: (no positives or any positive) and no negative, on whitespace-collapsed lower case.

    Terms are normalised the same way, so ``"Java "`` becomes ``java`` and blocks JavaScript.
    """
    t = T.normalize_lower(title)
    pos = [p.strip().lower() for p in positive]
    neg = [n.strip().lower() for n in negative]
    pos = [" ".join(p.split()) for p in pos]
    neg = [" ".join(n.split()) for n in neg]
    ok_pos = F.lit(True) if not pos else T.any_contains(t, pos)
    ok_neg = F.lit(True) if not neg else ~T.any_contains(t, neg)
    return ok_pos & ok_neg
