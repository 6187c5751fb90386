"""Date column builders.  ``as_of`` is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, js_trim


def parse_strict(c) -> Column:
    """dat_parse: strict ``YYYY-MM-DD`` (after trim) else null."""
    s = js_trim(col(c))
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def parse_compact(c) -> Column:
    """``YYYYMMDD`` -> date, else null."""
    s = col(c)
    return F.when(s.rlike(r"^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd"))


def days_between(start, end) -> Column:
    """dat_days_between: whole days from ``start`` to ``end`` (UTC dates)."""
    return F.datediff(col(end), col(start))


def age_bucket(days: Column) -> Column:
    """cls_posting_age: <30, 30-60, 60+ days."""
    return F.when(days < 30, "fresh").when(days <= 60, "mixed").otherwise("stale")


def cache_state(fetched, as_of: str, max_days: int = 30) -> Column:
    """dat_cache_split: fetched within ``max_days`` -> fresh, else (or no date) stale."""
    d = F.datediff(F.lit(as_of).cast("date"), col(fetched))
    return F.when(d.isNotNull() & (d <= max_days), "fresh").otherwise("stale")
