"""Equi-joins whose large side may have hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when more than one row in this many has it: fewer keys than this are hot.
HOT_SHARE = 1000
#: A key with fewer rows than this never makes a task uneven.
LEAST_ROWS = 50_000


def lookup(rows: DataFrame, entries: DataFrame, on: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """Inner equi-join of ``rows`` with ``entries``, which has few rows per key.

    Rows with a hot key stay where they are and meet a broadcast of the hot keys' entries, fewer than
    ``HOT_SHARE`` keys by their definition; all others are shuffled by key.  ``rows`` is read twice, so
    give a written table.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    if total <= least:  # no key can be hot
        return rows.join(entries, on)
    hot = counts.where(F.col("_rows") > max(total // HOT_SHARE, least)).select(*on, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(entries.join(F.broadcast(hot.drop("_hot")), on, "left_semi")), on)
    return near.unionByName(marked.where("_hot is null").drop("_hot").join(entries, on))
