"""As-of join: each row with the latest event of its key that is not after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running


def latest_before(rows: DataFrame, events: DataFrame, key: str, at: str, row_id: str, event_at: str, event_id: str, value: str) -> DataFrame:
    """(row_id, value) for every row of ``rows``; null where no event of its key came before.

    Rows and events are one sequence by (key, time), events first at equal times and the largest
    ``event_id`` last among them; the last value so far is carried along ranges of that sequence, so a
    key with very many rows or events is cut into ranges like any other.  Null keys and times have no
    event before them.
    """
    mine = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.col(row_id).alias("_id"),
        F.lit(None).cast(events.schema[value].dataType).alias("_value"))
    theirs = events.where(F.col(key).isNotNull() & F.col(event_at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(event_at).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), F.col(event_id).alias("_id"),
        F.col(value).alias("_value"))
    carried = running(theirs.unionByName(mine), ["_at", "_side", "_id"], [("_last", F.col("_value"), "last")], ["_key"])
    found = carried.where("_side = 1").select(F.col("_id").alias(row_id), F.col("_last").alias(value))
    return rows.select(row_id).join(found, row_id, "left")
