"""Connected components and exact bucket joins that never expand a bucket into all of its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from every id that has an edge.

    Alternates large-star and small-star steps (group minima and one equi-join each) until the edge
    set is a set of stars.  Self loops and repeated edges are allowed; an empty edge set gives an
    empty result.  The ids may be of any orderable type.
    """
    e = materialise(edges.where(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _is_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialise(small)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _is_stars(e: DataFrame) -> bool:
    """Whether every id is either the centre of a star or has one edge, to a centre."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("centre")).union(
        e.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
    roles = ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return roles.where("child > 1 or (child = 1 and centre = 1)").isEmpty()


def bucket_links(entries: DataFrame, verify, rank: Column, admit: Column | None = None) -> DataFrame:
    """Links (a, b) that span the components of the graph of all verified pairs sharing a bucket.

    ``entries`` has ``bucket`` and ``id`` and any columns that ``rank`` and ``admit`` use.  First every
    member is compared with the one representative of each of its buckets (smallest ``rank``): a row
    per member, not per pair.  The links found give provisional components.  Only buckets that still
    hold two components are joined with themselves, and only pairs from different components are
    compared, so a pair is left out only when its ends are connected already.  ``admit`` is an exact
    pair filter over columns of the two sides, ``l.<column>`` and ``r.<column>``.  ``verify`` maps
    pairs (a, b) to the pairs that are true links.
    """
    entries = materialise(entries)
    reps = entries.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "id")).alias("rep"), F.count("*").alias("members"))
    stars = (entries.select("bucket", "id").join(reps.where("members > 1").select("bucket", F.col("rep.id").alias("rep")), "bucket")
             .where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct())
    links = materialise(verify(stars))
    comp = connected_components(links)
    placed = (entries.join(comp.withColumnRenamed("component", "c"), "id", "left")
              .withColumn("c", F.coalesce("c", "id")))
    placed = materialise(placed)
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    open_rows = placed.join(mixed, "bucket", "left_semi")
    l, r = open_rows.alias("l"), open_rows.alias("r")
    cond = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.c") != F.col("r.c"))
    if admit is not None:
        cond = cond & admit
    rest = l.join(r, cond).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    return materialise(links.union(verify(rest.join(stars, ["a", "b"], "left_anti"))))
