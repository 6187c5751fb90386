"""Ordered-greedy operators evaluated in rounds instead of one sequential pass.

* ``two_key_accept`` - an offer is accepted iff no earlier *accepted* offer
  shares its url or its company::title key.  Each round accepts the rows that
  are the earliest undecided row of both their url group and key group, then
  rejects undecided rows sharing a key with them.
* ``leader_clusters`` - greedy leader clustering over "earlier matches later"
  edges: a row leads iff no earlier neighbour leads; a member joins its
  earliest leading neighbour.  Each round marks members (an earlier neighbour
  leads) and then leaders (every earlier neighbour is a member).

Both equal the sequential algorithm.  Rounds are group minima and semi joins
(a few shuffles each); the undecided state is checkpointed into the shared
checkpoint folder every round, so lineage stays short and a lost executor
only recomputes one round.  Only the undecided count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import logging

from ..session import cut_table, scratch_path

log = logging.getLogger(__name__)


def two_key_accept(df: DataFrame, order: str, key1: str, key2: str) -> DataFrame:
    """Return ``df`` with boolean ``accepted`` (``order`` unique; keys non-null).

    A round accepts the rows that are first under both of their keys and drops every row that shares a
    key with one.  The loop carries (order, key1, key2) alone.  Firsts are found by joining (key, order)
    pairs, so a hot key brings one row to a join; accepted rows are appended to one table.
    """
    undecided = cut_table(df.select(order, key1, key2))
    accepted = scratch_path(df.sparkSession)
    df.select(order, key1, key2).where(F.lit(False)).write.parquet(accepted)
    rounds = 0
    while not undecided.isEmpty():
        rounds += 1
        first1 = undecided.groupBy(key1).agg(F.min(order).alias(order))
        first2 = undecided.groupBy(key2).agg(F.min(order).alias(order))
        acc = cut_table(undecided.join(first1, [key1, order], "left_semi").join(first2, [key2, order], "left_semi")
                        .select(order, key1, key2))
        acc.write.mode("append").parquet(accepted)
        undecided = cut_table(undecided.join(acc.select(key1), key1, "left_anti").join(acc.select(key2), key2, "left_anti"))
    log.info("two_key_accept: %d rounds", rounds)
    flags = df.sparkSession.read.schema(undecided.schema).parquet(accepted).select(order, F.lit(True).alias("accepted"))
    return df.join(flags, order, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def leader_clusters(nodes: DataFrame, edges: DataFrame, node: str = "pos") -> DataFrame:
    """Assign ``leader`` to every node.

    ``nodes`` has the ``node`` id column; ``edges`` has ``a`` (earlier) and
    ``b`` (later) node ids, meaning "a matches b".  Returns ``(node, leader)``
    where leaders map to themselves.
    """
    state = cut_table(nodes.select(F.col(node).alias("id")).distinct().withColumn("st", F.lit("U")))
    e = cut_table(edges.select("a", "b").distinct())
    rounds = 0
    while True:
        undecided = state.where(F.col("st") == "U")
        if undecided.isEmpty():
            break
        rounds += 1
        leaders = state.where(F.col("st") == "L").select(F.col("id").alias("a"))
        # (1) undecided rows with a leading earlier neighbour become members
        new_members = (e.join(leaders, "a").select(F.col("b").alias("id")).distinct()
                       .join(undecided.select("id"), "id"))
        s1 = (state.join(new_members.withColumn("_m", F.lit(True)), "id", "left")
              .select("id", F.when(F.col("_m"), F.lit("M")).otherwise(F.col("st")).alias("st")))
        # (2) undecided rows whose earlier neighbours are all members become leaders
        not_member = s1.where(F.col("st") != "M").select(F.col("id").alias("a"))
        blocked = e.join(not_member, "a").select(F.col("b").alias("id")).distinct()
        new_leaders = s1.where(F.col("st") == "U").select("id").join(blocked, "id", "left_anti")
        s2 = (s1.join(new_leaders.withColumn("_l", F.lit(True)), "id", "left")
              .select("id", F.when(F.col("_l"), F.lit("L")).otherwise(F.col("st")).alias("st")))
        state = cut_table(s2)
    log.info("leader_clusters: %d rounds", rounds)
    leaders = state.where(F.col("st") == "L").select(F.col("id").alias("a"))
    member_of = (e.join(leaders, "a").join(state.where(F.col("st") == "M").select(F.col("id").alias("b")), "b")
                 .groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "id"))
    out = state.join(member_of, "id", "left").select(
        F.col("id").alias(node), F.when(F.col("st") == "L", F.col("id")).otherwise(F.col("leader")).alias("leader"))
    return out
