"""Preference formatting with DataFrame functions only (operator 3).

A pair of conversations is split at the end of their longest common turn prefix.  The prefix is rendered
once as the prompt; what follows on either side is rendered as a completion, with a mask that says which
characters are trained on (assistant turns) in runs of ``length:flag``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import table

TRAINED_ROLE = "assistant"


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>): turns in order, repeated rows once.

    Null roles and texts are empty strings, a null turn number comes first, several rows with one turn
    number stand in order of role and text, and rows without a conv_id belong to no conversation.
    A conversation is one record, like a document, so its own turns are what one row holds.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
            .agg(F.sort_array(F.collect_set(one)).alias("turns")))


def alternative_pairs(convs: DataFrame) -> DataFrame:
    """Conversations that open with the same turn are alternatives of one another.

    Of each such group the one with the most turns is chosen (ties: the smallest conv_id), and each of
    the others is rejected against it: one pair per conversation, however many share an opening.
    """
    opened = convs.where(F.size("turns") > 0).withColumn("opening", F.xxhash64(F.col("turns")[0]["role"], F.col("turns")[0]["text"]))
    lead = (opened.groupBy("opening").agg(F.max(F.struct(F.size("turns").alias("n"), (-F.col("conv_id")).alias("c"))).alias("m"),
                                          F.count("*").alias("members"))
            .where("members > 1").select("opening", (-F.col("m.c")).alias("chosen_id")))
    picked = lead.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    return (opened.join(picked, "opening").where("conv_id <> chosen_id")
            .where(F.col("chosen")[0]["text"] == F.col("turns")[0]["text"])
            .select(F.lit("alternative").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen",
                    F.col("turns").alias("rejected")))


def stale_pairs(convs: DataFrame) -> DataFrame:
    """A conversation up to its last assistant turn against the same with an earlier answer in that place."""
    at = F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i))
    places = F.filter(at, lambda i: i.isNotNull())
    return (convs.withColumn("places", places).where("size(places) > 1")
            .withColumn("last", F.element_at("places", -1)).withColumn("old", F.element_at("places", -2))
            .withColumn("chosen", F.slice("turns", F.lit(1), F.col("last") + 1))
            .withColumn("rejected", F.concat(F.slice("turns", F.lit(1), F.col("last")),
                                             F.array(F.struct(F.get("turns", F.col("last"))["turn"].alias("turn"),
                                                              F.lit(TRAINED_ROLE).alias("role"),
                                                              F.get("turns", F.col("old"))["text"].alias("text")))))
            .select(F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                    "chosen", "rejected"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Rows kind, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``pairs`` has chosen and rejected as arrays of turns.  Pairs that say the same throughout express no
    preference and give no row; a side that ends where the other goes on has an empty completion and
    mask.  A mask is ``length:flag`` per turn, comma-joined, flag 1 for assistant turns; its lengths add
    up to the completion's characters.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    split = (pairs.withColumn("differs", F.array_position(same, False)).where("differs > 0")
             .withColumn("prompt_turns", F.col("differs") - 1))
    n = F.col("prompt_turns").cast("int")

    def completion(side: str) -> Column:
        return F.slice(F.col(side), n + 1, F.size(side))

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, rendered), "")

    def mask(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", F.length(rendered(t)), F.when(t["role"] == TRAINED_ROLE, "1").otherwise("0"))), ",")

    return split.select("kind", "chosen_id", "rejected_id", "prompt_turns", text(F.slice("chosen", F.lit(1), n)).alias("prompt"),
                        text(completion("chosen")).alias("chosen"), text(completion("rejected")).alias("rejected"),
                        mask(completion("chosen")).alias("chosen_mask"), mask(completion("rejected")).alias("rejected_mask"))


SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
opening AS (SELECT conv_id, n, role, text FROM i WHERE i = 1),
lead AS (
  SELECT role, text, conv_id AS chosen_id FROM opening
  QUALIFY row_number() OVER (PARTITION BY role, text ORDER BY n DESC, conv_id) = 1),
alt AS (
  SELECT 'alternative' AS kind, chosen_id, conv_id AS rejected_id FROM opening JOIN lead USING (role, text) WHERE conv_id <> chosen_id),
answers AS (
  SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM i WHERE role = 'assistant'),
stale AS (
  SELECT a.conv_id, a.i AS last, b.text AS old FROM answers a JOIN answers b ON a.conv_id = b.conv_id AND a.back = 1 AND b.back = 2),
sides AS (
  SELECT kind, chosen_id, rejected_id, 'c' AS side, i.i, i.role, i.text FROM alt JOIN i ON i.conv_id = chosen_id
  UNION ALL SELECT kind, chosen_id, rejected_id, 'r', i.i, i.role, i.text FROM alt JOIN i ON i.conv_id = rejected_id
  UNION ALL SELECT 'stale', s.conv_id, s.conv_id, 'c', i.i, i.role, i.text FROM stale s JOIN i ON i.conv_id = s.conv_id AND i.i <= last
  UNION ALL SELECT 'stale', s.conv_id, s.conv_id, 'r', i.i, i.role, CASE WHEN i.i = last THEN old ELSE i.text END
            FROM stale s JOIN i ON i.conv_id = s.conv_id AND i.i <= last),
places AS (
  SELECT kind, chosen_id, rejected_id, i FROM sides GROUP BY ALL
  HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)),
cut AS (SELECT kind, chosen_id, rejected_id, min(i) AS cut FROM places GROUP BY ALL),
r AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS seg FROM sides JOIN cut USING (kind, chosen_id, rejected_id)),
m AS (SELECT *, length(seg) || ':' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS run FROM r)
SELECT kind, chosen_id, rejected_id, any_value(cut) - 1 AS prompt_turns,
       coalesce(string_agg(seg, '' ORDER BY i) FILTER (WHERE side = 'c' AND i < cut), '') AS prompt,
       coalesce(string_agg(seg, '' ORDER BY i) FILTER (WHERE side = 'c' AND i >= cut), '') AS chosen,
       coalesce(string_agg(seg, '' ORDER BY i) FILTER (WHERE side = 'r' AND i >= cut), '') AS rejected,
       coalesce(string_agg(run, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i >= cut), '') AS chosen_mask,
       coalesce(string_agg(run, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i >= cut), '') AS rejected_mask
FROM m GROUP BY kind, chosen_id, rejected_id
"""


@query("op3_preference_format", SQL)
def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = conversations_as_rows(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return format_preferences(alternative_pairs(convs).union(stale_pairs(convs)))
