"""First fuzzy match by an index of token subsets instead of row pairs.

A left and a right token list match when the left positions found on the right number at least two and
at least 0.6 of the shorter list.  For lists of up to five tokens two or three shared tokens decide, so the
right side becomes an index (block, subset of one to three tokens, list length) -> first position, one
group minimum over classes of equal lists, and the left side looks its own subsets up: as many lookups as
there are classes and subsets, however many rows or classes a company has.  Pairs of long lists, where
more tokens must be shared, go through verified candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_table
from . import fuzzy as FZ
from .skew import lookup

#: Lists of more distinct tokens have too many subsets to index.
MAX_TOKENS = 12
#: From this length on both sides, four or more tokens must be shared: more than a subset holds.
LONG = 6


def _weight(tokens: Column, token: Column) -> Column:
    return F.size(F.filter(tokens, lambda z: z == token))


def subset_keys(tokens: Column, triples: Column) -> Column:
    """array<struct<key, weight>>: subsets of one, two and (where ``triples``) three distinct tokens.

    The weight is the number of positions of ``tokens`` that hold a token of the subset.
    """
    u = F.array_sort(F.array_distinct(tokens))
    n = F.size(u)

    def entry(*parts: Column) -> Column:
        total = _weight(tokens, parts[0])
        for p in parts[1:]:
            total = total + _weight(tokens, p)
        return F.struct(F.concat_ws(" ", *parts).alias("key"), total.alias("weight"))

    def after(i: Column) -> Column:
        return F.slice(u, i + 2, n)

    one = F.transform(u, lambda x: entry(x))
    two = F.flatten(F.transform(u, lambda x, i: F.transform(after(i), lambda y: entry(x, y))))
    three = F.flatten(F.flatten(F.transform(u, lambda x, i: F.transform(
        after(i), lambda y, j: F.transform(F.slice(u, i + j + 3, n), lambda z: entry(x, y, z))))))
    return F.concat(one, two, F.when(triples, three).otherwise(F.array().cast("array<struct<key:string,weight:int>>")))


def classes(rows: DataFrame, block: str, tokens: str, place: str, name: str) -> DataFrame:
    """(block, tokens, name, n, u): rows of equal block and token list are one class, named by its first row."""
    return (rows.where(F.size(tokens) > 0).groupBy(F.col(block).alias("block"), F.col(tokens).alias("tokens"))
            .agg(F.min(place).alias(name)).withColumn("n", F.size("tokens")).withColumn("u", F.size(F.array_distinct("tokens"))))


def index(right: DataFrame) -> DataFrame:
    """(block, key, size, pos): first position of the lists of one length that contain a subset."""
    keys = right.where(F.col("u") <= MAX_TOKENS).select("block", F.col("n").alias("size"), "pos",
                                                        F.explode(subset_keys(F.col("tokens"), F.col("n") > 3)).alias("k"))
    return keys.groupBy("block", F.col("k.key").alias("key"), "size").agg(F.min("pos").alias("pos"))


def probes(left: DataFrame) -> DataFrame:
    """(id, n, block, key, weight): subsets that can decide a match by themselves."""
    return (left.where(F.col("u") <= MAX_TOKENS).select("id", "n", "block", F.explode(subset_keys(F.col("tokens"), F.col("n") > 3)).alias("k"))
            .where("k.weight >= 2").select("id", "n", "block", "k.key", "k.weight"))


def _long_lists(of: DataFrame) -> tuple[int, int]:
    """How many classes have long lists, and how many too many tokens for the index."""
    return tuple(of.agg(F.count_if(F.col("n") >= LONG), F.count_if(F.col("u") > MAX_TOKENS)).first())


def _long_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, pos) of matching classes that the index can't decide: both long, or one of too many tokens."""
    lo, ro = F.col("u") > MAX_TOKENS, F.col("u") > MAX_TOKENS
    pairs = [(left.where(F.col("n") >= LONG), right.where(F.col("n") >= LONG), 4), (left.where(lo), right, 2), (left, right.where(ro), 2)]
    out = [FZ.fuzzy_join(a, b, "block", "tokens", "id", "pos", min_shared=k).select("id", "pos") for a, b, k in pairs]
    return out[0].unionByName(out[1]).unionByName(out[2])


def first_match(left: DataFrame, right: DataFrame, block: str, tokens: str, left_id: str, position: str) -> DataFrame:
    """(left_id, position): the first right row of the same block that each left row matches.

    Left rows without a match give no row; a null block matches nothing.
    """
    asked = cut_table(classes(left.where(F.col(block).isNotNull()), block, tokens, left_id, "id"))
    known = cut_table(classes(right, block, tokens, position, "pos").join(asked.select("block").distinct(), "block", "left_semi"))
    hits = lookup(cut_table(probes(asked)), index(known), ["block", "key"])
    # With the subset shared, at least its weight in left positions is found on the right.
    found = hits.where("5 * weight >= 3 * least(n, size)").select("id", "pos")
    (l_long, l_many), (r_long, r_many) = _long_lists(asked), _long_lists(known)
    if (l_long and r_long) or l_many or r_many:
        found = found.unionByName(_long_matches(asked, known))
    best = asked.join(found.groupBy("id").agg(F.min("pos").alias(position)), "id").select(
        F.col("block").alias(block), F.col("tokens").alias(tokens), position)
    return lookup(left.select(left_id, block, tokens), best, [block, tokens]).select(left_id, position)


def match_classes(left: DataFrame, right: DataFrame, block: str, tokens: str, left_id: str, position: str) -> DataFrame:
    """All matches as (kind, left_id, position): 'match' between the first rows of classes, 'left' and
    'right' for the membership of the other rows.  Row pairs follow by joining the three.
    """
    asked = cut_table(classes(left, block, tokens, left_id, "id"))
    known = cut_table(classes(right, block, tokens, position, "pos").join(asked.select("block").distinct(), "block", "left_semi"))
    pairs = FZ.fuzzy_join(asked, known, "block", "tokens", "id", "pos").select(F.lit("match").alias("kind"), F.col("id").alias(left_id), F.col("pos").alias(position))
    on = [block, tokens]
    mine = lookup(left.select(left_id, *on), asked.select(F.col("block").alias(block), F.col("tokens").alias(tokens), F.col("id").alias("_first")), on)
    theirs = lookup(right.select(position, *on), known.select(F.col("block").alias(block), F.col("tokens").alias(tokens), F.col("pos").alias("_first")), on)
    return (pairs.unionByName(mine.select(F.lit("left").alias("kind"), left_id, F.col("_first").alias(position)))
            .unionByName(theirs.select(F.lit("right").alias("kind"), F.col("_first").alias(left_id), position)))
