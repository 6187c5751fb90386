"""Fuzzy role matching inside a company block, as equi-joins on tokens.

Rows are never paired directly.  Each side is exploded into tokens; pairs
that share a token inside the same company block come out of an equi-join on
``(block, token)``.  Prefix filtering drops each row's most frequent token
from the join keys (a match needs two shared tokens, so one shared token in
the remaining prefix is guaranteed), which keeps hot tokens such as
"developer" out of the join; candidates are then verified exactly with array
functions on the two token lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, col

# Fixed values (merge flavour stop list: seniority, contract/mode, generic words, locations, regions,
# short prepositions; tokens must be longer than 3 characters).
MERGE_STOPWORDS = [
    "junior", "mid", "middle", "senior", "staff", "principal", "lead", "head",
    "chief", "associate", "intern", "entry", "level",
    "remote", "hybrid", "onsite", "contract", "contractor", "freelance",
    "fulltime", "parttime", "permanent", "temporary", "intern", "internship",
    "role", "position", "opportunity", "team", "based",
    "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "pune", "chennai",
    "london", "berlin", "paris", "madrid", "barcelona", "amsterdam", "dublin",
    "york", "francisco", "seattle", "boston", "austin", "chicago", "toronto",
    "tokyo", "singapore", "sydney", "melbourne", "lisbon", "warsaw",
    "europe", "emea", "apac", "latam", "americas", "india", "spain", "germany",
    "france", "italy", "canada", "brazil", "mexico", "japan",
    "with", "from", "into", "over", "this", "that",
]

# Fixed values (dedup flavour: role and location stop lists; tokens longer than 2 characters).
DEDUP_ROLE_STOPWORDS = [
    "senior", "junior", "lead", "staff", "principal", "head", "chief",
    "manager", "director", "associate", "intern", "contractor",
    "remote", "hybrid", "onsite",
    "engineer", "engineering",
]
DEDUP_LOCATION_STOPWORDS = [
    "tokyo", "japan", "london", "berlin", "paris", "singapore",
    "york", "francisco", "angeles", "seattle", "austin", "boston",
    "chicago", "denver", "toronto", "amsterdam", "dublin", "sydney",
    "remote", "global", "emea", "apac", "latam",
]


def _drop_stop(tokens: Column, stop: list[str]) -> Column:
    stop_arr = F.array(*[F.lit(s) for s in sorted(set(stop))])
    return F.filter(tokens, lambda w: ~F.array_contains(stop_arr, w))


def merge_tokens(role) -> Column:
    """Merge tokeniser: lower, non ``[a-z0-9\\s]`` -> space, split, len > 3, stop words out (repeats kept)."""
    s = F.regexp_replace(F.lower(col(role)), rf"[^a-z0-9\s]", " ")
    toks = F.split(s, rf"{WS_CLASS}+", -1)
    toks = F.filter(toks, lambda w: F.length(w) > 3)
    return _drop_stop(toks, MERGE_STOPWORDS)


def dedup_tokens(role) -> Column:
    """Dedup tokeniser: lower, ``()`` -> space, collapse, keep ``[a-z0-9 /]``, len > 2, stop words out."""
    s = F.regexp_replace(F.lower(col(role)), r"[()]", " ")
    s = F.regexp_replace(s, rf"{WS_CLASS}+", " ")
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9 /]", ""))
    toks = F.filter(F.split(s, rf"{WS_CLASS}+", -1), lambda w: F.length(w) > 2)
    return _drop_stop(toks, DEDUP_ROLE_STOPWORDS + DEDUP_LOCATION_STOPWORDS)


def overlap(left_tokens: Column, right_tokens: Column) -> Column:
    """Left token positions whose token occurs on the right (left repeats count)."""
    return F.size(F.filter(left_tokens, lambda w: F.array_contains(right_tokens, w)))


def fuzzy_match(left_tokens: Column, right_tokens: Column, min_shared: int = 2, min_ratio: float = 0.6) -> Column:
    n = overlap(left_tokens, right_tokens)
    smaller = F.least(F.size(left_tokens), F.size(right_tokens))
    return ((F.size(left_tokens) > 0) & (F.size(right_tokens) > 0) & (n >= min_shared)
            & (n.cast("double") / smaller.cast("double") >= min_ratio))


def _prefix_keys(df: DataFrame, id_col: str, block: str, tokens: str, freq: DataFrame, min_shared: int) -> DataFrame:
    """(block, id, token) for all but the ``min_shared - 1`` most frequent distinct tokens of each row."""
    ex = df.select(block, id_col, F.explode(F.array_distinct(F.col(tokens))).alias("token"))
    ex = ex.join(freq, [block, "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = Window.partitionBy(block, id_col).orderBy(F.col("df").desc(), F.col("token").desc())
    ranked = (ex.withColumn("_r", F.row_number().over(w))
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(block, id_col))))
    # Lists that share min_shared tokens share one of the others; rows with fewer tokens keep the rarest.
    return ranked.where((F.col("_r") >= min_shared) | (F.col("_r") == F.col("_n"))).select(block, id_col, "token")


def candidate_pairs(left: DataFrame, right: DataFrame, block: str, tokens: str,
                    left_id: str, right_id: str, min_shared: int = 2) -> DataFrame:
    """Distinct (left_id, right_id) pairs in the same block sharing a prefix token.

    ``left`` and ``right`` carry ``block``, their id and a ``tokens`` array.
    Token frequencies are counted per block over both sides (map-side combined).
    ``min_shared`` is how many tokens any match shares, repeats on the left aside.
    """
    both = (left.select(block, F.explode(F.array_distinct(F.col(tokens))).alias("token"))
            .unionByName(right.select(block, F.explode(F.array_distinct(F.col(tokens))).alias("token"))))
    freq = both.groupBy(block, "token").agg(F.count(F.lit(1)).alias("df"))
    lk = _prefix_keys(left, left_id, block, tokens, freq, min_shared)
    rk = _prefix_keys(right, right_id, block, tokens, freq, min_shared)
    by_prefix = lk.join(rk, [block, "token"]).select(block, left_id, right_id)
    # A repeated left token alone can reach two shared positions; those rows join on it in full.
    t = F.col(tokens)
    repeated = left.select(block, left_id, F.explode(F.filter(
        F.array_distinct(t), lambda w: F.size(F.filter(t, lambda x: x == w)) > 1)).alias("token"))
    right_all = right.select(block, right_id, F.explode(F.array_distinct(t)).alias("token"))
    by_repeat = repeated.join(right_all, [block, "token"]).select(block, left_id, right_id)
    return by_prefix.unionByName(by_repeat).distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, block: str, tokens: str, left_id: str, right_id: str,
               extra_left: list[str] | None = None, min_shared: int = 2) -> DataFrame:
    """Verified matches: candidate pairs whose token lists pass the overlap rule (left = multiset side)."""
    pairs = candidate_pairs(left, right, block, tokens, left_id, right_id, min_shared)
    lt = left.select(block, left_id, F.col(tokens).alias("lt"), *(extra_left or []))
    rt = right.select(block, right_id, F.col(tokens).alias("rt"))
    j = pairs.join(lt, [block, left_id]).join(rt, [block, right_id])
    return j.where(fuzzy_match(F.col("lt"), F.col("rt"))).drop("lt", "rt")
