"""Which texts of a block contain a word, by an index of character grams, and the text with the most words.

A word is looked up by its rarest gram among the block's texts and verified; words times texts are never
paired.  Words that very many texts of a block contain say little about any one text: they are compared
between classes of equal word sets, so a common word costs a row per text, not one per text and asker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_table

GRAM = 3
#: A word that more texts of its block contain is common.
COMMON = 100


def _grams(text: Column, q: int) -> Column:
    n = F.length(text) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def text_grams(text: Column) -> Column:
    """Distinct grams of three characters, and of one and two where these have more than two bytes.

    Words of more than two bytes but fewer than three characters are looked up whole.
    """
    short = F.filter(F.concat(_grams(text, 1), _grams(text, 2)), lambda g: F.octet_length(g) > 2)
    return F.array_distinct(F.concat(_grams(text, GRAM), short))


def word_grams(word: Column) -> Column:
    return F.when(F.length(word) < GRAM, F.array(word)).otherwise(F.array_distinct(_grams(word, GRAM)))


def containing(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(block, word, text): the texts of a block that contain each word of more than two bytes.

    ``words`` (block, word) and ``texts`` (block, text) are distinct rows without nulls.
    """
    index = cut_table(texts.select("block", "text", F.explode(text_grams(F.col("text"))).alias("gram")))
    spread = index.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("texts"))
    asked = words.where(F.octet_length("word") > 2).select("block", "word", F.explode(word_grams(F.col("word"))).alias("gram"), F.size(word_grams(F.col("word"))).alias("n"))
    # A word with a gram that no text of the block has occurs nowhere in it.
    anchors = (asked.join(spread, ["block", "gram"]).groupBy("block", "word", "n")
               .agg(F.min(F.struct("texts", "gram")).alias("rarest"), F.count(F.lit(1)).alias("known"))
               .where("known = n").select("block", "word", F.col("rarest.gram").alias("gram")))
    return anchors.join(index, ["block", "gram"]).where(F.contains("text", "word")).select("block", "word", "text")


def best_texts(asked: DataFrame, texts: DataFrame, common: int = COMMON) -> DataFrame:
    """(block, words, score, place, value): per word list the text of its block that contains most of its words.

    ``asked`` (block, words) has distinct lists of words, repeats counting twice; ``texts`` (block, text,
    place, value) has distinct texts.  Of equally good texts the one with the smallest place is taken.
    Lists none of whose words occur give no row.
    """
    lists = cut_table(asked.withColumn("words", F.filter("words", lambda w: F.octet_length(w) > 2)).distinct())
    found = cut_table(containing(lists.select("block", F.explode("words").alias("word")).distinct(), texts.select("block", "text")))
    often = found.groupBy("block", "word").agg((F.count(F.lit(1)) > common).alias("common"))
    marked = cut_table(found.join(often, ["block", "word"]))
    # Texts with a rare word of the list: few per word, scored in full.
    rare = (lists.select("block", "words", F.explode(F.array_distinct("words")).alias("word"))
            .join(marked.where("not common").drop("common"), ["block", "word"]).select("block", "words", "text").distinct())
    full = (rare.join(texts, ["block", "text"])
            .withColumn("score", F.size(F.filter("words", lambda w: F.contains(F.col("text"), w)))).select("block", "words", "score", "place", "value"))
    # Texts by the common words they contain, lists by the common words they have.
    has = marked.where("common").groupBy("block", "text").agg(F.sort_array(F.collect_set("word")).alias("has"))
    kinds = (has.join(texts, ["block", "text"]).groupBy("block", "has").agg(F.min(F.struct("place", "value")).alias("first")))
    wanted = (lists.select("block", "words", F.posexplode("words").alias("i", "word")).join(marked.where("common").select("block", "word").distinct(), ["block", "word"])
              .groupBy("block", "words").agg(F.sort_array(F.collect_list("word")).alias("wants")))
    pairs = (wanted.select("block", "wants").distinct().select("block", "wants", F.explode(F.array_distinct("wants")).alias("word"))
             .join(kinds.select("block", "has", F.explode("has").alias("word")), ["block", "word"]).select("block", "wants", "has").distinct())
    scored = (pairs.withColumn("score", F.size(F.filter("wants", lambda w: F.array_contains(F.col("has"), w)))).join(kinds, ["block", "has"])
              .groupBy("block", "wants").agg(F.max(F.struct("score", (-F.col("first.place")).alias("np"), F.col("first.value").alias("value"))).alias("b")))
    by_kind = wanted.join(scored, ["block", "wants"]).select("block", "words", "b.score", (-F.col("b.np")).alias("place"), "b.value")
    best = full.unionByName(by_kind).groupBy("block", "words").agg(F.max(F.struct("score", (-F.col("place")).alias("np"), "value")).alias("b"))
    return best.select("block", "words", "b.score", (-F.col("b.np")).alias("place"), "b.value")
