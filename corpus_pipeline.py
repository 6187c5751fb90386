"""The corpus pipeline: stages over ``documents``, each calling one operator of ``vantage.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``.  All but the last return the columns of ``documents``; a row that a stage
keeps keeps all its other columns, whatever they are named.  Rows with a null doc_id or text pass every
filtering stage that finds nothing in their text, an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import decontaminate as op9
from vantage.llm import line_store as op8
from vantage.llm import ngram_join as op6
from vantage.llm import packing as op2
from vantage.llm import toxicity as op4
from vantage.llm.registry import query, with_code
from vantage.llm.store import free_name, materialise, table


@with_code
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled ones among them, does not call toxic."""
    model = op4.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return op4.keep_clean(docs, model)


@with_code
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them hold; ``n_chars`` follows a changed text."""
    lines, dropped = (free_name(n, docs.columns) for n in ("n_lines", "n_dropped"))
    out = op8.dedup_lines(docs, names=(lines, dropped))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@with_code
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near copies."""
    gone = op6.jaccard_classes(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


@with_code
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return op9.without_items(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@with_code
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    import public_tokenizers

    # Workers still hold what earlier stages loaded, so their word caches are smaller than those of op2 alone.
    return op2.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=150_000, keep_older=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination),
          ("packing", packing)]

#: A fitted grammar, packing by a tokenizer and edit distances have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
