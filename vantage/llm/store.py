"""Reading tables and cutting lineage through written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; other columns never enter an operator's plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    The plan is evaluated a single time, lineage ends at files every executor can read, and a lost
    executor costs only the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffle_join(small: DataFrame) -> DataFrame:
    """Hint: hash the smaller side of a shuffled join instead of sorting both sides."""
    return small.hint("shuffle_hash")


def crc_fold(doc_id: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def free_name(wanted: str, taken) -> str:
    """``wanted``, with underscores before it until no column in ``taken`` has the name (whatever its case)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted
