"""Sinks: versioned tracker snapshots, partitioned history appends, grouped inbox text, queue TSV, JSON results.

Outputs go to a directory the caller names (on a cluster, shared storage);
each write is one Spark job.  A new tracker version is written to its own
directory with ``errorifexists`` and becomes current only once complete,
which is the atomic replace-with-backup the reference does with files.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder (round-trip jobs write here)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "vantage-out", f"{name}-{uuid.uuid4().hex}")


def write_tracker_version(df: DataFrame, base: str, version: str) -> str:
    """snk_tracker: write a new tracker version; earlier versions stay as backups."""
    path = os.path.join(base, f"v={version}")
    df.write.mode("errorifexists").parquet(path)
    return path


def append_history(df: DataFrame, path: str, date_col: str = "first_seen") -> None:
    """snk_history_append: append accepted offers, partitioned by the day they were first seen."""
    df.write.mode("append").partitionBy(date_col).parquet(path)


def read_history(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The appended offers; ``schema`` is given, since a history without any offer has no file to take it from."""
    return spark.read.schema(schema).parquet(path)


def write_lines(lines: DataFrame, path: str, order_col: str = "line_no") -> None:
    """Write ordered text lines: range-partitioned and sorted inside partitions, so files concatenate in order."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
     .select(F.concat_ws("\t", F.col(order_col).cast("string"), F.col("line")).alias("value"))
     .write.mode("errorifexists").text(path))


def read_lines(spark: SparkSession, path: str, order_col: str = "line_no") -> DataFrame:
    raw = spark.read.text(path)
    parts = F.split("value", "\t", 2)
    return raw.select(parts.getItem(0).cast("long").alias(order_col), parts.getItem(1).alias("line"))


def write_queue_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """snk_queue_file: ``id url source notes`` as tab-separated text with a header (replace or append)."""
    df.select("id", "url", "source", "notes").write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """snk_json_result: one JSON object per row."""
    df.write.mode("errorifexists").json(path)
