"""Readers over paths: text with file and line order, TSV, JSON and whole pages.

Each works on one file, a folder or a glob, and splits large text files across tasks.  Line numbers come
from a prefix count per file over (split start, order within the split), so no task sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..operators.prefix import row_number_global


def file_name(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, line_no, line): lines of text files, numbered from 1 in file order."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    numbered = row_number_global(raw, ["_start", "_at"], "line_no", ["path"])
    return numbered.select("path", file_name(F.col("path")).alias("file"), "line_no", "line")


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Tracker lines (pos, line) of one markdown file, as the tracker readers take them."""
    return read_lines(spark, path).select(F.col("line_no").alias("pos"), "line")


def read_tsv(spark: SparkSession, path: str, schema: str | Ty.StructType, header: bool = True) -> DataFrame:
    """Tab-separated rows without quoting: a quote is an ordinary character."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "").option("escape", "")
            .csv(path))


def read_json(spark: SparkSession, path: str, schema: str | Ty.StructType, whole: bool = False) -> DataFrame:
    """JSON lines, or one document per file where ``whole``."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, text): one row per file, for reports and HTML pages."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.select("path", file_name(F.col("path")).alias("file"), "text")
