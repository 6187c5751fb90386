"""Tracker additions: one small TSV / pipe file per evaluation, three layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T
from ..session import once


def src_additions(files: DataFrame) -> DataFrame:
    """Parse ``(file_no, file, line)`` rows: pipe row (≥8 cells) or TSV (≥8 fields).

    TSV files may carry (status, score) or (score, status) in columns 4/5; the
    layout is detected per file from what each column looks like.  Rows with a
    missing or zero entry number are dropped.
    """
    files = files.select("file_no", "file", once(T.js_trim(F.col("line"))).alias("_l")).where("_l <> ''")
    content = F.col("_l")
    is_pipe = content.startswith("|")
    pipe_cells = F.filter(F.transform(F.split(content, r"\|", -1), T.js_trim), lambda x: x != "")
    tsv = F.split(content, "\t", -1)
    split = files.select("file_no", "file", is_pipe.alias("_pipe"), once(F.when(is_pipe, pipe_cells).otherwise(tsv)).alias("_c"))
    cells, is_pipe = F.col("_c"), F.col("_pipe")
    c4, c5 = T.js_trim(F.get(cells, 4)), T.js_trim(F.get(cells, 5))
    c4_score, c5_score = S.looks_like_score(c4), S.looks_like_score(c5)
    c4_status, c5_status = S.looks_like_status(c4), S.looks_like_status(c5)
    swapped = ~(c4_status & ~c4_score) & (c4_score & c5_status)
    tsv_status = F.when(swapped, c5).otherwise(c4)
    tsv_score = F.when(swapped, c4).otherwise(c5)
    status_cell = F.when(is_pipe, F.get(cells, 5)).otherwise(tsv_status)
    score_cell = F.when(is_pipe, F.get(cells, 4)).otherwise(tsv_score)
    num = T.parse_int_prefix(F.get(cells, 0))
    return split.where((F.size(cells) >= 8) & (num != 0)).select(
        "file_no", "file",
        num.alias("num"),
        F.get(cells, 1).alias("date"),
        F.get(cells, 2).alias("company"),
        F.get(cells, 3).alias("role"),
        score_cell.alias("score_raw"),
        S.status_strict(status_cell).alias("status"),
        F.get(cells, 6).alias("pdf"),
        F.get(cells, 7).alias("report"),
        F.coalesce(F.get(cells, 8), F.lit("")).alias("notes"),
    )


def file_order_key(file_col: str = "file"):
    """srt_additions: the digits of the file name as a number, 0 when there are none."""
    digits = F.regexp_replace(F.col(file_col), r"[^0-9]", "")
    return F.coalesce(F.when((digits != "") & (F.length(digits) <= 18), digits.cast("long")), F.lit(0))
