"""Readers for markdown / TSV tracker text.

Input is always a DataFrame of lines with an explicit order key (``pos``), as
``spark.read.text`` plus a position gives it; output is typed rows.  Line
splitting, trimming and guards are column expressions, so a reader is one
narrow projection + filter over the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T
from ..operators.prefix import row_number_global
from ..session import once

CHECK = "✅"
CROSS = "❌"


def render_tracker(trk: DataFrame) -> DataFrame:
    """Fixture tracker rows -> ``| # | Date | … | Notes |`` lines keyed by ``pos``."""
    pdf = F.when(F.col("pdf") == "yes", F.lit(CHECK)).otherwise(F.lit(CROSS))
    cells = [F.col("num").cast("string"), "date", "company", "role", "score_raw", "status_raw", pdf, "report", "notes"]
    cells = [F.col(c) if isinstance(c, str) else c for c in cells]
    return trk.select("pos", once(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).alias("line"))


def _pipe_rows(lines: DataFrame, min_parts: int) -> DataFrame:
    """(pos, _p): raw cells of lines starting ``|`` (whose first cell is then empty) with at least ``min_parts`` cells."""
    split = lines.select("pos", once(F.split(F.col("line"), r"\|", -1)).alias("_p"))
    return split.where((F.get(F.col("_p"), 0) == "") & (F.size("_p") >= max(min_parts, 2)))


def _cell(i: int) -> F.Column:
    # Trimmed where it is read: a job that reads two columns trims two cells.
    return T.js_trim(F.get(F.col("_p"), i))


def src_pipe_table(lines: DataFrame, num_policy: str = "any", min_parts: int = 9) -> DataFrame:
    """Script reader: lines starting ``|``, ≥``min_parts`` split parts, numeric first cell.

    ``num_policy``: ``any`` (analysis), ``nonzero`` (merge), ``positive`` (dedup).
    """
    num = T.parse_int_prefix(F.get(F.col("_p"), 1))  # parseInt skips leading blanks
    keep = {"nonzero": num != 0, "positive": num > 0}.get(num_policy, num.isNotNull())
    return (
        _pipe_rows(lines, min_parts).where(keep)
        .select(
            "pos",
            num.alias("num"),
            _cell(2).alias("date"),
            _cell(3).alias("company"),
            _cell(4).alias("role"),
            _cell(5).alias("score_raw"),
            _cell(6).alias("status_raw"),
            _cell(7).alias("pdf"),
            _cell(8).alias("report"),
            F.coalesce(_cell(9), F.lit("")).alias("notes"),
        )
    )


def src_pipe_table_mixed(lines: DataFrame, auto_number: bool = True) -> DataFrame:
    """Dashboard reader: pipe or tab rows, ≥8 fields, auto-number, ✅, ``[n](path)``, ``x/5``.

    The auto-number (position among accepted rows) needs a global running
    count; jobs that never read ``num`` pass ``auto_number=False`` and skip it.
    """
    trimmed = lines.select("pos", once(T.js_trim(F.col("line"))).alias("_l"))
    line = F.col("_l")
    is_tab = F.instr(line, "\t") > 0
    tab_fields = F.transform(
        F.split(T.js_trim(F.regexp_replace(line, r"^\|", "")), "\t", -1),
        lambda p: T.js_trim(F.regexp_replace(p, r"^\|+|\|+$", "")),
    )
    pipe_fields = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), T.js_trim)
    fields = F.when(is_tab, tab_fields).otherwise(pipe_fields)
    skip = (
        (line == "") | line.startswith("# ") | line.startswith("|---") | line.startswith("| #")
        | ~line.startswith("|")
    )
    rows = trimmed.where(~skip).select("pos", once(fields).alias("f")).where(F.size("f") >= 8)
    rows = row_number_global(rows, ["pos"], "seq") if auto_number else rows.withColumn("seq", F.lit(None))
    f = F.col("f")
    link_num = F.regexp_extract(F.get(f, 7), r"\[([0-9]+)\]\(([^)]+)\)", 1)
    link_path = F.regexp_extract(F.get(f, 7), r"\[([0-9]+)\]\(([^)]+)\)", 2)
    explicit = F.when(F.get(f, 0).rlike(r"^[+-]?[0-9]+$"), T.int_of_digits(F.get(f, 0)))
    return rows.select(
        "pos",
        F.coalesce(explicit, F.col("seq").cast("int")).alias("num"),
        F.get(f, 1).alias("date"),
        F.get(f, 2).alias("company"),
        F.get(f, 3).alias("role"),
        F.get(f, 4).alias("score_raw"),
        T.score_strict(F.get(f, 4)).alias("score"),
        F.get(f, 5).alias("status_raw"),
        F.get(f, 6).contains(CHECK).alias("has_pdf"),
        F.when(link_num != "", link_num).alias("report_num"),
        F.when(link_num != "", link_path).alias("report_path"),
        F.coalesce(F.get(f, 8), F.lit("")).alias("notes"),
    )


def src_followups(lines: DataFrame) -> DataFrame:
    """Follow-up table reader (``# App# Date Company Role Channel Contact Notes``), ≥8 parts."""
    num = T.parse_int_prefix(F.get(F.col("_p"), 1))
    return _pipe_rows(lines, 8).where(num.isNotNull()).select(
        "pos",
        num.alias("num"),
        T.parse_int_prefix(F.get(F.col("_p"), 2)).alias("app_num"),
        _cell(3).alias("date"),
        _cell(4).alias("company"),
        _cell(5).alias("role"),
        _cell(6).alias("channel"),
        _cell(7).alias("contact"),
        F.coalesce(_cell(8), F.lit("")).alias("notes"),
    )


def render_followups(fol: DataFrame) -> DataFrame:
    """Fixture follow-ups -> pipe lines; ``pos`` = (app_num, num) order."""
    cells = [F.col("num").cast("string"), F.col("app_num").cast("string"), F.col("date"),
             F.col("company"), F.col("role"), F.col("channel"), F.col("contact"), F.col("notes")]
    return fol.select(
        (F.col("app_num").cast("long") * 1_000_000 + F.col("num")).alias("pos"),
        once(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).alias("line"),
    )


def tracker_from_fixture(trk: DataFrame, num_policy: str = "any") -> DataFrame:
    """The script reader applied to the rendered fixture (what every tracker job reads)."""
    return src_pipe_table(render_tracker(trk), num_policy)


def status_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("status", S.status_alias("status_raw"))
