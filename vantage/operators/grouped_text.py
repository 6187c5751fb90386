"""Text documents of grouped rows: headings, counts, rows and totals interleaved by one range sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_table
from ..sources.files import read_lines
from .aggregates import with_scalars
from .postings import location_group_rank
from .prefix import row_number_global

OTHER = "其他"
_ORDER = ("_s", "_g", "_grp", "_part", "_date", "_tie", "_i")


def _numbered(lines: Column) -> Column:
    return F.posexplode(lines).alias("_i", "line")


def grouped_document(rows: DataFrame, heading: Column, title: Column, preferred: list[str], tail: DataFrame | None = None) -> DataFrame:
    """Lines of a document, with their order columns: title, groups with their headings and rows, tail.

    ``rows`` has group, date, tie and line; an empty group is called ``其他``.  Groups that start with a
    preferred name come first, in that order, the others by name; rows stand by date, latest first, then
    by ``tie``.  ``heading`` (over ``grp`` and its count ``n``) and ``title`` (over the total ``n``) are
    arrays of lines; ``tail`` (tie, line) follows everything.  Without rows there is the title and the tail.
    """
    r = cut_table(rows.select(F.coalesce(F.when(F.col("group") != "", F.col("group")), F.lit(OTHER)).alias("grp"),
                              F.coalesce("date", F.lit("")).alias("date"), F.col("tie").cast("long").alias("tie"), "line"))
    counts = cut_table(r.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rank = location_group_rank(F.col("grp"), preferred)

    def placed(df: DataFrame, s: int, g: Column, grp: Column, part: int, date: Column, tie: Column, *line: Column) -> DataFrame:
        cols = df.select(F.lit(s).alias("_s"), g.cast("int").alias("_g"), grp.alias("_grp"), F.lit(part).alias("_part"), date.alias("_date"),
                         tie.cast("long").alias("_tie"), *line)
        return cols.select(*_ORDER, "line")

    none, zero = F.lit(""), F.lit(0)
    out = (placed(total, 0, zero, none, 0, none, zero, _numbered(title))
           .unionByName(placed(counts, 1, rank, F.col("grp"), 0, none, zero, _numbered(heading)))
           .unionByName(placed(r, 1, rank, F.col("grp"), 1, F.col("date"), F.col("tie"), zero.alias("_i"), F.col("line"))))
    if tail is not None:
        out = out.unionByName(placed(tail, 2, zero, none, 0, none, F.col("tie"), zero.alias("_i"), F.col("line")))
    return out


def write_document(lines: DataFrame, path: str) -> None:
    """Write the lines in their order as plain text: part files read one after the other are the document."""
    keys = [F.col(c).desc() if c == "_date" else F.col(c) for c in _ORDER]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (cut_table(lines).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(F.col("line").alias("value"))
     .write.mode("errorifexists").text(path))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a document written in parts, numbered from 1."""
    parts = read_lines(spark, path)
    return row_number_global(parts.select("file", F.col("line_no").alias("_at"), "line"), ["file", "_at"], "line_no").select("line_no", "line")


def merged_inbox(lines: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, tail) of the inbox after new offers: one entry per url, and the processed section as it stands.

    ``lines`` (line_no, line) is the inbox, ``offers`` (pos, url, company, title, location, date) the new
    ones.  A url keeps the place where it first stood; its last entry counts, new ones after old ones.
    Without a processed section one is added.
    """
    entry = r"^- \[ \] (https?://[^ \t\n\f\r]+)"
    parts = F.split("line", r" \| ", -1)
    old = lines.where(F.col("line").rlike(entry)).select(
        F.regexp_extract("line", entry, 1).alias("url"), F.lit(0).alias("src"), F.col("line_no").cast("long").alias("ord"), "line",
        F.coalesce(F.get(parts, 3), F.lit("")).alias("group"), F.trim(F.coalesce(F.get(parts, 4), F.lit(""))).alias("date"))
    cells = [F.coalesce(c, F.lit("")) for c in ("url", "company", "title", "location", "date")]
    new = offers.select("url", F.lit(1).alias("src"), F.col("pos").cast("long").alias("ord"),
                        F.concat(F.lit("- [ ] "), F.concat_ws(" | ", *cells)).alias("line"), cells[3].alias("group"), cells[4].alias("date"))
    at = F.struct("src", "ord")
    kept = old.unionByName(new).groupBy("url").agg(F.min(at).alias("first"), F.max_by(F.struct("line", "group", "date"), at).alias("e"))
    # Old entries come before new ones; ties are their places, new ones behind any line number.
    behind = F.lit(1 << 40)
    rows = kept.select("e.group", "e.date", (F.col("first.src") * behind + F.col("first.ord")).alias("tie"), "e.line")
    start = lines.where(F.col("line").startswith("## Processed")).agg(F.min("line_no").alias("start"))
    section = with_scalars(lines, start).where("line_no >= start").select(F.col("line_no").alias("tie"), "line")
    absent = start.where("start is null").select(F.explode(F.array(F.struct(F.lit(0).alias("tie"), F.lit("").alias("line")),
                                                                  F.struct(F.lit(1).alias("tie"), F.lit("## Processed").alias("line")))).alias("x"))
    return rows, section.unionByName(absent.select(F.col("x.tie").cast("long").alias("tie"), "x.line"))
