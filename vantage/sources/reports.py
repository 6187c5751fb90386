"""Evaluation report documents (markdown) -> typed fields, scores, gaps, header.

Reports are ``(path, text)`` rows; every extractor is a regex column
expression applied to the whole text column, so parsing is a narrow map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import once

# Fixed values (Block-A labels, English and Spanish, first match wins).
FIELD_PATTERNS = {
    "archetype": r"(?i)\|\s*(?:Archetype|Arquetipo)\s*\|\s*(.*?)\s*\|",
    "seniority": r"(?i)\|\s*(?:Seniority|Nivel|Level)\s*\|\s*(.*?)\s*\|",
    "remote": r"(?i)\|\s*(?:Remote|Remoto|Location)\s*\|\s*(.*?)\s*\|",
    "team_size": r"(?i)\|\s*(?:Team|Team size|Equipo)\s*\|\s*(.*?)\s*\|",
    "comp": r"(?i)\|\s*(?:Comp|Salary|Salario|Listed salary)\s*\|\s*(.*?)\s*\|",
    "domain": r"(?i)\|\s*(?:Domain|Dominio|Industry)\s*\|\s*(.*?)\s*\|",
}

# Fixed values (score table rows).
SCORE_PATTERNS = {
    "cv_match": r"(?i)\|\s*(?:CV Match|Match con CV)\s*\|\s*([0-9.]+)/5\s*\|",
    "north_star": r"(?i)\|\s*(?:North Star)\s*\|\s*([0-9.]+)/5\s*\|",
    "comp_score": r"(?i)\|\s*(?:Comp)\s*\|\s*([0-9.]+)/5\s*\|",
    "cultural": r"(?i)\|\s*(?:Cultural signals|Cultural)\s*\|\s*([0-9.]+)/5\s*\|",
    "red_flags": r"(?i)\|\s*(?:Red flags)\s*\|\s*([-+]?[0-9.]+)\s*\|",
    "global_score": r"(?i)\|\s*(?:Global)\s*\|\s*([0-9.]+)/5\s*\|",
}

# Fixed values (gap table and header lines).
GAP_BLOCK = r"(?i)\|\s*Gap\s*\|\s*Severity\s*\|.*?\n\|[-|\s]+\n([\s\S]*?)(?:\n\n|\n##|\n\*\*|\z)"

# Fixed values (dashboard summary patterns on bold labels; first syntax, then the second).
SUMMARY_PATTERNS = {
    "archetype": [r"(?i)\*\*Arquetipo(?:\s+detectado)?\*\*\s*\|\s*(.+)", r"(?i)\*\*Arquetipo:\*\*\s*(.+)"],
    "tldr": [r"(?i)\*\*TL;DR\*\*\s*\|\s*(.+)", r"(?i)\*\*TL;DR:\*\*\s*(.+)"],
    "remote": [r"(?i)\*\*Remote\*\*\s*\|\s*(.+)"],
    "comp": [r"(?i)\*\*Comp\*\*\s*\|\s*(.+)"],
}
HEADER_URL = r"(?m)^\*\*URL:\*\*[ \t\n\f\r]*(https?://[^ \t\n\f\r]+)"
HEADER_BATCH = r"(?m)^\*\*Batch ID:\*\*[ \t\n\f\r]*([0-9]+)"


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def plain(text: Column) -> Column:
    return T.strip_bold(text)


def report_fields(reports: DataFrame) -> DataFrame:
    """src_report_fields: archetype, seniority, remote, team size, comp, domain."""
    p = plain(F.col("text"))
    return reports.select("path", *[T.js_trim(first_match(p, pat)).alias(k) for k, pat in FIELD_PATTERNS.items()])


def report_scores(reports: DataFrame) -> DataFrame:
    """src_report_scores: the six numeric scores (signed red flags)."""
    p = plain(F.col("text"))
    # Every capture is non-empty when the row matches, so an empty extract means "absent":
    # one regex pass per score instead of a match test plus an extraction.
    return reports.select("path", *[T.parse_float_prefix(F.regexp_extract(p, pat, 1)).alias(k)
                                    for k, pat in SCORE_PATTERNS.items()])


def _clean_cell(c: Column) -> Column:
    return T.js_trim(F.regexp_replace(T.js_trim(c), r"\|+$", ""))


def report_summary(reports: DataFrame) -> DataFrame:
    """src_report_summary: dashboard fields, whole."""
    t = F.col("text")
    cols = []
    for k, pats in SUMMARY_PATTERNS.items():
        v = F.coalesce(*[first_match(t, p) for p in pats])
        cols.append(_clean_cell(v).alias(k))
    return reports.select("path", *cols)


def report_gaps(reports: DataFrame) -> DataFrame:
    """src_report_gaps: one row per gap row (description, lower-case severity, mitigation)."""
    block = F.regexp_extract(F.col("text"), GAP_BLOCK, 1)  # empty without a match, which leaves no rows either
    rows = F.filter(F.split(F.coalesce(block, F.lit("")), "\n", -1), lambda r: r.startswith("|"))
    cells = F.transform(rows, lambda r: F.filter(F.transform(F.split(r, r"\|", -1), T.js_trim), lambda x: x != ""))
    gaps = F.filter(cells, lambda c: F.size(c) >= 2)
    return reports.select("path", once(gaps).alias("gaps")).select("path", F.posexplode("gaps").alias("gap_idx", "cells")).select(
        "path", "gap_idx",
        F.get("cells", 0).alias("description"),
        F.lower(F.get("cells", 1)).alias("severity"),
        F.coalesce(F.get("cells", 2), F.lit("")).alias("mitigation"),
    )


def report_header(reports: DataFrame) -> DataFrame:
    """src_report_header: the first URL and batch id lines of each report."""
    head = F.col("text")
    return reports.select("path", once(head).alias("text")).select("path", first_match(head, HEADER_URL).alias("url"),
                          first_match(head, HEADER_BATCH).alias("batch_id"))
