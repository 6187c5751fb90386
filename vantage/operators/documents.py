"""Document scans: metric lint, required fields, structure checks, deny-list, paths, phrases, urls.

Documents are split into lines with ``posexplode`` (one row per line, the
line number kept); every check is a column predicate over lines or whole
texts.  The deny-list scan reads each line once with an automaton of the
patterns, or joins pieces of the lines with a longer table of patterns.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..session import cut_table, share_code


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no 1-based, line) for every line of every document."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line")) \
        .select(id_col, (F.col("i") + 1).alias("line_no"), "line")


# Fixed value (metric pattern).
METRIC_RE = r"\b\d{2,4}\+?\s*(hours?|%|evals?|layers?|tests?|fields?|bases?)\b"


def metric_lint(doc_lines: DataFrame) -> DataFrame:
    """dq_metric_lint: first hard-coded-looking metric per line (instruction, heading, comment lines skipped)."""
    ln = F.col("line")
    skip = ln.contains("NEVER hardcode") | ln.contains("NUNCA hardcode") | ln.startswith("#") | ln.startswith("<!--")
    pat = "(?i)" + K.jsre(METRIC_RE)
    m = F.regexp_extract(ln, pat, 0)
    return doc_lines.where(~skip & ln.rlike(pat)).select("doc_id", "line_no", m.alias("match"))


# Fixed values (profile fields that must be present; the example placeholder name).
REQUIRED_FIELDS = ["full_name", "email", "location"]
EXAMPLE_NAME = '"Jane Smith"'


def required_fields(docs: DataFrame) -> DataFrame:
    """dq_required_fields: too-short documents and the first missing field (or example data)."""
    t = F.col("text")
    first_missing = F.when(F.lit(False), F.lit(None).cast("string"))
    for f in REQUIRED_FIELDS:
        first_missing = first_missing.when(~t.contains(f) | t.contains(EXAMPLE_NAME), F.lit(f))
    short = F.when(F.length(T.js_trim(t)) < 100, F.lit("short"))
    flags = F.array(short, F.when(first_missing.isNotNull(), F.concat(F.lit("field:"), first_missing)))
    return docs.select("doc_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("issue"))


# Fixed values (LaTeX CV structure: required section patterns and commands).
REQUIRED_SECTIONS = [r"\\section\{Education\}", r"\\section\{Work Experience\}", r"\\section\{Personal Projects\}",
                     r"\\section\{Technical Skills\}"]
REQUIRED_COMMANDS = [r"\\resumeSubheading", r"\\resumeItem", r"\\resumeProjectHeading"]


def document_structure(docs: DataFrame) -> DataFrame:
    """dq_document_structure: missing sections / commands / delimiters, unresolved placeholders, item counts."""
    t = F.col("text")
    missing = [F.when(~t.rlike(p), F.lit(1)).otherwise(F.lit(0)) for p in REQUIRED_SECTIONS + REQUIRED_COMMANDS]
    missing += [F.when(~t.contains(s), F.lit(1)).otherwise(F.lit(0))
                for s in ["\\begin{document}", "\\end{document}", "\\pdfgentounicode=1"]]
    n_missing = missing[0]
    for m in missing[1:]:
        n_missing = n_missing + m
    ph = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\{\{[A-Z_]+\}\}"), 0))
    doc_lines = F.split(t, "\n", -1)
    return docs.select(
        "doc_id", n_missing.alias("n_missing"),
        F.array_join(ph, ", ").alias("placeholders"),
        F.size(F.filter(doc_lines, lambda x: x.rlike(r"\\resumeItem\{"))).alias("resume_items"),
        F.size(F.filter(doc_lines, lambda x: x.rlike(r"\\resumeSubheading[^C]"))).alias("subheadings"),
    )


def denylist_scan(doc_lines: DataFrame, patterns: DataFrame, allowed: Column | None = None, max_chars: int = 1_000_000) -> DataFrame:
    """dq_denylist_scan: (doc_id, line_no, pattern_id) for lines containing a pattern; an empty one is in every line.

    Patterns of ``max_chars`` characters in all fit one automaton, which is broadcast and passes over the
    lines once; a longer table is joined with the lines by grams (``denylist_join``).  ``allowed`` marks
    lines that are not searched; null lines and patterns match nothing.
    """
    rows = doc_lines if allowed is None else doc_lines.where(~F.coalesce(allowed, F.lit(False)))
    known = patterns.where("pattern is not null").select(F.col("pattern_id").cast("long"), "pattern")
    if (known.agg(F.sum(F.length("pattern") + 1).alias("n")).first()["n"] or 0) > max_chars:
        return denylist_join(rows, known)
    spark = doc_lines.sparkSession
    share_code(spark)
    held = spark.sparkContext.broadcast([tuple(r) for r in known.collect()])
    return rows.select(F.col("doc_id").cast("long"), F.col("line_no").cast("int"), "line").mapInArrow(
        _pattern_scan(held), "doc_id long, line_no int, pattern_id long")


#: Gram lengths: one is used for patterns of at least twice its length less one, the longest that fits.
GRAM_SIZES = (8, 4, 2, 1)


def pattern_anchors(patterns: DataFrame) -> DataFrame:
    """(size, gram, pattern_id, pattern): grams of which every line that contains the pattern shows one.

    A line shows its consecutive pieces of ``size`` characters.  Wherever a pattern stands, one of any
    ``size`` consecutive offsets in it falls on the start of a piece; the offsets whose grams are rarest
    among the patterns are taken.
    """
    size, q = F.lit(GRAM_SIZES[-1]), F.col("size")
    for n in reversed(GRAM_SIZES[:-1]):
        size = F.when(F.length("pattern") >= 2 * n - 1, n).otherwise(size)
    p = patterns.where("pattern <> ''").withColumn("size", size).distinct()
    runs = F.sequence(F.lit(0), F.floor((F.length("pattern") - q * 2 + 1) / q).cast("int"))
    grams = cut_table(p.select("*", F.explode(runs).alias("run")).select("*", F.explode(F.sequence(F.lit(0), q - 1)).alias("i"))
                      .withColumn("gram", F.substring("pattern", F.col("run") * q + F.col("i") + 1, q)))
    often = grams.groupBy("size", "gram").agg(F.count_distinct("pattern_id").alias("patterns"))
    rarest = (grams.join(often, ["size", "gram"]).groupBy("pattern_id", "pattern", "run").agg(F.sum("patterns").alias("w"))
              .groupBy("pattern_id", "pattern").agg(F.min(F.struct("w", "run")).alias("b")))
    chosen = rarest.select("pattern_id", "pattern", F.col("b.run").alias("run"))
    return grams.join(chosen, ["pattern_id", "pattern", "run"]).select("size", "gram", "pattern_id", "pattern").distinct()


def _pieces(line: str, size: int) -> Column:
    """array<struct<size, gram>>: the distinct consecutive pieces of ``size`` characters."""
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?s).{{{size}}}"), F.lit(0)))
    return F.transform(found, lambda g: F.struct(F.lit(size).alias("size"), g.alias("gram")))


def denylist_join(doc_lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lines containing a pattern, for pattern tables of any size: a join of line pieces with pattern anchors.

    Pieces travel without their line, and lines with a candidate are joined back and verified, all in
    JVM expressions.  Empty patterns, which every line contains, need no search.
    """
    rows = doc_lines.where("line is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), "line")
    anchors = cut_table(pattern_anchors(patterns))
    sizes = [r["size"] for r in anchors.select("size").distinct().collect()]  # some of GRAM_SIZES
    shown = [_pieces("line", q) for q in sizes]
    everywhere = rows.join(F.broadcast(patterns.where("pattern = ''").select("pattern_id", F.lit("").alias("_all")).distinct()),
                           F.substring("line", 1, 0) == F.col("_all")).select("doc_id", "line_no", "pattern_id")
    if not sizes:
        return everywhere
    pieces = rows.select("doc_id", "line_no", F.explode(F.concat(*shown)).alias("p")).select("doc_id", "line_no", "p.size", "p.gram")
    candidates = pieces.join(anchors, ["size", "gram"]).select("doc_id", "line_no", "pattern_id", "pattern").distinct()
    found = rows.join(candidates, ["doc_id", "line_no"]).where(F.contains("line", "pattern")).select("doc_id", "line_no", "pattern_id").distinct()
    return found.unionByName(everywhere)


def _pattern_scan(held):
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("pattern_id", pa.int64())])

    def run(batches):
        by_text: dict[str, list[int]] = {}
        for i, p in held.value:
            by_text.setdefault(p, []).append(i)
        always = by_text.pop("", [])
        automaton = ahocorasick.Automaton()
        for p, ids in by_text.items():
            automaton.add_word(p, ids)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for doc, no, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if line is None:
                    continue
                found = set(always)
                if by_text:
                    for _, ids in automaton.iter(line):
                        found.update(ids)
                out += [(doc, no, i) for i in sorted(found)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def stale(rows: DataFrame, id_col: str, modified: str, as_of: str, days: int = 30) -> DataFrame:
    """dat_stale_docs: age in days of each row's modification time, and whether it is over ``days``."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(modified))
    return rows.select(id_col, age.cast("long").alias("age_days"), (age > days).alias("stale"))


# Fixed values (writing phrases to avoid).
BANNED_PHRASES = [
    "passionate about", "results-oriented", "proven track record", "leveraged", "spearheaded", "facilitated",
    "synergies", "robust", "seamless", "cutting-edge", "innovative", "in today's fast-paced world",
    "demonstrated ability to",
]


def banned_phrases(docs: DataFrame) -> DataFrame:
    """dq_banned_phrases: (doc_id, phrase) for each listed phrase in the text (case-insensitive)."""
    low = F.lower("text")
    arr = F.array(*[F.lit(p) for p in BANNED_PHRASES])
    return docs.select("doc_id", F.explode(F.filter(arr, lambda p: F.instr(low, p) > 0)).alias("phrase"))


_WS = T.WS_CLASS[1:-1]
# Fixed value (url pattern).
URL_RE = rf"https?://[^{_WS},，。\n\)）]+|www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}[^{_WS},，。\n\)）]*"
EXCLUDED_HOSTS = ["104.com.tw", "linkedin.com"]


def urls(text: Column) -> Column:
    """txt_urls: urls (and ``www.`` hosts) in free text, trailing punctuation cut, excluded hosts dropped."""
    found = F.regexp_extract_all(text, F.lit(URL_RE), 0)
    cleaned = F.transform(found, lambda u: F.regexp_replace(u, r"[.。,，]+$", ""))
    full = F.transform(cleaned, lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)))
    return F.filter(full, lambda u: ~u.contains(EXCLUDED_HOSTS[0]) & ~u.contains(EXCLUDED_HOSTS[1]))


# Fixed values (default role archetypes and their signal words).
ARCHETYPES = [
    ("Frontend Product Engineer", ["React", "Vue", "UI", "SPA", "dashboard", "design systems", "frontend architecture"]),
    ("Full-stack Web Engineer", ["Frontend plus backend APIs", "database", "deployment", "product ownership"]),
    ("AI / Data Product Engineer", ["AI workflow", "data UI", "reporting", "automation", "analytics products"]),
    ("Web3 / DeFi Engineer", ["Wallets", "trading UI", "crypto", "token swaps", "blockchain integration"]),
    ("Platform / Infrastructure Engineer", ["Reliability", "observability", "CI/CD", "cloud", "internal platforms"]),
    ("Product / Technical Lead", ["Roadmap", "discovery", "stakeholders", "delivery leadership"]),
]


def archetype_votes(low: Column) -> Column:
    """cls_archetype: (votes, archetype) per archetype of a lower-case text, best first (votes desc, list order).

    The words of an archetype are counted only where one of them occurs at all.
    """
    votes = []
    for i, (name, signals) in enumerate(ARCHETYPES):
        pat = "(" + "|".join(K.jsre(r"\b" + _re_escape(s.lower()) + r"\b") for s in signals) + ")"
        count = F.when(~T.any_contains(low, [s.lower() for s in signals]), 0).otherwise(F.regexp_count(low, F.lit(pat)))
        votes.append(F.struct(count.alias("votes"), F.lit(-i).alias("neg_order"),
                              F.lit(name).alias("archetype")))
    return F.reverse(F.array_sort(F.array(*votes)))


def _re_escape(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch)
    return "".join(out)


# Fixed values (posting risk phrases).
RISK_PHRASES = ["抗壓性高", "配合專案時程", "責任制", "可接受加班", "派遣", "駐點", "面議"]


def risk_phrases(text: Column) -> Column:
    arr = F.array(*[F.lit(p) for p in RISK_PHRASES])
    return F.filter(arr, lambda p: F.instr(text, p) > 0)


# Fixed values (summary block and its keys).
SUMMARY_BLOCK = r"---SCORE_SUMMARY---\s*([\s\S]*?)---END_SUMMARY---"
SUMMARY_KEYS = ["COMPANY", "ROLE", "SCORE", "ARCHETYPE", "LEGITIMACY"]


def llm_summary(text: Column) -> list[Column]:
    """src_llm_summary: ``KEY: value`` fields inside the summary block, ``unknown`` when absent."""
    block = F.regexp_extract(text, SUMMARY_BLOCK, 1)
    has = text.rlike(SUMMARY_BLOCK)
    out = []
    for k in SUMMARY_KEYS:
        pat = k + r":\s*(.+)"
        v = F.when(has & block.rlike(pat), T.js_trim(F.regexp_extract(block, pat, 1)))
        out.append(F.coalesce(v, F.lit("unknown")).alias(k.lower()))
    return out


def log_score(text: Column) -> tuple[Column, Column]:
    """src_log_score: score from the first log line with ``"score": n`` (its last occurrence, as a greedy
    ``sed`` reads it) and the last five lines joined by spaces as error text."""
    lines_arr = F.split(text, "\n", -1)
    hit = F.filter(lines_arr, lambda x: x.rlike(r"\"score\":[ \t\n\f\r]*[0-9.]"))
    score = F.regexp_extract(F.get(hit, 0), r".*\"score\":[ \t\n\f\r]*([0-9.]+)", 1)
    ends_nl = text.endswith("\n")
    body = F.when(ends_nl, F.regexp_replace(text, "\n\\z", "")).otherwise(text)
    parts = F.split(body, "\n", -1)
    tail = F.slice(parts, F.greatest(F.size(parts) - 4, F.lit(1)), 5)
    err = F.concat(F.array_join(tail, " "), F.when(ends_nl, F.lit(" ")).otherwise(F.lit("")))
    return F.when(F.coalesce(score, F.lit("")) != "", score), err
