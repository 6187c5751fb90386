"""String, number and URL column builders (Column -> Column).

All rules are built-in expressions, so they stay inside whole-stage codegen.
The reference is JavaScript/Go; where the engines disagree (Unicode
whitespace, word boundaries, prefix number parsing, half-up rounding) the
builders restate the reference's behaviour explicitly.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# JavaScript's \s / String.trim() set (Java's \s is ASCII only).
WS_CLASS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# ASCII word boundary, the way JS and RE2 read \b (Java 17 counts accented letters as word chars).
WB_L = r"(?<![A-Za-z0-9_])"
WB_R = r"(?![A-Za-z0-9_])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as characters (for btrim, which is far cheaper than a regex).
WS_CHARS = (" \t\n\r\f\u000b\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c) -> Column:
    """String.prototype.trim: strip the Unicode whitespace set at both ends."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Collapse whitespace runs to one space and trim (txt_normalize)."""
    return js_trim(F.regexp_replace(col(c), rf"{WS_CLASS}+", " "))


def normalize_lower(c) -> Column:
    return F.lower(collapse_ws(c))


def strip_bold(c) -> Column:
    return F.replace(col(c), F.lit("**"), F.lit(""))


def parse_int_prefix(c) -> Column:
    """parseInt: leading whitespace, optional sign, digits; else null.

    Written so the regex runs once per row: an empty extract casts to null
    (``try_cast``), so no separate emptiness test repeats the extraction.
    """
    return F.regexp_extract(col(c), rf"^{WS_CLASS}*([+-]?[0-9]+)", 1).try_cast("int")


def int_of_digits(digits: Column) -> Column:
    """A validated ``[+-]?[0-9]+`` string (or empty) as INT; null when empty or out of range."""
    return digits.try_cast("int")


def parse_float_prefix(c) -> Column:
    """parseFloat: leading decimal literal (``"4.2/5"`` -> 4.2, ``"**4/5**"`` -> null)."""
    num = F.regexp_extract(col(c), rf"^{WS_CLASS}*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return num.try_cast("double")


def js_round(c) -> Column:
    """Math.round: half-up towards +infinity."""
    return F.floor(col(c).cast("double") + F.lit(0.5))


def round_to(c, places: int) -> Column:
    """Math.round(x * 10^p) / 10^p."""
    scale = float(10 ** places)
    return F.floor(col(c).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def truncate_chars(c, n: int, ellipsis: str = "...") -> Column:
    """Cut to ``n`` characters, ending with ``ellipsis`` when cut (txt_truncate)."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(ellipsis)), F.lit(ellipsis))).otherwise(c)


def any_contains(c, terms: list[str]) -> Column:
    """OR of literal ``contains`` tests (terms are a small fixed list)."""
    c = col(c)
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def report_number(c) -> Column:
    """``[n]`` in a report cell -> n (merge flavour), else null."""
    return F.regexp_extract(col(c), r"\[([0-9]+)\]", 1).try_cast("int")


def report_path(c) -> Column:
    """``](path)`` target of a markdown link, else null."""
    p = F.regexp_extract(col(c), r"\]\(([^)]+)\)", 1)
    return F.when(p != "", p)


def score_loose(c) -> Column:
    """Merge parser: strip bold, first ``[\\d.]+`` as a float, else 0."""
    m = F.regexp_extract(strip_bold(col(c)), r"([0-9.]+)", 1)
    return F.coalesce(parse_float_prefix(m), F.lit(0.0))


def score_js(c) -> Column:
    """Analysis parser: ``parseFloat(raw) || 0`` (bold scores give 0)."""
    return F.coalesce(parse_float_prefix(c), F.lit(0.0))


def score_strict(c) -> Column:
    """Dashboard parser: first ``(\\d+\\.?\\d*)/5``, else 0."""
    return F.coalesce(F.regexp_extract(col(c), r"([0-9]+\.?[0-9]*)/5", 1).try_cast("double"), F.lit(0.0))


def company_key_alnum(c) -> Column:
    """Merge flavour: lower case, keep ``[a-z0-9]`` only."""
    return F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]", "")


def company_key_spaced(c) -> Column:
    """Dedup flavour: lower, drop parentheses, collapse whitespace, keep ``[a-z0-9 ]``, trim."""
    s = F.regexp_replace(F.lower(col(c)), r"[()]", "")
    s = F.regexp_replace(s, rf"{WS_CLASS}+", " ")
    return F.trim(F.regexp_replace(s, r"[^a-z0-9 ]", ""))


def _compatible(c) -> Column:
    """Unicode normalisation form KC, which Spark has no function for."""

    @F.pandas_udf(StringType())  # nested, so that workers get the code with the plan
    def nfkc(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFKC")

    return nfkc(col(c))


def company_key_safe(c) -> Column:
    """Merge key for names of any script: form KC, lower case, letters, marks and digits kept; null when none is left.

    A null key is in no block, so names of punctuation alone match nothing by role.
    """
    key = F.regexp_replace(F.lower(_compatible(c)), r"[^\p{L}\p{M}\p{N}]", "")
    return F.when(key != "", key)


def company_key_safe_spaced(c) -> Column:
    """Dedup key for names of any script: as ``company_key_spaced``, but with letters, marks and digits of all scripts."""
    s = F.regexp_replace(F.lower(_compatible(c)), r"[()]", "")
    s = F.regexp_replace(s, rf"{WS_CLASS}+", " ")
    key = F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N} ]", ""))
    return F.when(key != "", key)


MERGE_KEYS = {"parity": company_key_alnum, "safe": company_key_safe}
DEDUP_KEYS = {"parity": company_key_spaced, "safe": company_key_safe_spaced}


def company_key_suffix(c) -> Column:
    """Dashboard flavour: lower, strip common legal suffixes, keep letters/digits/spaces."""
    s = F.lower(js_trim(col(c)))
    for suffix in COMPANY_SUFFIXES:
        s = F.regexp_replace(s, re.escape(suffix) + "$", "")
    return js_trim(s)


def company_key_ws(c) -> Column:
    """Scanner flavour: whitespace-collapsed lower case."""
    return normalize_lower(c)


# Fixed values (dashboard company normaliser): suffixes trimmed once each, in this order.
COMPANY_SUFFIXES = [" inc.", " inc", " llc", " ltd", " corp", " corporation", " technologies", " technology", " group", " co."]


def slug(c, max_len: int | None = None) -> Column:
    """Lower case, non-alphanumerics to ``-``, trimmed dashes; optional length cap."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, max_len) if max_len else s


def js_number(c) -> Column:
    """Number#toString for ordinary doubles: integral values print without ``.0``."""
    c = col(c).cast("double")
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def file_slug(c, max_len: int | None = None) -> Column:
    """File-name slug: path-hostile characters to ``-``, runs collapsed; the first ``max_len`` characters where given."""
    s = F.regexp_replace(F.regexp_replace(col(c), r'[\s/\\:*?"<>|]', "-"), "-+", "-")
    return F.substring(s, 1, max_len) if max_len else s


EMAIL_RE = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
CONTACT_NAME_RE = r"(?i)(?:Emailed|emailed|contact[:\s]+|to\s+)([A-Z][a-z]+ ?[A-Z]?[a-z]*)\s*(?:at|@|$)"


def contacts(df, notes: str):
    """txt_contacts: one row per e-mail in ``notes`` with the name written before it."""
    from pyspark.sql import functions as F2  # local alias keeps the builder self-contained

    emails = F2.regexp_extract_all(col(notes), F2.lit(EMAIL_RE), 0)
    out = df.select("*", F2.posexplode(emails).alias("contact_idx", "email"))
    before = F2.expr(f"substring_index(`{notes}`, email, 1)")
    name = F2.regexp_extract(before, CONTACT_NAME_RE, 1)
    return out.withColumn("name", F2.when(name != "", name))
