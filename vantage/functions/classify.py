"""Category rules over free text (remote policy, company size, gap blockers, tech terms).

The reference writes these with JavaScript ``\\b``, which is an ASCII word
boundary; Java's ``\\b`` also treats accented letters as word characters, so
patterns are rewritten with an explicit ASCII boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_W = "[A-Za-z0-9_]"
ASCII_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def jsre(pattern: str) -> str:
    """A JavaScript regex source with ``\\b`` made ASCII for Java."""
    return pattern.replace(r"\b", ASCII_B)


# Fixed values (remote policy rules, tested in order on lower-case text).
REMOTE_RULES = [
    (r"\b(us[- ]?only|canada[- ]?only|residents only|usa only|us residents|canada residents)\b", "geo-restricted"),
    (r"\bargentina\s+remote\s+only\b", "geo-restricted"),
    (r"\b(hybrid|on-?site|office|columbus|cape town|relocat)\b", "hybrid/onsite"),
    (r"\b(global|anywhere|worldwide|no restrict|70\+|work from anywhere)\b", "global remote"),
    (r"\b(remote|latam|americas|brazil|fully remote)\b", "regional remote"),
]

# Fixed values (blocker rules over a gap description; soft gaps have no blocker).
BLOCKER_RULES = [
    (r"\b(residency|us[- ]only|canada|location|visa|geo|country|region)\b", "geo-restriction"),
    (r"\b(javascript|typescript|python|ruby|java|go|rust|node|react|angular|vue|django|flask|rails)\b", "stack-mismatch"),
    (r"\b(senior|staff|lead|principal|director|manager|head)\b", "seniority-mismatch"),
    (r"\b(hybrid|on-?site|office|relocat)\b", "onsite-requirement"),
]

# Fixed values (technology terms counted in gap descriptions, case-insensitive, in this order).
TECH_TERMS = (r"\b(JavaScript|TypeScript|Python|Ruby|Java|Go|Rust|Node\.?js|React|Angular|Vue\.?js|Django|Flask|Rails"
              r"|PHP|Laravel|Symfony|Kotlin|Swift|C\+\+|C#|\.NET|MongoDB|MySQL|PostgreSQL|Redis|GraphQL|REST|AWS|GCP"
              r"|Azure|Docker|Kubernetes|Terraform|Supabase|Inngest|React Native)\b")


def remote_bucket(c) -> Column:
    """cls_remote: geo-restricted → hybrid/onsite → global → regional → unknown."""
    lower = F.lower(col(c))
    out = F.when(F.coalesce(col(c), F.lit("")) == "", F.lit("unknown"))
    for pattern, label in REMOTE_RULES:
        out = out.when(lower.rlike(jsre(pattern)), F.lit(label))
    return out.otherwise(F.lit("unknown"))


def company_size(c, policy: str = "parity") -> Column:
    """cls_company_size: largest number ≤50 startup, ≤500 scaleup, else enterprise; word fallback.

    ``parity``: a token without digits (a lone comma) makes the maximum NaN,
    which the reference reads as enterprise.  ``safe`` ignores such tokens.
    """
    lower = F.lower(col(c))
    tokens = F.regexp_extract_all(lower, F.lit("[0-9,]+"), 0)
    if policy == "safe":
        tokens = F.filter(tokens, lambda t: t.rlike("[0-9]"))
    values = F.transform(tokens, lambda t: F.when(F.regexp_replace(t, ",", "") != "",
                                                  F.regexp_replace(t, ",", "").cast("double")))
    has_nan = F.exists(values, lambda v: v.isNull())
    mx = F.array_max(values)
    by_number = (F.when(has_nan, "enterprise").when(mx <= 50, "startup").when(mx <= 500, "scaleup")
                 .otherwise("enterprise"))
    return (F.when(F.coalesce(col(c), F.lit("")) == "", F.lit("unknown"))
            .when(F.size(tokens) > 0, by_number)
            .when(lower.rlike(jsre(r"\b(small|elite|tiny|founding)\b")), "startup")
            .when(lower.rlike(jsre(r"\b(large|enterprise|global)\b")), "enterprise")
            .otherwise("unknown"))


def blocker(description, severity) -> Column:
    """cls_blocker: soft gaps → null, then geo / stack / seniority / onsite / other."""
    d = F.lower(col(description))
    s = F.lower(col(severity))
    out = F.when(s.contains("nice") | s.contains("soft"), F.lit(None).cast("string"))
    for pattern, label in BLOCKER_RULES:
        out = out.when(d.rlike(jsre(pattern)), F.lit(label))
    return out.otherwise(F.lit("other"))


def tech_mentions(description) -> Column:
    """Technology terms in a gap description, first letter upper-cased as matched."""
    found = F.regexp_extract_all(col(description), F.lit("(?i)" + jsre(TECH_TERMS)), 1)
    return F.transform(found, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))
