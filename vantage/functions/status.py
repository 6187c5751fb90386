"""Status, outcome and priority rules (Column -> Column).

The reference ships four status normalisers that disagree on purpose; each is
kept as its own named policy.  Dictionaries are map literals, so they are
folded into the generated code instead of being joined.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, col, js_trim, strip_bold

# Fixed values (lower-case status aliases of the analysis / cadence scripts).
ALIASES = {
    "evaluada": "evaluated", "condicional": "evaluated", "hold": "evaluated",
    "evaluar": "evaluated", "verificar": "evaluated",
    "aplicado": "applied", "enviada": "applied", "aplicada": "applied",
    "applied": "applied", "sent": "applied",
    "respondido": "responded",
    "entrevista": "interview",
    "oferta": "offer",
    "rechazado": "rejected", "rechazada": "rejected",
    "descartado": "discarded", "descartada": "discarded",
    "cerrada": "discarded", "cancelada": "discarded",
    "no aplicar": "skip", "no_aplicar": "skip", "monitor": "skip", "geo blocker": "skip",
}

# Fixed values (canonical labels and the merge script's alias table).
CANONICAL = ["Evaluated", "Applied", "Responded", "Interview", "Offer", "Rejected", "Discarded", "SKIP"]
STRICT_ALIASES = {
    "evaluada": "Evaluated", "condicional": "Evaluated", "hold": "Evaluated", "evaluar": "Evaluated", "verificar": "Evaluated",
    "aplicado": "Applied", "enviada": "Applied", "aplicada": "Applied", "applied": "Applied", "sent": "Applied",
    "respondido": "Responded",
    "entrevista": "Interview",
    "oferta": "Offer",
    "rechazado": "Rejected", "rechazada": "Rejected",
    "descartado": "Discarded", "descartada": "Discarded", "cerrada": "Discarded", "cancelada": "Discarded",
    "no aplicar": "SKIP", "no_aplicar": "SKIP", "skip": "SKIP", "monitor": "SKIP",
    "geo blocker": "SKIP",
}

# Fixed values (dedup advancement rank on the raw lower-case status; missing -> 0).
STATUS_RANK = {
    "skip": 0, "discarded": 0, "rejected": 1, "evaluated": 2, "applied": 3,
    "responded": 4, "interview": 5, "offer": 6,
    "no_aplicar": 0, "no aplicar": 0, "descartado": 0, "descartada": 0,
    "rechazado": 1, "rechazada": 1, "evaluada": 2, "aplicado": 3,
    "respondido": 4, "entrevista": 5, "oferta": 6,
}

# Fixed values (dashboard display priority; anything else 8).
PRIORITY = {
    "interview": 0, "offer": 1, "responded": 2, "applied": 3, "evaluated": 4,
    "skip": 5, "rejected": 6, "discarded": 7,
}

# Fixed values (outcome classes of the analysis script).
POSITIVE = ["interview", "offer", "responded", "applied"]
NEGATIVE = ["rejected", "discarded"]
SELF_FILTERED = ["skip"]

# Fixed values (the merge script's "looks like a status" prefixes).
STATUS_PREFIXES = [
    "evaluated", "applied", "responded", "interview", "offer", "rejected", "discarded", "skip",
    "evaluada", "aplicado", "respondido", "entrevista", "oferta", "rechazado", "descartado",
    "no aplicar", "cerrada", "duplicado", "repost", "condicional", "hold", "monitor",
]


def map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def _lookup(d: dict, key: Column) -> Column:
    return F.try_element_at(map_lit(d), key)


def _strip_date_suffix(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS_CLASS}+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*$", "")


def status_clean(c) -> Column:
    """Bold stripped, trimmed, lower case, trailing `` YYYY-MM-DD…`` removed."""
    return js_trim(_strip_date_suffix(F.lower(js_trim(strip_bold(col(c))))))


def status_alias(c) -> Column:
    """cls_status_alias: alias map, else the cleaned text passes through."""
    clean = status_clean(c)
    return F.coalesce(_lookup(ALIASES, clean), clean)


def status_strict(c) -> Column:
    """cls_status_strict: canonical label; dup/repost -> Discarded; unknown -> Evaluated."""
    lower = F.lower(js_trim(_strip_date_suffix(strip_bold(col(c)))))
    canon = {s.lower(): s for s in CANONICAL}
    return F.coalesce(
        _lookup(canon, lower),
        _lookup(STRICT_ALIASES, lower),
        F.when(lower.rlike("^(duplicado|dup|repost)"), F.lit("Discarded")),
        F.lit("Evaluated"),
    )


def status_strict_known(c) -> Column:
    """False when ``status_strict`` fell back to the default (the warning case)."""
    lower = F.lower(js_trim(_strip_date_suffix(strip_bold(col(c)))))
    canon = {s.lower(): s for s in CANONICAL}
    return (
        _lookup(canon, lower).isNotNull()
        | _lookup(STRICT_ALIASES, lower).isNotNull()
        | lower.rlike("^(duplicado|dup|repost)")
    )


def status_contains(c) -> Column:
    """cls_status_contains: the dashboard's ordered ``contains`` tests."""
    s = F.lower(js_trim(strip_bold(col(c))))
    s = js_trim(F.regexp_replace(s, r"^(.+?) 202.*$", "$1"))
    has = s.contains
    return (
        F.when(has("no aplicar") | has("no_aplicar") | (s == "skip") | has("geo blocker"), "skip")
        .when(has("interview") | has("entrevista"), "interview")
        .when((s == "offer") | has("oferta"), "offer")
        .when(has("responded") | has("respondido"), "responded")
        .when(has("applied") | has("aplicado") | s.isin("enviada", "aplicada", "sent"), "applied")
        .when(has("rejected") | has("rechazado") | (s == "rechazada"), "rejected")
        .when(has("discarded") | has("descartado") | s.isin("descartada", "cerrada", "cancelada")
              | s.startswith("duplicado") | s.startswith("dup"), "discarded")
        .when(has("evaluated") | has("evaluada") | s.isin("condicional", "hold", "monitor", "evaluar", "verificar"),
              "evaluated")
        .otherwise(s)
    )


def status_priority(c) -> Column:
    """cls_status_priority: display priority 0-8 over the dashboard status."""
    return F.coalesce(_lookup(PRIORITY, status_contains(c)), F.lit(8))


def status_rank_raw(c) -> Column:
    """Dedup rank: raw lower-case lookup (bold or dated statuses rank 0)."""
    return F.coalesce(_lookup(STATUS_RANK, F.lower(col(c))), F.lit(0))


def outcome(normalized) -> Column:
    """cls_outcome over an alias-normalised status."""
    s = col(normalized)
    return (
        F.when(s.isin(*POSITIVE), "positive")
        .when(s.isin(*NEGATIVE), "negative")
        .when(s.isin(*SELF_FILTERED), "self_filtered")
        .otherwise("pending")
    )


def looks_like_status(c) -> Column:
    return F.lower(col(c)).rlike("^(" + "|".join(STATUS_PREFIXES) + ")")


def looks_like_score(c) -> Column:
    c = col(c)
    return c.rlike(r"^[0-9]+\.?[0-9]*/5$") | (c == "N/A") | (c == "DUP")


# --- repair policy (status repair script) ------------------------------------

def status_repair(c) -> Column:
    """cls_status_repair: ordered rules -> canonical label; null when unknown."""
    s = js_trim(strip_bold(col(c)))
    lower = F.lower(s)
    out = F.when(s.rlike(r"(?i)^duplicado") | s.rlike(r"(?i)^dup(?![A-Za-z0-9_])"), "Discarded")
    for pattern, label in REPAIR_PATTERNS:
        out = out.when(s.rlike(pattern), label)
    out = out.when(s.isin("\u2014", "-", ""), "Discarded")
    for label in CANONICAL:
        out = out.when(lower == label.lower(), label)
    for values, label in REPAIR_ALIASES:
        out = out.when(lower.isin(*values), label)
    return out


def status_repair_note(c) -> Column:
    """Text the repair moves into the notes (duplicate / repost markers), else null."""
    s = js_trim(strip_bold(col(c)))
    duplicate = s.rlike(r"(?i)^duplicado") | s.rlike(r"(?i)^dup(?![A-Za-z0-9_])")
    *earlier, (repost, _) = REPAIR_PATTERNS
    ruled = reduce(or_, [s.rlike(p) for p, _ in earlier])
    return F.when(duplicate | (s.rlike(repost) & ~ruled), js_trim(col(c)))


# Fixed values (repair rules after the duplicate test, in this order; case-insensitive).
REPAIR_PATTERNS = [
    (r"(?i)^cerrada$", "Discarded"),
    (r"(?i)^cancelada", "Discarded"),
    (r"(?i)^descartada$", "Discarded"),
    (r"(?i)^descartado$", "Discarded"),
    (r"(?i)^rechazada?$", "Rejected"),
    (r"(?i)^rechazado\s+[0-9]{4}", "Rejected"),
    (r"(?i)^aplicado\s+[0-9]{4}", "Applied"),
    (r"(?i)^(condicional|hold|evaluar|verificar)$", "Evaluated"),
    (r"(?i)^monitor$", "SKIP"),
    (r"(?i)geo.?blocker", "SKIP"),
    (r"(?i)^repost", "Discarded"),
]
# Fixed values (repair aliases tested after the canonical labels).
REPAIR_ALIASES = [
    (["evaluada"], "Evaluated"),
    (["aplicado", "enviada", "aplicada", "applied", "sent"], "Applied"),
    (["respondido"], "Responded"),
    (["entrevista"], "Interview"),
    (["oferta"], "Offer"),
    (["cerrada", "descartada"], "Discarded"),
    (["no aplicar", "no_aplicar", "skip"], "SKIP"),
]
