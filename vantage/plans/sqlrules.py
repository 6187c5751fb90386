"""The same rules restated in plain SQL, for the DuckDB oracles only.

The oracle must be an independent statement of the rule: these helpers write
SQL text (ASCII fixtures, so RE2 and Java regex agree), never Spark code.
"""

from __future__ import annotations

from ..functions import status as S


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def status_clean(x: str) -> str:
    return (f"trim(regexp_replace(lower(trim(replace({x}, '**', ''))), "
            f"'\\s+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*$', ''))")


def status_alias(x: str) -> str:
    c = status_clean(x)
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.ALIASES.items())
    return f"(CASE {c} {whens} ELSE {c} END)"


def status_contains(x: str) -> str:
    s0 = f"lower(trim(replace({x}, '**', '')))"
    s = f"(CASE WHEN strpos({s0}, ' 202') > 1 THEN trim(substr({s0}, 1, strpos({s0}, ' 202') - 1)) ELSE {s0} END)"

    def has(t):
        return f"strpos({s}, {q(t)}) > 0"

    return (
        f"(CASE WHEN {has('no aplicar')} OR {has('no_aplicar')} OR {s} = 'skip' OR {has('geo blocker')} THEN 'skip'"
        f" WHEN {has('interview')} OR {has('entrevista')} THEN 'interview'"
        f" WHEN {s} = 'offer' OR {has('oferta')} THEN 'offer'"
        f" WHEN {has('responded')} OR {has('respondido')} THEN 'responded'"
        f" WHEN {has('applied')} OR {has('aplicado')} OR {s} IN ('enviada', 'aplicada', 'sent') THEN 'applied'"
        f" WHEN {has('rejected')} OR {has('rechazado')} OR {s} = 'rechazada' THEN 'rejected'"
        f" WHEN {has('discarded')} OR {has('descartado')} OR {s} IN ('descartada', 'cerrada', 'cancelada')"
        f" OR {s} LIKE 'duplicado%' OR {s} LIKE 'dup%' THEN 'discarded'"
        f" WHEN {has('evaluated')} OR {has('evaluada')} OR {s} IN ('condicional', 'hold', 'monitor', 'evaluar', 'verificar')"
        f" THEN 'evaluated' ELSE {s} END)"
    )


def status_priority(x: str) -> str:
    s = status_contains(x)
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in S.PRIORITY.items())
    return f"(CASE {s} {whens} ELSE 8 END)"


def outcome(s: str) -> str:
    return (f"(CASE WHEN {s} IN {in_list(S.POSITIVE)} THEN 'positive' WHEN {s} IN {in_list(S.NEGATIVE)} "
            f"THEN 'negative' WHEN {s} IN {in_list(S.SELF_FILTERED)} THEN 'self_filtered' ELSE 'pending' END)")


def score_js(x: str) -> str:
    return (f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') "
            f"AS DOUBLE), 0.0)")


def score_strict(x: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '([0-9]+\\.?[0-9]*)/5', 1), '') AS DOUBLE), 0.0)"


def score_loose(x: str) -> str:
    m = f"regexp_extract(replace({x}, '**', ''), '([0-9.]+)', 1)"
    return (f"coalesce(TRY_CAST(nullif(regexp_extract({m}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)', 1), '') "
            f"AS DOUBLE), 0.0)")


def status_rank_raw(x: str) -> str:
    from ..functions.status import STATUS_RANK

    return "CASE lower(" + x + ") " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in STATUS_RANK.items()) + " ELSE 0 END"


def company_key_suffix(x: str) -> str:
    from ..functions.text import COMPANY_SUFFIXES

    s = f"lower(trim({x}))"
    for suf in COMPANY_SUFFIXES:
        s = f"regexp_replace({s}, {q(suf.replace('.', chr(92) + '.') + '$')}, '')"
    return f"trim({s})"


def status_strict(x: str) -> str:
    from ..functions import status as S

    lower = f"lower(trim(regexp_replace(replace({x}, '**', ''), '\\s+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*$', '')))"
    canon = " ".join(f"WHEN {q(c.lower())} THEN {q(c)}" for c in S.CANONICAL)
    alias = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.STRICT_ALIASES.items())
    return (f"coalesce(CASE {lower} {canon} END, CASE {lower} {alias} END, "
            f"CASE WHEN regexp_matches({lower}, '^(duplicado|dup|repost)') THEN 'Discarded' END, 'Evaluated')")


# JavaScript whitespace set in RE2 syntax (DuckDB's \s is ASCII only).
WS_RE2 = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def decode_entities(x: str) -> str:
    s = x
    for ent, ch in [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]:
        s = f"replace({s}, {q(ent)}, {q(ch)})"
    return s


def strip_tags(x: str) -> str:
    d = decode_entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    return f"regexp_replace(regexp_replace({d}, '{WS_RE2}+', ' ', 'g'), '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def absolute_url(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    bdir = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)', 1)"
    bdir = f"(CASE WHEN {bdir} <> '' THEN {bdir} ELSE {origin} || '/' END)"
    res = (f"(CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
           f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
           f"WHEN starts_with({href}, '/') THEN {origin} || {href} ELSE {bdir} || {href} END)")
    host = f"regexp_extract({res}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    path = f"substr({res}, length({host}) + 1)"
    path = f"(CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
    enc = (f"array_to_string(list_transform(string_split({path}, ''), lambda ch: CASE WHEN regexp_matches(ch, "
           f"'^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x5F\\x61-\\x7A\\x7C\\x7E]$') THEN ch "
           f"ELSE regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') END), '')")
    return f"(CASE WHEN {origin} = '' THEN '' ELSE lower({host}) || {enc} END)"


def company_from_url(u: str) -> str:
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    seg = f"regexp_extract({path}, '^(?:/+[^/]+)*?/+(?:companies|company)/+([^/]+)', 1)"
    host = (f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), "
            f"'^www\\.', '')")
    return f"(CASE WHEN {seg} <> '' THEN {seg} ELSE {host} END)"


_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F))


def company_key_alnum(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def company_key_spaced(x: str) -> str:
    return ("trim(regexp_replace(regexp_replace(regexp_replace(lower(" + x
            + "), '[()]', '', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))")


def _compatible(x: str) -> str:
    """Form KC of texts whose only compatibility characters are full-width ASCII (as in the fixtures)."""
    return f"nfc_normalize(translate({x}, {q(_FULL_WIDTH)}, {q(_HALF_WIDTH)}))"


def company_key_safe(x: str) -> str:
    return f"nullif(regexp_replace(lower({_compatible(x)}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g'), '')"


def company_key_safe_spaced(x: str) -> str:
    return (f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({_compatible(x)}), '[()]', '', 'g'), "
            "'\\s+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N} ]', '', 'g')), '')")


def _repair_text(x: str) -> str:
    return f"trim(replace({x}, '**', ''))"


def _repair_duplicate(s: str) -> str:
    return f"regexp_matches({s}, '(?i)^duplicado') OR regexp_matches({s}, '(?i)^dup\\b')"


def status_repair(x: str) -> str:
    """The repair rules in their order, from the same fixed values as the operator's."""
    from ..functions import status as S

    s = _repair_text(x)
    out = f"CASE WHEN {_repair_duplicate(s)} THEN 'Discarded'"
    out += "".join(f" WHEN regexp_matches({s}, {q(p)}) THEN {q(label)}" for p, label in S.REPAIR_PATTERNS)
    out += f" WHEN {s} IN ('\u2014', '-', '') THEN 'Discarded'"
    out += "".join(f" WHEN lower({s}) = {q(c.lower())} THEN {q(c)}" for c in S.CANONICAL)
    out += "".join(f" WHEN lower({s}) IN ({', '.join(map(q, values))}) THEN {q(label)}" for values, label in S.REPAIR_ALIASES)
    return out + " END"


def status_repair_note(x: str) -> str:
    from ..functions import status as S

    s = _repair_text(x)
    *earlier, (repost, _) = S.REPAIR_PATTERNS
    ruled = " OR ".join(f"regexp_matches({s}, {q(p)})" for p, _ in earlier)
    return f"CASE WHEN {_repair_duplicate(s)} OR (regexp_matches({s}, {q(repost)}) AND NOT ({ruled})) THEN trim({x}) END"
