"""HTML and URL column builders: entity decoding, tag stripping, anchors, url resolution.

Pages are processed as whole strings inside one projection: a single
``regexp_extract_all`` segments or collects matches, higher-order functions
transform the pieces, nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, col, js_trim


def decode_entities(c) -> Column:
    """txt_decode_entities: five entities, ``&amp;`` first (so ``&amp;lt;`` decodes twice, as the reference does)."""
    s = col(c)
    for ent, ch in [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


def strip_tags(c) -> Column:
    """txt_strip_tags: tags -> space, decode, collapse whitespace, trim."""
    s = decode_entities(F.regexp_replace(col(c), r"<[^>]+>", " "))
    return js_trim(F.regexp_replace(s, rf"{WS_CLASS}+", " "))


def strip_html(c) -> Column:
    """txt_strip_html: block tags -> newline, other tags removed, six entities, at most two newlines."""
    s = F.regexp_replace(col(c), r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"(?i)</?(p|div|li|tr)[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for ent, ch in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return js_trim(s)


ANCHOR_RE = r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>([\s\S]*?)</a>"


def _percent_path(s: Column) -> Column:
    """Percent-encode what the URL parser escapes in a path: non-ASCII, space, quotes, angle brackets, backtick, braces."""
    chars = F.split(s, "(?!^)", -1)
    enc = F.transform(chars, lambda ch: F.when(
        ch.rlike("^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x5F\\x61-\\x7A\\x7C\\x7E]$"), ch
    ).otherwise(F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")))
    return F.array_join(enc, "")


def absolute_url(base, href) -> Column:
    """txt_absolute_url: resolve ``href`` against the page url (absolute, ``//``, ``/`` and relative forms)."""
    b, h = col(base), col(href)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base_dir = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    base_dir = F.when(base_dir != "", base_dir).otherwise(F.concat(origin, F.lit("/")))
    resolved = (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
                .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
                .when(h.startswith("/"), F.concat(origin, h))
                .otherwise(F.concat(base_dir, h)))
    host_part = F.regexp_extract(resolved, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.substr(resolved, F.length(host_part) + 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(origin == "", F.lit("")).otherwise(F.concat(F.lower(host_part), _percent_path(path)))


def company_from_url(url) -> Column:
    """txt_company_from_url: segment after ``/companies/`` or ``/company/``, else host without ``www.``."""
    u = col(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    seg = F.regexp_extract(path, r"^(?:/+[^/]+)*?/+(?:companies|company)/+([^/]+)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)),
                            r"^www\.", "")
    return F.when(seg != "", seg).otherwise(host)


def anchors(html, base) -> Column:
    """Array of (href decoded, title text) for every ``<a href>`` in document order."""
    h = col(html)
    hrefs = F.regexp_extract_all(h, F.lit(ANCHOR_RE), 1)
    inner = F.regexp_extract_all(h, F.lit(ANCHOR_RE), 2)
    return F.transform(F.arrays_zip(hrefs.alias("href"), inner.alias("inner")),
                       lambda z: F.struct(decode_entities(z["href"]).alias("href"),
                                          strip_tags(z["inner"]).alias("title")))


ATS_SEGMENT_RE = (r"(?i)<style\b[^>]*>[\s\S]*?</style>|<script\b[^>]*>[\s\S]*?</script>"
                  r"|<[^>]*>|[^<]+|<")
# Fixed values (character classes normalised for ATS parsers: name, pattern, replacement).
ATS_CLASSES = [
    ("em-dash", "\u2014", "-"),
    ("en-dash", "\u2013", "-"),
    ("smart-double-quote", "[\u201C\u201D\u201E\u201F]", '"'),
    ("smart-single-quote", "[\u2018\u2019\u201A\u201B]", "'"),
    ("ellipsis", "\u2026", "..."),
    ("zero-width", "[\u200B\u200C\u200D\u2060\uFEFF]", ""),
    ("nbsp", "\u00A0", " "),
]


def _sanitize(t: Column) -> Column:
    for _, pat, rep in ATS_CLASSES:
        t = F.regexp_replace(t, pat, rep)
    return t


def ats_normalize(html) -> Column:
    """txt_ats_normalize: typographic characters to ASCII in text nodes only (tags, style, script untouched)."""
    segs = F.regexp_extract_all(col(html), F.lit(ATS_SEGMENT_RE), 0)
    return F.array_join(F.transform(segs, lambda s: F.when(s.startswith("<"), s).otherwise(_sanitize(s))), "")


def ats_text_only(html) -> Column:
    segs = F.regexp_extract_all(col(html), F.lit(ATS_SEGMENT_RE), 0)
    return F.array_join(F.filter(segs, lambda s: ~s.startswith("<")), "")
