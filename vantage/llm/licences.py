"""Licence scan: Aho-Corasick over phrases and tags, shunting-yard over licence expressions (operator 10).

Texts become sequences of folded words; one automaton finds every notice phrase in one pass.  Where a
text has an identifier tag, a second automaton finds the tags and the expression behind each is parsed
with precedence WITH > AND > OR and evaluated: AND asks for all its sides, OR for any, and an exception
loosens the licence it is attached to.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import table

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices and identifiers; their labels are added to the base ones.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "apache 2 0": "apache-2.0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "isc license": "isc",
    "no rights reserved": "public-domain",
    "proprietary and confidential": "proprietary",
}
#: Identifiers that stand in prose without a tag; their words are a phrase, and they are its label.
IDENTIFIERS = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cc0-1.0",
               *(f"{name}-{version}{end}" for name, versions in (("gpl", ("2.0", "3.0")), ("lgpl", ("2.0", "2.1", "3.0")), ("agpl", ("3.0",)))
                 for version in versions for end in ("", "-only", "-or-later")))
#: Short forms, and those of names that are words of their own.
SHORT = {**{f"{name}{gap}{v}": f"{name}-{v[1:]}.0" for name in ("gpl", "lgpl", "agpl") for gap in ("", " ") for v in ("v2", "v3")
            if (name, v) != ("agpl", "v2") and (name, v) != ("lgpl", "v2")},
         "lgplv2 1": "lgpl-2.1", "lgpl v2 1": "lgpl-2.1", "mit licensed": "mit", "released under mit": "mit", "licensed under mit": "mit",
         "under the mit": "mit", "apache licensed": "apache"}
#: The first is a tag whatever stands behind it, the others only before known licences.
TAGS = ("spdx-license-identifier", "license-expression", "license", "licence")
_SEPARATOR = re.compile(r"""["']?[ \t]{0,8}[:=][ \t"']*""")
#: A line break inside brackets, with the comment sign that begins the next line.
_NEXT_LINE = re.compile(r"[ \t\r]*\n[ \t]*(?://+|#+|\*+|--+|;+|%+|!+)?[ \t]*")
#: How freely a text under a licence may be used, by the start of its name: 1 free, 0 not at all.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0, "zlib": 1.0,
    "cc-by-nc": 0.3, "cc-by-nd": 0.3, "cc-by-sa": 0.7, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "agpl": 0.3, "gpl": 0.4, "reserved": 0.0, "proprietary": 0.0,
}
#: What an exception adds to the licence it is attached to.
EXCEPTION_BONUS = 0.2
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_EXPRESSION_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_FOLD = {b: b + 32 for b in range(65, 91)}
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def freedom(name: str) -> float | None:
    """The rating of the longest known start of a licence name; None for unknown ones."""
    best = max((k for k in FREEDOM if name == k or name.startswith((k + "-", k + "+"))), key=len, default=None)
    return FREEDOM[best] if best else None


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None where the tokens are no expression."""
    out, ops, operand = [], [], False
    for t in tokens:
        low = t.lower()
        if low in _PRECEDENCE:
            if not operand:
                return None
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif t == "(":
            if operand:
                return None
            ops.append(t)
        elif t == ")":
            if not operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if operand:
                return None
            out.append(low)
            operand = True
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def expression_tokens(text: str, at: int = 0) -> list[str]:
    """The longest part of ``text`` from ``at`` on that can be an expression: of one line, or of more inside brackets."""
    tokens, depth, operand = [], 0, False
    while True:
        if depth and (gap := _NEXT_LINE.match(text, at)):
            at = gap.end()
        m = _EXPRESSION_TOKEN.match(text, at)
        if not m:
            break
        t = m[0].rstrip(".-") or m[0]
        if t.lower() in _PRECEDENCE:
            if not operand:
                break
            operand = False
        elif t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        else:
            if operand:
                break
            operand = True
        tokens.append(t)
        at = m.end()
        while at < len(text) and text[at] in " \t":
            at += 1
    while tokens and (tokens[-1].lower() in _PRECEDENCE or tokens[-1] == "("):
        tokens.pop()
    return tokens


def evaluate(postfix: list[str]) -> tuple[set[str], float | None]:
    """(licence names, freedom): OR takes the freest side, AND the least free, WITH adds the bonus."""
    stack: list[tuple[set[str], float | None]] = []
    for t in postfix:
        if t not in _PRECEDENCE:
            stack.append(({t}, freedom(t)))
            continue
        (rn, rv), (ln, lv) = stack.pop(), stack.pop()
        if t == "with":
            stack.append(({f"{x} with {y}" for x in ln for y in rn}, None if lv is None else min(1.0, lv + EXCEPTION_BONUS)))
        else:
            known = [v for v in (lv, rv) if v is not None]
            # An unknown side decides nothing under OR and can't be met under AND.
            value = max(known, default=None) if t == "or" else (min(known) if len(known) == 2 else None)
            stack.append((ln | rn, value))
    return stack[0]


@lru_cache(maxsize=1)
def _automata():
    phrases = ahocorasick.Automaton()
    named = {" ".join(re.split(r"[.-]", name)): name for name in IDENTIFIERS}
    for p, label in {**SHORT, **named, **NOTICES, **BASE_PHRASES}.items():
        key = f" {p.encode().decode('latin-1')} "
        phrases.add_word(key, (len(key), label, p in BASE_PHRASES, p in named and p not in NOTICES))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for t in TAGS:
        tags.add_word(t, t)
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, freedom)."""
    phrases, tags = _automata()
    words = text.encode().translate(_WORD_BYTES).split()
    flat = f" {b' '.join(words).decode('latin-1')} "
    base, labels, places, ratings, score = set(), set(), [], [], 0.0
    at = word = 0
    named: dict[int, str] = {}
    for end, (size, label, is_base, is_name) in phrases.iter(flat):
        if is_name:
            # Longer identifiers end later and replace the shorter one that they begin with.
            named[end - size] = label
        else:
            labels.add(label)
        score = max(score, 0.8)
        if is_base:
            base.add(label)
            # Ends ascend and phrases are short, so the words are counted on from the last place, or a little back.
            start = end - size + 2
            word += flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)
            at = start
            places.append(word - 1)
    labels |= set(named.values())
    found = []
    if "license" in flat or "licence" in flat:
        # A-Z alone are folded, so that places in the text stay: other letters may change their number.
        low = text.lower() if text.isascii() else text.translate(_FOLD)
        for end, tag in tags.iter(low):
            separator = _SEPARATOR.match(text, end + 1)
            if not separator:
                continue
            tokens = expression_tokens(text, separator.end())
            postfix = to_postfix(tokens) if tokens else None
            if not postfix:
                continue
            names, value = evaluate(postfix)
            if tag != TAGS[0] and value is None:
                continue
            found.append(" ".join(postfix))
            labels |= {x.split(" with ")[0] for x in names}
            score = 1.0 if value is not None else max(score, 0.9)
            if value is not None:
                ratings.append(value)
    ratings += [v for v in map(freedom, labels) if v is not None] if not found else []
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, ";".join(found), min(ratings, default=None))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                     ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                     ("expressions", pa.string()), ("freedom", pa.float64())])


def _scan(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            rows = [scan_text(t or "") for t in some.column(1).to_pylist()]
            yield pa.record_batch([some.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_SCHEMA)[1:]))],
                                  schema=_SCHEMA)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string).

    n_words; n_base, first_word and last_word of the places of base phrases; base_labels and labels
    (distinct, sorted, comma-joined); score in [0, 1] (0 none, 0.8 a notice, 0.9 a tag with unknown
    licences, 1 an evaluated tag); expressions (postfix, ';'-joined) and the freedom of the strictest
    statement.  A tag may be a quoted key, with ":" or "=" behind it; an expression goes on in the next line
    inside brackets; identifiers and short forms in prose count as notices.  The time is linear in the text.  Words are runs of digits, letters and non-ASCII characters with A-Z folded.  Null or empty
    texts have no words, empty labels and score 0; broken expressions are no expressions; a null doc_id is
    carried along; repeated rows give repeated rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
               "score double, expressions string, freedom double")


@query("op10_license_expressions")
def op10_license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))
