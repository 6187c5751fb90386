"""Secret scan with password guess costs (operator 7).

Fixed patterns find assignments, access keys and long hexadecimal runs.  Values in a credential context
(a name with a credential word, then a separator or "is", then one value) are also rated by what guessing them
costs: dynamic programming finds the cheapest split of the value into dictionary words, dates, repeats,
sequences, keyboard walks and brute-force spans, and values above a threshold become spans of kind
``guess``.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import table

#: Base patterns: case of letters is ignored in the first alone, and for ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
#: A word that makes a name a credential's, anywhere in the name; ``pass`` and ``pin`` as a part of it, as other words hold them.
CREDENTIAL = (r"pass(?:word|wd|phrase|code)|pwd|secret(?!ar)|token(?!i[sz])|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or|ent)"
              r"|(?:(?<!com)(?<!by)(?<!sur)(?<!tres)(?<!over)(?<!under)pass|(?-i:(?<![A-Za-z])|(?<=[a-z])(?=P))pin)(?-i:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))")
_GAP = r"[\x20\t]*+\s{0,3}[\x20\t]*+"
#: Values in a credential context: a whole name (DB_PASSWORD, userPassword, secret.key), read once, any spaces or tabs, a separator.
#: A quoted value ends at its quote, another one at a space, a quote, a closing bracket or one of & , ; < >.
CONTEXT = re.compile(
    rf"""(?<![A-Za-z0-9_.-])(?>[A-Za-z0-9_.-]*?(?:{CREDENTIAL}))[A-Za-z0-9_.-]*+["']?{_GAP}(?:[:=]|=>|\bis\b){_GAP}"""
    r"""(?:"([\x20!#-~]{6,}+)"|'([\x20-&(-~]{6,}+)'|["']?([!#-%(*+\--:=?-\\^-|~]{6,}+))""",
    re.A | re.I)
KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
GUESS_THRESHOLD = 8.0

#: Common password words, most common first.
COMMON = ("password", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "football", "baseball", "sunshine",
          "princess", "shadow", "superman", "batman", "trustno", "iloveyou", "qwerty", "secret", "hello", "freedom", "whatever",
          "starwars", "summer", "winter", "spring", "autumn", "monday", "friday", "love", "test", "guest", "user", "root", "default",
          "changeme", "example", "sample", "demo", "temp", "pass", "pwd", "token", "key", "api", "your", "my", "the", "here", "none",
          "null", "true", "false", "dev", "prod", "server", "database", "access", "private", "public", "company", "house", "computer")
#: Rows of a keyboard; a walk follows a row in either direction.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_LEET = str.maketrans("@4301!$57", "aaeoiisst")
_YEAR, _MONTH, _DAY, _SEP = r"(?:19|20)\d{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
#: Dates by year, day or month first, and years alone, with log10 of how many there are.
DATES = [(re.compile(_SEP.join(parts)), math.log10(366 * 120)) for parts in ((_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR), (_MONTH, _DAY, _YEAR))]
DATES.append((re.compile(_YEAR), math.log10(120)))
#: log10 of the choice of a segment's model, paid once a segment.
CHOICE = 0.3
#: Letters of the longest dictionary word.
LONGEST_WORD = 24
#: Shortest run that counts as a repeat or a walk.
MIN_RUN = 3


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


@lru_cache(maxsize=1)
def _neighbours() -> set[str]:
    steps = set()
    for row in (*KEY_ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789"):
        steps |= {a + b for a, b in zip(row, row[1:], strict=False)}
    return steps | {x[::-1] for x in steps}


@lru_cache(maxsize=2)
def dictionary(vocabulary: str | None = None) -> dict[str, int]:
    """word -> rank: the common password words, then the words of a tokenizer's vocabulary, the most frequent first.

    ``vocabulary`` is the file of a word-based byte-pair tokenizer, whose merges stand by frequency; its whole words of
    ASCII letters (three or more, LONGEST_WORD at most) are taken.  A word of both lists has its smaller rank.
    """
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    if vocabulary:
        from tokenizers import Tokenizer

        vocab = Tokenizer.from_file(vocabulary).get_vocab()
        whole = sorted((i, t[:-4]) for t, i in vocab.items() if t.endswith("</w>"))
        words = [t for _, t in whole if MIN_RUN <= len(t) <= LONGEST_WORD and t.isascii() and t.isalpha()]
        for i, w in enumerate(words):
            ranks.setdefault(w, i + 1)
            ranks[w] = min(ranks[w], i + 1)
    return ranks


def _runs(value: str, joined) -> list[int]:
    """For every place j, where the maximal run that character j - 1 ends or continues begins."""
    begin = [0] * (len(value) + 1)
    for j in range(2, len(value) + 1):
        begin[j] = begin[j - 1] if joined(j) else j - 1
    return begin


class _Run:
    """The cheapest sub-run of a maximal run that ends at a place, for starts given in order.

    A sub-run of n characters costs c + log10(n), so a start that an earlier one undercuts now stays
    undercut, as does one that a later start does not exceed; few starts are ever open.
    """

    def __init__(self):
        self.open: list[tuple[int, float]] = []

    def best(self, start: int, before: float, end: int) -> tuple[float, int]:
        """Adds ``start`` (reached at cost ``before``); (cost up to ``end`` but for c, start of the best sub-run)."""
        while self.open and self.open[-1][1] >= before:
            self.open.pop()
        self.open.append((start, before))
        kept, low, at = [], math.inf, start
        for s, cost in self.open:
            total = cost + math.log10(end - s)
            if total < low:
                low, at = total, s
                kept.append((s, cost))
        self.open = kept
        return low, at


def guess_cost(value: str, vocabulary: str | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of guesses, segments (kind, start, end)) of the cheapest segmentation of ``value``.

    A segment's cost is the logarithm of the number of strings its model lists up to it, plus CHOICE.  Words come from
    ``dictionary(vocabulary)``, in any case and with digits or signs for letters; repeats and walks are all runs of
    MIN_RUN or more characters, parts of longer runs included; a span of brute force is paid per character.
    """
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    rank, steps = dictionary(vocabulary), _neighbours()
    begins = {"repeat": _runs(value, lambda j: value[j - 1] == value[j - 2]), "walk": _runs(value, lambda j: low[j - 2:j] in steps)}
    runs = {kind: _Run() for kind in begins}
    # Two states a place: the cheapest way that ends in brute force, and the cheapest that does not.
    brute, other = [math.inf] * (n + 1), [math.inf] * (n + 1)
    brute_from, other_from = [0] * (n + 1), [("", 0)] * (n + 1)
    other[0] = 0.0
    for j in range(1, n + 1):
        for kind, begin in begins.items():
            if j - begin[j] < MIN_RUN:
                if j - begin[j] < 2:
                    runs[kind] = _Run()
                continue
            start = j - MIN_RUN
            c = CHOICE + math.log10(_alphabet(value[start]) if kind == "repeat" else 94 * 2)
            cost, at = runs[kind].best(start, min(brute[start], other[start]), j)
            if cost + c < other[j]:
                other[j], other_from[j] = cost + c, (kind, at)
        i = j - 1
        open_cost = min(brute[i], other[i] + CHOICE)
        brute[j] = open_cost + math.log10(_alphabet(value[i]))
        brute_from[j] = brute_from[i] if i and brute[i] <= other[i] + CHOICE else i
        # Words and dates that start here reach forward: all ways to place i are known by now.
        here = min(brute[i], other[i])
        for k in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            r = rank.get(plain[i:k])
            if r:
                varied = (value[i:k] != low[i:k]) + (plain[i:k] != low[i:k])
                c = here + math.log10(r + 1) + 0.6 * varied + CHOICE
                if c < other[k]:
                    other[k], other_from[k] = c, ("word", i)
        if value[i].isdigit():
            for pattern, cost in DATES:
                m = pattern.match(value, i)
                if m and here + cost + CHOICE < other[m.end()]:
                    other[m.end()], other_from[m.end()] = here + cost + CHOICE, ("date", i)
    segments, j = [], n
    in_brute = brute[n] < other[n]
    while j:
        kind, i = ("brute", brute_from[j]) if in_brute else other_from[j]
        segments.append((kind, i, j))
        # Before brute force stands another model; before that, the cheaper of both.
        in_brute = kind != "brute" and i > 0 and brute[i] < other[i]
        j = i
    return min(brute[n], other[n]), segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping per kind, failing ones dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def guess_spans(text: str, threshold: float, vocabulary: str | None = None) -> list[tuple[int, int, int, float]]:
    out = []
    for m in CONTEXT.finditer(text):
        group = m.lastindex
        value = m[group] if group < 3 else m[3].rstrip(".:")
        if len(value) >= 6:
            cost, _ = guess_cost(value, vocabulary)
            if cost >= threshold:
                out.append((m.start(group), 3, m.start(group) + len(value), cost))
    return out


def scan_text(text: str, threshold: float = GUESS_THRESHOLD, vocabulary: str | None = None) -> tuple:
    base = sorted(base_spans(text))
    extra = guess_spans(text, threshold, vocabulary)
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    digest = hashlib.sha256(show(base).encode()).hexdigest()
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*n, digest, show(sorted(base + [x[:3] for x in extra])), max((x[3] for x in extra), default=None))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                     ("base_sha256", pa.string()), ("spans", pa.string()), ("max_guess_log10", pa.float64())])


def _scan(threshold: float, vocabulary: str | None):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                rows = [scan_text(t or "", threshold, vocabulary) for t in some.column(1).to_pylist()]
                yield pa.record_batch([some.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_SCHEMA)[1:]))],
                                      schema=_SCHEMA)

    return run


def scan_secrets(docs: DataFrame, threshold: float = GUESS_THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string).

    n_assign, n_access and n_hex count the base spans; base_sha256 is the SHA-256 of their kind:start:end
    (code points of the match, end exclusive; by start, then kind), comma-joined; spans has all spans
    likewise, with those of kind ``guess``, values whose guess cost is at least 10^threshold by the words of
    ``vocabulary`` (a tokenizer's file that every executor can open; None: the common password words alone);
    max_guess_log10 is the largest such cost.  Null or empty texts have no spans; values are rated whole
    whatever their length; a null doc_id is carried along; repeated rows give repeated rows; other columns
    are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan(threshold, vocabulary), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_guess_log10 double")


@query("op7_guess_cost")
def op7_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
