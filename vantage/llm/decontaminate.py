"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance (operator 9).

An item of n words may be found with e = floor(n * error_percent / 100) word edits.  It is cut into
e + 1 pieces; an occurrence with at most e edits leaves one piece untouched, so an exact piece hit
starts every candidate.  Myers' bit-parallel algorithm then finds the smallest edit distance of the item
to any substring of the words around the hit.  Documents are only scanned: no row is shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import table
from .textbatch import ALNUM_WORDS, grams, mix, text_blocks, words

ERROR_PERCENT = 20
#: Items with fewer words are not searched; those of one to four words allow no edit and are searched exactly.
MIN_WORDS = 1
#: Words of the items that one scan of the documents searches for; it bounds what is broadcast.
BLOCK_WORDS = 400_000
ANCHOR = 4
_FILTER_BITS = 20
FIELDS = ("doc_id long, item_id long, distance long, item_words long, start_word long, end_word long, "
          "start_char long, end_char long")


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text: letters and digits, folded to lower case."""
    out: list[np.ndarray] = []
    for lo, hi, data, off in text_blocks(pc.utf8_lower(pa.array(texts, pa.large_string()))):
        h, _, _, row = words(data, off, ALNUM_WORDS)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        out += [h[cut[i]:cut[i + 1]] for i in range(hi - lo)]
    return out


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """(offset, length) of errors + 1 nearly equal pieces of n words."""
    cut = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(smallest edit distance of ``pattern`` to a substring of ``text``, end of the first such substring)."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The items of one block, indexed by the first words of their pieces."""

    def __init__(self, items: list[tuple[int, np.ndarray]], error_percent: int):
        self.items = items
        anchors: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.errors = [len(w) * error_percent // 100 for _, w in items]
        for i, (_, w) in enumerate(items):
            for at, n in pieces(len(w), self.errors[i]):
                q = min(n, ANCHOR)
                anchors[q][int(_gram(w[at:at + q], q)[0])].append((i, at, n))
        self.anchors = {q: dict(d) for q, d in anchors.items()}
        self.filters = {}
        for q, d in self.anchors.items():
            f = np.zeros(1 << _FILTER_BITS, bool)
            f[np.fromiter(d, np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[q] = f

    def hits(self, h: np.ndarray, row: np.ndarray):
        """(row, item, word) of every exact piece hit; ``word`` is where the item would start."""
        for q, d in self.anchors.items():
            g = _gram(h, q)
            for p in np.flatnonzero(self.filters[q][g >> np.uint64(64 - _FILTER_BITS)]).tolist():
                for i, at, n in d.get(int(g[p]), ()):
                    if p + n <= len(h) and row[p] == row[p + n - 1] and (n <= q or np.array_equal(h[p:p + n], self.items[i][1][at:at + n])):
                        yield int(row[p]), i, p - at

    def matches(self, h: np.ndarray, row: np.ndarray, first: np.ndarray):
        """(row, item, distance, start word, end word): the best occurrence of each item in each row."""
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for r, i, start in self.hits(h, row):
            near[r, i].add(start)
        for (r, i), starts in near.items():
            w, e = self.items[i][1], self.errors[i]
            pattern, best = w.tolist(), None
            lo_row, hi_row = int(first[r]), int(first[r + 1])
            done = -1
            for s in sorted(starts):
                lo, hi = max(lo_row, s - e), min(hi_row, s + len(w) + e)
                if hi <= done:
                    continue
                done = hi
                text = h[lo:hi].tolist()
                d, end = myers(pattern, text)
                if d <= e and (best is None or d < best[0]):
                    back, begin = myers(pattern[::-1], text[:end][::-1])
                    best = (d, lo + end - begin - lo_row, lo + end - lo_row)
            if best:
                yield r, i, *best


def _gram(h: np.ndarray, q: int) -> np.ndarray:
    return grams(h, q) if q > 1 else mix(h)


def _scan(matcher):
    schema = pa.schema([(f.split(" ")[0], pa.int64()) for f in FIELDS.split(", ")])

    def run(batches):
        m = matcher.value
        for batch in batches:
            ids = batch.column(0)
            text = pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
            for lo, hi, data, off in text_blocks(text):
                h, starts, ends, row = words(data, off, ALNUM_WORDS)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                out = []
                for r, i, d, a, b in m.matches(h, row, first):
                    at = int(off[r])
                    chars = [int(np.count_nonzero((data[at:x] & 0xC0) != 0x80))
                             for x in (starts[first[r] + a], ends[first[r] + b - 1])] if b > a else [0, 0]
                    out.append((ids[lo + r].as_py(), m.items[i][0], d, len(m.items[i][1]), a, b, *chars))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def item_blocks(items: DataFrame, block_words: int, min_words: int):
    """Lists of (item_id, word hashes) of bounded total size, in item order."""
    block, held, raw = [], 0, []

    def take():
        nonlocal block, held
        for (i, _), w in zip(raw, item_words([t for _, t in raw]), strict=True):
            if len(w) >= min_words:
                block.append((i, w))
                held += len(w)
        raw.clear()

    for r in items.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        raw.append((r[0], r[1]))
        if len(raw) >= 256:
            take()
        if held >= block_words:
            yield block
            block, held = [], 0
    take()
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, error_percent: int = ERROR_PERCENT, min_words: int = MIN_WORDS,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, distance, item_words, start_word, end_word, start_char, end_char).

    One row per document row and item that occurs in it with at most floor(n * error_percent / 100) word
    edits of its n words: the occurrence with the smallest distance, the first of equals.  Words are runs
    of letters and digits in lower case; ends are exclusive; characters are code points of the
    lower-cased text.  Null or empty texts match nothing; items without ``min_words`` words or without an
    id are not searched; a null doc_id is carried along; repeated documents give repeated rows, and a
    repeated item_id one row per text.  Items are searched in blocks of about ``block_words`` words, a scan
    of the documents for each, so what a task holds is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], FIELDS)
    for block in item_blocks(items, block_words, min_words):
        out = out.union(docs.mapInArrow(_scan(spark.sparkContext.broadcast(Matcher(block, error_percent))), FIELDS))
    return out


def without_items(docs: DataFrame, items: DataFrame, error_percent: int = ERROR_PERCENT, min_words: int = MIN_WORDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` (all columns) in whose text no item occurs; null texts stay."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")

    def keep(matcher):
        def run(batches):
            for batch in batches:
                text = pc.utf8_lower(pc.fill_null(batch.column(at).cast(pa.large_string()), ""))
                clean = np.ones(batch.num_rows, bool)
                for lo, hi, data, off in text_blocks(text):
                    h, _, _, row = words(data, off, ALNUM_WORDS)
                    for r, *_ in matcher.value.matches(h, row, np.searchsorted(row, np.arange(hi - lo + 1))):
                        clean[lo + r] = False
                yield batch.filter(pa.array(clean))

        return run

    out = docs
    for block in item_blocks(items, block_words, min_words):
        out = out.mapInArrow(keep(sc.broadcast(Matcher(block, error_percent))), docs.schema)
    return out


@query("op9_pigeonhole_myers")
def op9_pigeonhole_myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
