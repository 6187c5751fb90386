"""Harmonic packing of token sequences (operator 2).

A piece of length in (C/(k+1), C/k] belongs to class k, and every bin of class k takes exactly k
pieces, so bins are filled by counting, independently on every worker.  Three steps keep the padding
small:

* a document gives full sequences of C tokens, and its rest is cut at reciprocal sizes: a rest of
  class k < ``fine_class`` gives one piece of exactly floor(C/(k+1)) tokens and a rest that is smaller
  than C/(k(k+1)).  The classes grow like k, k(k+1), ..., so a rest has at most five pieces, and only
  pieces of ``fine_class`` or more, which fit with less than C/fine_class lost, are not exact;
* pieces are numbered within their class over all workers (per-worker counts, then offsets), so a class
  has one unfinished bin, not one per worker;
* the pieces of unfinished bins, fewer than k of each class k whatever the input, are packed together
  by first fit, largest first.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .store import materialise, table

CAPACITY = 4096
END_ID = 2
#: Rests of this class and above are not cut further.
FINE_CLASS = 24
#: Entries of the per-worker word cache (about 300 bytes each); it is emptied when full.
CACHE_WORDS = 800_000
_PIECE_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, nth long, ids binary"


@lru_cache(maxsize=2)
def word_cache(path: str, words: int, keep_older: bool) -> WordCache:
    """One cache a worker process, kept for its later tasks."""
    return WordCache(path, words, keep_older)


class WordCache:
    """Ids of texts, tokenised word by word.

    The vocabulary's normaliser and splitter never join or look across a space or a line break, nor
    across the boundary of letters and one trailing '.' or ',', so the ids of a text are those of such
    parts in order.  Each distinct part is tokenised once per worker while the cache holds it.  A full cache is
    emptied, or with ``keep_older`` kept as the older one, from which words that come again are taken over.  New words of
    letters alone are tokenised many at a time, joined by spaces: each is one pre-token, and its last id is
    the only one that ends a word.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS, keep_older: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.older = Tokenizer.from_file(path), {}, {}
        self.words, self.keep_older = words, keep_older
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [fold(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.ids) > self.words:
            self.ids, self.older = {}, self.ids if self.keep_older else {}
        known, older = self.ids, self.older
        new = {w for p in parts for w in p}.difference(known)
        if older:
            known.update({w: older[w] for w in new if w in older})
            new.difference_update(known)
        new = list(new)
        if new:
            known[""] = b""
            cut = [self._trim(w) for w in new]
            self._learn([s for s in {*(s for s, _ in cut), ".", ","} if s not in known])
            for w, (s, tail) in zip(new, cut, strict=True):
                if tail:
                    known[w] = known[s] + known[tail]
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), "<u4") for p in parts]

    def _learn(self, stems: list[str]) -> None:
        known, single = self.ids, [s for s in stems if not s.isalpha()]
        letters = [s for s in stems if s.isalpha()]
        for at in range(0, len(letters), 4096):
            some = letters[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                single += some
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * ends).tolist(), strict=True):
                known[w] = raw[start:end]
                start = end
        for at in range(0, len(single), 4096):
            some = single[at:at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    @staticmethod
    def _trim(word: str) -> tuple[str, str]:
        if len(word) > 1 and word[-1] in ".," and word[-2].isascii() and word[-2].isalpha():
            return word[:-1], word[-1]
        return word, ""


def fold(text: str) -> str:
    """``text`` in lower case where that changes no id: in Latin-1 no letter composes or changes with its place, and
    without "<|" no special token can come about."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def reciprocal_cuts(length: int, capacity: int = CAPACITY, fine_class: int = FINE_CLASS) -> list[int]:
    """Piece lengths of a document: full bins, then reciprocal sizes, then one fine rest."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        size = capacity // (k + 1)
        if k >= fine_class or rest == capacity // k or size == 0:
            out.append(rest)
            break
        out.append(size)
        rest -= size
    return out


def _pieces(path: str, capacity: int, fine_class: int, end_id: int, with_ids: bool, words: int, keep_older: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("part", pa.int32()), ("class", pa.int32()), ("nth", pa.int64()),
                        ("ids", pa.binary())])
    end = np.array([end_id], "<u4")

    def run(batches):
        part, cache, seen = TaskContext.get().partitionId(), word_cache(path, words, keep_older), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = []
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), cache.encode(texts), strict=True):
                    ids = np.concatenate((ids, end))
                    raw, start = ids.tobytes(), 0
                    for n in reciprocal_cuts(len(ids), capacity, fine_class):
                        k = capacity // n
                        nth = seen.get(k, 0)
                        seen[k] = nth + 1
                        own = raw[4 * start:4 * (start + n)]
                        rows.append((doc, start, n, zlib.crc32(own), len(ids), part, k, nth, own if with_ids else None))
                        start += n
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, fine_class: int = FINE_CLASS,
                   end_id: int = END_ID, with_ids: bool = False, cache_words: int = CACHE_WORDS, keep_older: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class[, ids].

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone.  Every row of
    ``docs`` is packed, also with a null or repeated doc_id; other columns are ignored; an empty table
    gives an empty result.  ``sequence_id`` is a long, unique over the result but not gapless;
    ``offset`` is gapless from 0 within a sequence.  Class k holds k pieces a sequence; the shared
    sequences of unfinished bins have class 100000.  ``cache_words`` and ``keep_older`` set what a worker's
    word cache holds, for time against memory.
    """
    spark = docs.sparkSession
    pieces = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _pieces(tokenizer_path, capacity, fine_class, end_id, with_ids, cache_words, keep_older), _PIECE_FIELDS))
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    offsets = materialise(counts.select("class", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
                                        F.sum("n").over(whole).alias("total")))
    ranked = (pieces.join(offsets, ["class", "part"])
              .withColumn("rank", F.col("before") + F.col("nth"))
              .withColumn("bin", F.expr("rank div class").cast("long"))
              .withColumn("done", F.col("bin") < F.expr("total div class")))
    # Bins of all classes share one id space, those of smaller classes first (at most one row per class).
    bins = offsets.groupBy("class").agg(F.expr("first(total) div class").alias("bins")).union(
        spark.range(1).selectExpr("cast(100000 as int)", "0L"))
    first = bins.select("class", F.coalesce(F.sum("bins").over(
        Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] if with_ids else []
    within = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    done = ranked.where("done").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    rest = _first_fit(ranked.where("not done"), capacity, 100000)
    cols = [*keep, "class", "bin", "offset", *ids]
    return (done.select(*cols).union(rest.select(*cols)).join(F.broadcast(first), "class")
            .select(*keep, (F.col("first") + F.col("bin")).alias("sequence_id"), "offset", "class", *ids))


def _first_fit(rest: DataFrame, capacity: int, label: int) -> DataFrame:
    """Bins of the pieces that no bin of their class could be completed with.

    There are fewer than k pieces of each class k <= capacity, so this one group has a bounded number of
    rows whatever the input.
    """
    kept = ["rank", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def fit(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([("length", "descending"), ("class", "ascending"), ("rank", "ascending")])
        room, slot, offset = np.zeros(0, np.int64), [], []
        for n in tab.column("length").to_pylist():
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                room = np.append(room, capacity)
                fits = [len(room) - 1]
            slot.append(int(fits[0]))
            offset.append(int(capacity - room[fits[0]]))
            room[fits[0]] -= n
        out = tab.select(kept)
        out = out.append_column("class", pa.array([label] * len(tab), pa.int32()))
        return out.append_column("bin", pa.array(slot, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return rest.select("class", *kept, F.lit(0).alias("g")).groupBy("g").applyInArrow(
        fit, "rank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, class int, bin long, offset long")


@query("op2_harmonic_packing")
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
