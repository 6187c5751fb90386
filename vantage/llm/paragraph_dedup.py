"""Paragraph MinHash: repeated passages across documents (operator 1).

A paragraph is a piece of text between line breaks and sentence ends, with at least ``min_words`` words:
such pieces keep their borders wherever a passage is pasted, which whole lines don't.  MinHash bands,
tuned for recall at the wanted Jaccard, decide which paragraphs collide at all; those are joined band by
band, verified with the exact Jaccard of their word shingles, and clustered into components.  A stretch
of paragraphs of a document that other documents repeat is reported once it is long enough, and every
paragraph in it but its component's first occurrence is to be removed.  Short sentences and parts of
sentences count too: each paragraph is extended word by word, to both sides, as far as the words around
it are those around its component's first occurrence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import sharing_owners
from .graph import bucket_links, connected_components
from .registry import query
from .store import materialise, shuffle_join, table
from .textbatch import SPACE_WORDS, grams, mix, text_blocks, words

SHINGLE, PERCENT = 5, 80
RECALL, BAND_ROWS = 0.998, 2
MIN_WORDS = 8
#: Words of a stretch of repeated paragraphs from which it is a repeated passage.
MIN_RUN_WORDS = 30
SEED = 1009
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def tune_bands(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` hashes that collide with probability ``recall`` at ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def paragraphs(data: np.ndarray, off: np.ndarray, min_words: int):
    """(row, number in its row, first word, end word) arrays of a block's paragraphs, word hashes, starts, ends."""
    h, starts, ends, row = words(data, off, SPACE_WORDS)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, none, h, starts, ends
    line = np.cumsum(data == 10)
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (row[1:] != row[:-1]) | _ENDS[data[ends[:-1] - 1]] | (line[starts[1:]] != line[ends[:-1] - 1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h))
    long = last - first >= min_words
    first, last = first[long], last[long]
    own = row[first]
    number = np.arange(len(first)) - np.searchsorted(own, own)
    return own, number, first, last, h, starts, ends


def minhash_keys(shingles: np.ndarray, first: np.ndarray, end: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (paragraphs, bands) of the shingles first..end of every paragraph."""
    size = end - first
    index = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    flat, at = shingles[index], np.concatenate(([0], np.cumsum(size)[:-1]))
    factor = np.random.default_rng(SEED).integers(1, 1 << 62, (bands, rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            low = np.minimum.reduceat((flat * factor[b, r, 0] + factor[b, r, 1]) ^ (flat >> np.uint64(29)), at)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = key
    return out


def _owners(k: int, min_words: int, bands: int, rows: int):
    def produce(batch):
        ids = batch.column(0).to_pylist()
        for lo, _, data, off in text_blocks(batch.column(1)):
            row, number, first, last, h, _, _ = paragraphs(data, off, min_words)
            if len(row):
                keys = minhash_keys(grams(h, k), first, last - k + 1, bands, rows)
                for i, r in enumerate(row.tolist()):
                    if ids[lo + r] is not None:
                        yield (ids[lo + r], int(number[i])), 1, np.unique(keys[i])

    return produce


_FOUND = ("doc_id long, paragraph long, n_words long, start_char long, end_char long, e0 long, e1 long, n long, first_word long, "
          "bands array<long>, tokens array<long>, before binary, after binary")
#: Bytes of a word's hash in ``before`` and ``after``.
_WORD = 3


def _found(k: int, min_words: int, bands: int, rows: int, beside: int):
    types = [pa.int64()] * 9 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
    schema = pa.schema(list(zip([f.split(" ")[0] for f in _FOUND.split(", ")], types, strict=True)))

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, _, data, off in text_blocks(batch.column(1)):
                row, number, first, last, h, starts, ends = paragraphs(data, off, min_words)
                if not len(row):
                    continue
                words_row = np.searchsorted(off, starts, "right") - 1
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                g = grams(h, k)
                keys = minhash_keys(g, first, last - k + 1, bands, rows)
                out = []
                short = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :_WORD])
                at = np.searchsorted(words_row, np.arange(len(off)))
                sets = [set(w) for w in wanted[lo:lo + len(off) - 1]]
                for i, r in enumerate(row.tolist()):
                    if int(number[i]) in sets[r]:
                        a, b = int(first[i]), int(last[i])
                        e = np.frombuffer(xxhash.xxh3_128_digest(h[a:b].tobytes()), "<i8")
                        tokens = np.unique(g[a:b - k + 1]).view(np.int64)
                        begin = int(chars[off[r]])
                        out.append((ids[lo + r], int(number[i]), b - a, int(chars[starts[a]]) - begin, int(chars[ends[b - 1]]) - begin,
                                    int(e[0]), int(e[1]), len(tokens), a - int(at[r]), np.unique(keys[i]).view(np.int64).tolist(), tokens.tolist(),
                                    short[max(int(at[r]), a - beside):a][::-1].tobytes(), short[b:min(int(at[r + 1]), b + beside)].tobytes()))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    return run


def _elements(percent: int):
    def produce(batch):
        doc, number, n = (batch.column(i).to_pylist() for i in range(3))
        tokens = batch.column(3)
        flat, ends = tokens.flatten().to_numpy().view(np.uint64), np.cumsum([0, *n])
        for i in range(len(doc)):
            yield (doc[i], number[i]), -(-percent * n[i] // 100), flat[ends[i]:ends[i + 1]]

    return produce


def _verify(sets: DataFrame, percent: int):
    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
        common = F.size(F.array_intersect("t_a", "t_b"))
        return (pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
                .where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b"))

    return verify


def _common(a: bytes, b: bytes) -> int:
    """How many first words of two sides are equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return (((x & -x).bit_length() - 1) // 8 if x else n) // _WORD


def _reach(batches):
    """(doc_id, paragraph, component, left, right): words around a paragraph that its component's first occurrence has too."""
    for batch in batches:
        before, after, b0, a0 = (batch.column(i).to_pylist() for i in range(3, 7))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2),
                               pa.array([_common(x, y) for x, y in zip(before, b0, strict=True)], pa.int64()),
                               pa.array([_common(x, y) for x, y in zip(after, a0, strict=True)], pa.int64())],
                              names=["doc_id", "paragraph", "component", "left", "right"])


def _reaches(repeated: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, paragraph, left, right) per repeated paragraph; a first occurrence reaches as far as any other document's does."""
    sides = found.select("doc_id", "paragraph", "before", "after").dropDuplicates(["doc_id", "paragraph"])
    keys = repeated.select("doc_id", "paragraph", "component")
    is_head = F.struct("doc_id", "paragraph") == F.col("component")
    heads = keys.where(is_head).join(sides, ["doc_id", "paragraph"]).select("component", F.col("before").alias("b0"), F.col("after").alias("a0"))
    others = (keys.where(~is_head).join(sides, ["doc_id", "paragraph"]).join(heads, "component")
              .select("doc_id", "paragraph", "component", "before", "after", "b0", "a0"))
    reach = materialise(others.mapInArrow(_reach, "doc_id long, paragraph long, component struct<doc_id: long, paragraph: long>, left long, right long"))
    first = (reach.where("doc_id <> component.doc_id").groupBy("component").agg(F.max("left").alias("left"), F.max("right").alias("right"))
             .select("component.doc_id", "component.paragraph", "left", "right"))
    return reach.select("doc_id", "paragraph", "left", "right").union(first)


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, min_run_words: int = MIN_RUN_WORDS, k: int = SHINGLE,
                        percent: int = PERCENT, recall: float = RECALL, rows: int = BAND_ROWS) -> DataFrame:
    """One row per paragraph that belongs to a repeated passage:

    doc_id, paragraph (its number among the document's paragraphs), n_words, run_words (repeated words of
    its stretch, with those beside its paragraphs, of which as many are looked at as decide whether it is long enough),
    start_char, end_char, component_doc and component_paragraph (the component's first occurrence, by
    doc_id and number), documents_from and documents_to (smallest and largest doc_id of the component) and
    removed.  Paragraphs that fewer than two documents have, and stretches under ``min_run_words`` words,
    are not reported.  Null or empty texts and null doc_ids have no paragraphs; rows that repeat a doc_id
    count as one document; copies of a document repeat all its paragraphs; an empty table gives an empty
    result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = tune_bands(percent / 100, recall, rows)
    sharing = sharing_owners(docs, _owners(k, min_words, bands, rows), ["doc_id", "paragraph"])
    wanted = materialise(sharing.groupBy("doc_id").agg(F.collect_set("paragraph").alias("wanted")))
    found = materialise(docs.join(shuffle_join(wanted), "doc_id").select("doc_id", "text", "wanted")
                        .mapInArrow(_found(k, min_words, bands, rows, max(0, min_run_words - min_words)), _FOUND))
    one = F.struct("doc_id", "paragraph")
    classes = materialise(found.groupBy("e0", "e1").agg(
        F.min(one).alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("tokens").alias("tokens")))
    # Only elements that another class has too can be common: they bound a class's links, and a pair's Jaccard.
    known = sharing_owners(classes.select("id.doc_id", "id.paragraph", "n", "tokens"), _elements(percent), ["doc_id", "paragraph"])
    linkable = materialise(classes.join(known.select(F.struct("doc_id", "paragraph").alias("id"), "shared"), "id")
                           .select("id", "n", "shared", "bands", "tokens"))
    entries = linkable.select(F.explode("bands").alias("bucket"), "id", "n", "shared")
    most = F.least("l.shared", "r.shared")
    links = bucket_links(entries, _verify(linkable, percent), rank=-(F.col("shared") * 1000 / F.col("n")).cast("int"),
                         admit=most * 100 >= (F.col("l.n") + F.col("r.n") - most) * percent)
    comp = connected_components(links)
    placed = materialise(found.select("doc_id", "paragraph", "n_words", "start_char", "end_char", "first_word", "e0", "e1")
                         .join(classes.select("e0", "e1", "id"), ["e0", "e1"]).join(comp, "id", "left")
                         .withColumn("component", F.coalesce("component", "id")).drop("id", "e0", "e1").dropDuplicates(["doc_id", "paragraph"]))
    spread = (placed.groupBy("component").agg(F.min("doc_id").alias("documents_from"), F.max("doc_id").alias("documents_to"))
              .where("documents_from < documents_to"))
    repeated = materialise(placed.join(spread, "component"))
    reached = (repeated.join(_reaches(repeated, found), ["doc_id", "paragraph"], "left")
               .withColumn("lo", F.col("first_word") - F.coalesce("left", F.lit(0)))
               .withColumn("hi", F.col("first_word") + F.col("n_words") + F.coalesce("right", F.lit(0))))
    # A stretch goes on with the next paragraph, or where the words reached meet; each of its words counts once.
    order = Window.partitionBy("doc_id").orderBy("paragraph")
    run = Window.partitionBy("doc_id", "run")
    far = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    new = (F.col("paragraph") > F.lag("paragraph").over(order) + 1) & (F.col("lo") > F.col("far"))
    own = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "far"))
    return (reached.withColumn("far", far).withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(order))
            .withColumn("run_words", F.sum(own).over(run) + F.min_by("lo", "paragraph").over(run) - F.min("lo").over(run))
            .where(F.col("run_words") >= min_run_words)
            .select("doc_id", "paragraph", "n_words", "run_words", "start_char", "end_char", F.col("component.doc_id").alias("component_doc"),
                    F.col("component.paragraph").alias("component_paragraph"), "documents_from", "documents_to",
                    ((F.col("component.doc_id") != F.col("doc_id")) | (F.col("component.paragraph") != F.col("paragraph"))).alias("removed")))


@query("op1_paragraph_minhash")
def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents", "doc_id", "text"))
