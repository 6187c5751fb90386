"""N-gram Jaccard self-join filtered under several global token orders (operator 6).

A document's set is its distinct word shingles.  With t = 80 %, two linked sets of sizes n and m share
at least ceil(t * max(n, m)) elements, so under *any* global order of the elements the first
n - ceil(t n) + 1 of them (the prefix) must share one.  Candidates have to pass that filter under
three orders:

1. ascending hash, applied to documents: of an extended prefix (a quarter longer than the set's
   allowance for missing elements needs), enough elements must occur in another document at all: one
   less than the set's own allowance leaves, as a smaller partner publishes a shorter prefix.
   Element counts come from one exchange of packed hashes.  Most documents end here.
2. rarest first, with exact counts among the documents left, as the equi-join key, with the positional
   bound: a pair whose first common element stands too late in either set cannot link.
3. ascending and descending hash, applied to pairs before the exact intersection is counted.

Documents with equal sets are one class throughout, so copies are never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import bucket_links, connected_components
from .registry import query
from .store import materialise, shuffle_join, shuffle_width, table
from .textbatch import fingerprint, shingle_sets

FLUSH = 4_000_000


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            n, f0, f1 = [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                a, b = fingerprint(s)
                n.append(len(s)), f0.append(a), f1.append(b)
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64())], schema=schema)

    return run


def allowance(n, percent: int):
    """How many of ``n`` elements a linked set may miss: n - ceil(percent n / 100)."""
    return n - (-(-percent * n // 100))


def _pack(k: int, percent: int, shards: int):
    """Rows (block, shard, docs, tokens, owner): the extended prefixes of a block of documents by shard."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("docs", pa.binary()),
                        ("tokens", pa.binary()), ("owner", pa.binary())])

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        sets, docs, held = [], [], 0

        def flush():
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            shard = (tokens % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            tokens, owner = tokens[order], owner[order]
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            meta = np.array(docs, np.int64).tobytes()
            rows = [(s, meta if s == 0 else None, tokens[cut[s]:cut[s + 1]].tobytes(), owner[cut[s]:cut[s + 1]].tobytes())
                    for s in range(shards) if s == 0 or cut[s + 1] > cut[s]]
            return pa.record_batch([pa.array([part] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int32()),
                                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                    pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, s in shingle_sets(batch.column(1), k):
                if ids[i] is None or not len(s):
                    continue
                n = len(s)
                miss = allowance(n, percent)
                m = min(n, 2 * miss + 1)
                sets.append(s[:m])
                docs.append((ids[i], max(1, m - miss - 1)))
                held += m
                if held >= FLUSH:
                    yield flush()
                    sets, docs, held, block = [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def _count_shared(tab: pa.Table) -> pa.Table:
    """Per block of one shard: how many of each document's elements another document has too."""
    tokens = [np.frombuffer(x, np.uint64) for x in tab.column("tokens").to_pylist()]
    flat = np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(s), bool)
    shared[1:] |= same
    shared[:-1] |= same
    back = np.empty(len(s), bool)
    back[order] = shared
    counts, at = [], 0
    for t, o in zip(tokens, tab.column("owner").to_pylist(), strict=True):
        owner = np.frombuffer(o, np.uint32)
        counts.append(np.bincount(owner[back[at:at + len(t)]]).astype(np.int32).tobytes())
        at += len(t)
    return pa.table({"part": tab.column("part"), "block": tab.column("block"), "docs": tab.column("docs"),
                     "counts": pa.array(counts, pa.binary())})


def _sum_shared(tab: pa.Table) -> pa.Table:
    """Documents of one block whose extended prefix holds enough shared elements."""
    docs = np.frombuffer(next(x for x in tab.column("docs").to_pylist() if x is not None), np.int64).reshape(-1, 2)
    total = np.zeros(len(docs), np.int64)
    for c in tab.column("counts").to_pylist():
        x = np.frombuffer(c, np.int32)
        total[:len(x)] += x
    return pa.table({"doc_id": pa.array(docs[total >= docs[:, 1], 0], pa.int64())})


def sharing_documents(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Ids of documents that pass the first order: enough of their extended prefix is shared."""
    shards = shuffle_width(docs.sparkSession)
    packed = docs.select("doc_id", "text").mapInArrow(
        _pack(k, percent, shards), "part int, block int, shard int, docs binary, tokens binary, owner binary")
    counted = packed.groupBy("shard").applyInArrow(_count_shared, "part int, block int, docs binary, counts binary")
    return counted.groupBy("part", "block").applyInArrow(_sum_shared, "doc_id long").distinct()


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            values, ends = [], [0]
            for _, s in shingle_sets(batch.column(1), k):
                values.append(s.view(np.int64))
                ends.append(ends[-1] + len(s))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.record_batch([ids, pa.array(np.diff(ends), pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], schema=schema)

    return run


def verifier(sets: DataFrame, percent: int):
    """Pairs (a, b) -> the pairs whose sets pass the hash-order filters and have the wanted Jaccard."""
    sets = sets.select(F.col("id"), F.col("n"), F.col("tokens"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
        need = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100).cast("int")
        first = lambda t, n: F.slice(F.col(t), F.lit(1), F.col(n).cast("int") - need(n) + 1)
        last = lambda t, n: F.slice(F.col(t), need(n), F.col(n).cast("int") - need(n) + 1)
        common = F.size(F.array_intersect("t_a", "t_b"))
        return (pairs.join(left, "a").join(right, "b")
                .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
                .where(F.arrays_overlap(first("t_a", "n_a"), first("t_b", "n_b")))
                .where(F.arrays_overlap(last("t_a", "n_a"), last("t_b", "n_b")))
                .where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent)
                .select("a", "b"))

    return verify


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, n, pos, u): shared elements in the rarest-first prefix, at their place in the set.

    Elements that no other set has come first in this order and can't join, so only their number ``u``
    is kept.
    """
    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    need = F.ceil(F.lit(percent) * F.col("n") / 100).cast("int")
    shared = (tokens.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
              .withColumn("u", F.col("n").cast("int") - F.size("order")).where(F.size("order") >= need))
    prefix = F.slice(F.col("order"), F.lit(1), F.greatest(F.lit(0), F.col("n").cast("int") - need + 1 - F.col("u")))
    return (shared.select("id", "n", "u", F.posexplode(prefix).alias("at", "e"))
            .select(F.col("e.token").alias("bucket"), "id", "n", "u", (F.col("u") + F.col("at") + 1).alias("pos")))


def positional(percent: int):
    """The first common element of a linked pair leaves room for enough further ones."""
    most = F.lit(1) + F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
    return (most * 100 >= (F.col("l.n") + F.col("r.n") - most) * percent) & (
        F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent)


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id long, text string).

    Two documents link when 100 * |A ∩ B| >= percent * |A ∪ B| over their sets of distinct ``k``-word
    shingles (A-Z folded, words split at ASCII white space; with fewer words the sequence itself).
    ``component_id`` is the smallest doc_id reachable.  Null or empty texts have size 0 and their own
    id; a null doc_id keeps its size and gets a null component.  Repeated rows give repeated rows; a
    repeated doc_id with several texts is one node that has all their links.  Other columns are ignored;
    an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_signatures(k), "doc_id long, n long, f0 long, f1 long"))
    # Of each set one document is compared (with one of its ids even if it has several).
    classes = materialise(signed.where("n > 0 and doc_id is not null").groupBy("f0", "f1").agg(F.min("doc_id").alias("rep")))
    members = signed.where("n > 0 and doc_id is not null").select("doc_id", "f0", "f1").join(classes, ["f0", "f1"])
    sharing = sharing_documents(docs, k, percent)
    chosen = materialise(sharing.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sets = materialise(docs.join(shuffle_join(chosen), "doc_id", "left_semi").mapInArrow(_sets(k), "id long, n long, tokens array<long>")
                       .where("n > 0"))
    links = bucket_links(prefix_entries(sets, percent), verifier(sets, percent),
                         rank=(F.col("u") * 1000 / F.col("n")).cast("int"), admit=positional(percent))
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = connected_components(links.union(same))
    return (signed.select("doc_id", F.col("n").alias("n_shingles"))
            .join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


@query("op6_multi_order_join")
def op6_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
