"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables (operator 8).

``LineStore`` keeps two tables.  ``postings`` (k0, k1, doc_id, refs) is exact: how often a document holds
a line key, 128 bits of it; it is a few written tables of signed changes, added up when read.  ``filters``
(shard, keys, slots) has one cuckoo filter per shard of the keys that enough documents hold.  Inserting
documents adds references; deleting them takes references away and removes keys that fell below the
threshold from their filter, so every deletion undoes its insertion.  Either one groups the postings of the
keys it moves alone, and rewrites the shards whose frequent keys change.  Documents are checked against the
filters where their keys are read, before any shuffle; only keys that a filter admits are looked up in the
exact table, which decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query
from .store import free_name, materialise, shuffle_join, table

#: White space that is stripped from both ends of a line to make its key.
STRIP = " \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 500
#: Frequent keys of one shard; with twice as many a shard the store is dealt over more shards.
KEYS_A_SHARD = 4_096
#: Bytes of all filters up to which they are broadcast to the scan; larger ones meet the distinct keys by shard.
BROADCAST_BYTES = 64 << 20
#: Tables of changes that are added up on reading; more are merged into one.
MAX_CHANGES = 8


def line_key(line: str, min_chars: int) -> bytes | None:
    """128 bits of the stripped line with A-Z folded; None where it is shorter than ``min_chars``."""
    s = line.strip(STRIP)
    return xxhash.xxh3_128_digest(s.encode().lower()) if len(s) >= min_chars else None


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four slots a bucket, insert, delete, vector probe."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots.reshape(buckets, SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8)))))

    def places(self, k0: np.ndarray, k1: np.ndarray):
        return self.places_in(np.uint64(self.buckets - 1), k0, k1)

    @staticmethod
    def places_in(mask, k0: np.ndarray, k1: np.ndarray):
        """(fingerprint, first bucket, second bucket) of keys in filters of ``mask`` + 1 buckets."""
        f = (k1.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        f[f == 0] = 1
        first = (k0.view(np.uint64) >> np.uint64(20)) & mask
        return f, first, first ^ (f.astype(np.uint64) * np.uint64(0x5BD1E995) & mask)

    def contains(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        f, a, b = self.places(k0, k1)
        return (self.slots[a] == f[:, None]).any(1) | (self.slots[b] == f[:, None]).any(1)

    def insert(self, k0: int, k1: int) -> bool:
        f, a, b = (x[0] for x in self.places(np.array([k0], np.int64), np.array([k1], np.int64)))
        at, step = int(a), 0
        for bucket in (int(a), int(b)):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = f
                return True
        while step < MAX_KICKS:
            slot = step % SLOTS
            f, self.slots[at, slot] = self.slots[at, slot], f
            at = at ^ (int(f) * 0x5BD1E995 & (self.buckets - 1))
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = f
                return True
            step += 1
        return False

    def delete(self, k0: int, k1: int) -> bool:
        f, a, b = (x[0] for x in self.places(np.array([k0], np.int64), np.array([k1], np.int64)))
        for bucket in (int(a), int(b)):
            hit = np.flatnonzero(self.slots[bucket] == f)
            if len(hit):
                self.slots[bucket, hit[0]] = 0
                return True
        return False


def update_filter(old: CuckooFilter | None, k0: list, k1: list, change: list) -> CuckooFilter:
    """Apply a shard's changes (+1 joins, -1 leaves, 0 stays); a full filter is rebuilt at twice the size."""
    alive = [(a, b) for a, b, c in zip(k0, k1, change, strict=True) if c >= 0]
    out = old
    if out is not None:
        for a, b, c in zip(k0, k1, change, strict=True):
            if c < 0:
                out.delete(a, b)
        if all(out.insert(a, b) for a, b, c in zip(k0, k1, change, strict=True) if c > 0):
            return out
    size = CuckooFilter.sized(len(alive)).buckets
    while True:
        out = CuckooFilter(size)
        if all(out.insert(a, b) for a, b in alive):
            return out
        size *= 2


def _keys(min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids, keys = [], []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if doc is not None and text:
                        own = {line_key(x, min_chars) for x in text.split("\n") if len(x) >= min_chars} - {None}
                        ids += [doc] * len(own)
                        keys += own
                k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], schema=schema)

    return run


class FilterSet:
    """The filters of all shards side by side, for vector probes; shards without a filter hold no key."""

    def __init__(self, shards: int, filters: list[tuple[int, bytes]]):
        sizes = [len(slots) // (2 * SLOTS) for _, slots in filters]
        self.slots = np.concatenate([np.zeros((1, SLOTS), np.uint16), *(np.frombuffer(x, np.uint16).reshape(-1, SLOTS) for _, x in filters)])
        self.first, self.mask = np.zeros(shards, np.uint64), np.zeros(shards, np.uint64)
        at = np.array([s for s, _ in filters], int)
        self.first[at] = np.cumsum([1, *sizes])[:-1]
        self.mask[at] = np.array(sizes, np.uint64) - np.uint64(1)

    def contains(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        shard = k0 % len(self.first)
        f, a, b = CuckooFilter.places_in(self.mask[shard], k0, k1)
        first, f = self.first[shard], f[:, None]
        return (self.slots[first + a] == f).any(1) | (self.slots[first + b] == f).any(1)


def _admit(held):
    def run(batches):
        for batch in batches:
            k0, k1 = (np.ascontiguousarray(batch.column(c).to_numpy()) for c in ("k0", "k1"))
            if len(k0):
                yield batch.filter(pa.array(held.value.contains(k0, k1)))

    return run


class LineStore:
    """Line counts of a growing and shrinking set of documents.

    ``shards`` fixes the number of filters; None derives it from the number of frequent keys.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, shards: int | None = None,
                 broadcast_bytes: int = BROADCAST_BYTES):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.fixed, self.shards, self.broadcast_bytes = shards is not None, shards or 1, broadcast_bytes
        self.changes: list[DataFrame] = []
        self.filters = spark.createDataFrame([], "shard int, keys long, slots binary")
        self.frequent = spark.createDataFrame([], "k0 long, k1 long, docs long, last long")
        self.rewritten = 0

    @property
    def postings(self) -> DataFrame:
        if not self.changes:
            return self.spark.createDataFrame([], "k0 long, k1 long, doc_id long, refs long")
        if len(self.changes) == 1:
            return self.changes[0].where("refs > 0")
        return self._added_up().groupBy("k0", "k1", "doc_id").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def _added_up(self) -> DataFrame:
        out = self.changes[0]
        for more in self.changes[1:]:
            out = out.union(more)
        return out

    def keys(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _keys(self.min_chars), "doc_id long, k0 long, k1 long")

    def insert(self, docs: DataFrame, keys: DataFrame | None = None) -> LineStore:
        return self._merge(self.keys(docs) if keys is None else keys, 1)

    def delete(self, docs: DataFrame) -> LineStore:
        """Takes the documents' references away; those that the store does not hold change nothing."""
        return self._merge(self.keys(docs), -1)

    def _merge(self, keys: DataFrame, sign: int) -> LineStore:
        key = ["k0", "k1"]
        moved = keys.select(*key, "doc_id", F.lit(sign).cast("long").alias("refs"))
        first = not self.changes
        touched = None
        if not first:
            moved = materialise(moved.groupBy(*key, "doc_id").agg(F.sum("refs").alias("refs")))
            touched = materialise(moved.select(*key).distinct())
            moved = moved.withColumn("moved", F.col("refs")).union(
                self._added_up().join(touched, key, "left_semi").select(*key, "doc_id", "refs", F.lit(0).cast("long")))
        else:
            moved = moved.withColumn("moved", F.col("refs"))
        # Grouping by key and document first spreads a line that a third of all documents hold.
        state = materialise(moved.groupBy(*key, "doc_id").agg(F.sum("refs").alias("refs"), F.sum("moved").alias("moved"))
                            .select(*key, "doc_id", F.greatest("refs", F.lit(0)).alias("refs"),
                                    (F.col("moved") + F.greatest(-F.col("refs"), F.lit(0))).alias("change")))
        self.changes.append(state.where("change <> 0").select(*key, "doc_id", F.col("change").alias("refs")))
        if len(self.changes) > MAX_CHANGES:
            self.changes = [materialise(self.postings)]
        now = materialise(state.where("refs > 0").groupBy(*key).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
                          .where(F.col("docs") >= self.min_docs))
        was = self.frequent
        if first:
            self.frequent, change = now, now.select(*key, F.lit(1).alias("change"))
        else:
            self.frequent = materialise(was.join(touched, key, "left_anti").union(now))
            change = (now.select(*key, F.lit(1).alias("now"))
                      .join(was.join(touched, key, "left_semi").select(*key, F.lit(1).alias("was")), key, "full")
                      .select(*key, (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("change")).where("change <> 0"))
        wanted = 1 << max(0, int(np.ceil(np.log2(max(1, self.frequent.count()) / KEYS_A_SHARD))))
        if not self.fixed and wanted > (1 if first else 2) * self.shards:
            self.shards, self.filters = wanted, self.filters.where("false")
            change = self.frequent.select(*key, F.lit(1).alias("change"))
        self._refilter(change.withColumn("shard", self._shard()))
        return self

    def _refilter(self, change: DataFrame) -> None:
        """Rewrites the filters of the shards in ``change`` (k0, k1, change, shard); others stay as they are."""
        change = materialise(change)
        shards = F.broadcast(change.select("shard").distinct())  # one row a shard at most
        rest = (self.frequent.select("k0", "k1", F.lit(0).alias("change"), self._shard().alias("shard")).join(shards, "shard", "left_semi")
                .join(change.where("change > 0"), ["k0", "k1"], "left_anti"))
        rows = change.select("shard", "k0", "k1", "change").union(rest.select("shard", "k0", "k1", "change"))
        fresh = materialise(self.filters.join(shards, "shard", "left_semi").groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(
            _update_shard, "shard int, keys long, slots binary"))
        self.rewritten = fresh.count()
        self.filters = materialise(self.filters.join(shards, "shard", "left_anti").union(fresh))

    def _shard(self):
        return F.pmod(F.col("k0"), F.lit(self.shards)).cast("int")

    def admitted(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that their shard's filter admits: those of all frequent keys and of few others."""
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if size <= self.broadcast_bytes:
            held = self.spark.sparkContext.broadcast(FilterSet(self.shards, [(r.shard, bytes(r.slots)) for r in self.filters.collect()]))
            return keys.mapInArrow(_admit(held), keys.schema)
        asked = keys.select("k0", "k1").distinct().withColumn("shard", self._shard())
        found = self.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_probe_shard, "k0 long, k1 long")
        return keys.join(found, ["k0", "k1"], "left_semi").select(*keys.columns)

    def probe(self, keys: DataFrame) -> DataFrame:
        """Distinct keys (k0, k1) that their shard's filter admits."""
        return self.admitted(keys.select("k0", "k1")).distinct()

    def dropped(self, keys: DataFrame) -> DataFrame:
        """(doc_id, lost array<struct<k0, k1>>): the lines each document loses."""
        return (self.admitted(keys).join(self.frequent.select("k0", "k1", "last"), ["k0", "k1"]).where("doc_id <> last")
                .groupBy("doc_id").agg(F.collect_set(F.struct("k0", "k1")).alias("lost")))

    def rewrite(self, docs: DataFrame, keys: DataFrame | None = None, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """``docs`` with the lines taken out of ``text``, and the numbers of lines before and dropped (long) added.

        A column of ``docs`` with the name of a number gives way to it.
        """
        docs = docs.drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in names}))
        gone = free_name("lost", docs.columns)
        lost = self.dropped(self.keys(docs) if keys is None else keys).withColumnRenamed("lost", gone)
        joined = docs.join(shuffle_join(lost), "doc_id", "left")
        at = docs.columns.index("text")
        schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
        return joined.select(*docs.columns, gone).mapInArrow(_rewrite(at, self.min_chars, schema.names), schema)


def _update_shard(key, old: pa.Table, change: pa.Table) -> pa.Table:
    shard = int(key[0].as_py())
    known = None
    if old.num_rows:
        slots = np.frombuffer(old.column("slots")[0].as_py(), np.uint16)
        known = CuckooFilter(len(slots) // SLOTS, slots)
    rows = change.sort_by([("k0", "ascending"), ("k1", "ascending")])
    out = update_filter(known, *(rows.column(c).to_pylist() for c in ("k0", "k1", "change")))
    alive = sum(c >= 0 for c in rows.column("change").to_pylist())
    return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([alive], pa.int64()),
                     "slots": pa.array([out.slots.tobytes()], pa.binary())})


def _probe_shard(filters: pa.Table, asked: pa.Table) -> pa.Table:
    asked = asked.select(["k0", "k1"])
    if not filters.num_rows or not asked.num_rows:
        return asked.slice(0, 0)
    slots = np.frombuffer(filters.column("slots")[0].as_py(), np.uint16)
    k0, k1 = (np.ascontiguousarray(asked.column(c).to_numpy()) for c in ("k0", "k1"))
    return asked.filter(pa.array(CuckooFilter(len(slots) // SLOTS, slots).contains(k0, k1)))


def _rewrite(text_at: int, min_chars: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts, n_lines, n_dropped = [], [], []
                for text, lost in zip(some.column(text_at).to_pylist(), some.column(some.num_columns - 1).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    if lost:
                        gone = {np.array([x["k0"], x["k1"]], "<i8").tobytes() for x in lost}
                        kept = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in gone]
                        text = "\n".join(kept)
                        n_dropped.append(len(lines) - len(kept))
                    else:
                        n_dropped.append(0)
                    texts.append(text)
                    n_lines.append(len(lines))
                cols = [some.column(i) for i in range(some.num_columns - 1)]
                cols[text_at] = pa.array(texts, cols[text_at].type)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without lines that ``min_docs`` documents hold, except in the largest doc_id holding each.

    A line's key is the line stripped of ASCII white space at both ends with A-Z folded; keys under
    ``min_chars`` code points always stay.  All columns of ``docs`` are kept, ``text`` is rewritten, and
    the numbers of lines before and of dropped ones are added under ``names``, in place of columns of these names.  A null or empty text is one empty line and stays as it is;
    rows with a null doc_id hold no counted line and lose none; a repeated doc_id counts once and each of
    its rows is rewritten; an empty table gives an empty result.
    """
    store = LineStore(docs.sparkSession, min_docs, min_chars)
    keys = materialise(store.keys(docs))
    return store.insert(docs, keys).rewrite(docs, keys, names)


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, coalesce(hot.last <> doc_id, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op8_cuckoo_lines", SQL)
def op8_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
