"""Trie over the turn prefixes of conversations (operator 13).

A prefix is known by a 128-bit digest.  A count-min sketch over all digests screens them: an estimate of
one proves that a single conversation has the prefix, hence also every longer one of that conversation.
Such tails become nodes where they are; only prefixes that may be shared are shuffled and counted exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import Hash, scan
from .registry import query
from .store import materialise, shuffle_join, shuffle_width, table
from .textbatch import mix

FAMILY = 100
MAX_SHARED = 6
#: Rows of the sketch, cells per key wanted in each, and the most cells a row may have (8 MB of bits each
#: at 2^26); beyond that more prefixes pass the screen and are counted exactly.
SKETCH_ROWS = 3
CELLS_PER_KEY = 4
MAX_CELLS = 1 << 26
_SLICE = 1 << 20
#: Keys whose cells a task sorts at once.
_BLOCK_KEYS = 1 << 20
#: Parents with more than this share of all nodes as children are joined by broadcast: fewer than 1,000.
_HOT_SHARE = 1000
_CHUNK_CHARS = 1 << 16
_SALTS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_EMPTY = hashlib.sha256(b"").hexdigest()


def plain_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, t1, t2, chars, uid) of rows with a conv_id; two 64-bit hashes stand for role and text.

    Null roles and texts are empty.  Rows with one turn number stand in order of these hashes; repeated
    rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("uid"))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % MAX_SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, d, p1, p2, q1, q2, chars, last): every prefix of the rebuilt conversations, d = 0 included.

    A conversation starts with the first h turns of conversation conv - conv % 100 and goes on with its
    own after its first h.  (p1, p2) is the digest of the prefix, (q1, q2) that of the prefix before;
    ``last`` marks the whole conversation.
    """
    own = materialise(scan(plain_turns(turns), "conv", [F.col("turn").asc_nulls_first(), "t1", "t2", "uid"])
                      .select("conv", "place", "t1", "t2", "chars"))
    heads = own.where("place = 0").select("conv", shared_turns(F.col("conv")).alias("h"))
    zero = F.lit(0).cast("long")
    roots = heads.select("conv", F.lit(0).alias("src"), zero.alias("place"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars"))
    first = own.where((F.col("place") < MAX_SHARED) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "lead")
    led = (heads.where("h > 0").withColumn("lead", F.col("conv") - F.col("conv") % FAMILY).join(first, "lead").where("place < h")
           .select("conv", F.lit(1).alias("src"), "place", "t1", "t2", "chars"))
    rest = own.where(F.col("place") >= shared_turns(F.col("conv"))).select("conv", F.lit(2).alias("src"), "place", "t1", "t2", "chars")
    ordered = scan(roots.unionByName(led).unionByName(rest).withColumnRenamed("place", "at"), "conv", ["src", "at"],
                   hashes={"p1": Hash("t1", _BASES[0]), "p2": Hash("t2", _BASES[1])})
    return materialise(_with_parents(ordered))


def _with_parents(prefixes: DataFrame) -> DataFrame:
    """The digest before is the digest less the turn's own term: no neighbour row is needed."""

    def run(batches):
        for b in batches:
            d = b.column("place").to_numpy()
            out = [b.column("conv"), b.column("place"), b.column("p1"), b.column("p2")]
            for p, t, base in (("p1", "t1", _BASES[0]), ("p2", "t2", _BASES[1])):
                term = b.column(t).to_numpy().view(np.uint64) * _power(base, d)
                out.append(pa.array((b.column(p).to_numpy().view(np.uint64) - term).view(np.int64)))
            yield pa.record_batch([*out, b.column("chars"), b.column("last")], names=["conv", "d", "p1", "p2", "q1", "q2", "chars", "last"])

    return prefixes.mapInArrow(run, "conv long, d long, p1 long, p2 long, q1 long, q2 long, chars long, last boolean")


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ^ exponent modulo 2^64, by squaring."""
    out, square, e = np.ones(len(exponent), np.uint64), np.uint64(base), exponent.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1) > 0, out * square, out)
        e = e >> np.uint64(1)
        square = np.uint64(int(square) * int(square) % (1 << 64))
    return out


def _cells(p1: np.ndarray, p2: np.ndarray, j: int, width: int) -> np.ndarray:
    return (mix(p1.view(np.uint64) ^ (p2.view(np.uint64) * _SALTS[j + 1]) ^ _SALTS[j]) & np.uint64(width - 1)).astype(np.int64)


def sketch_width(keys: int) -> int:
    """Cells of a sketch row, a power of two: ``CELLS_PER_KEY`` a key up to ``MAX_CELLS``."""
    return min(MAX_CELLS, max(1 << 10, 1 << (CELLS_PER_KEY * keys - 1).bit_length()))


def count_min(prefixes: DataFrame, width: int) -> np.ndarray:
    """Per sketch row the bits of cells that count two or more: all that the screen asks for.

    Tasks send each touched cell once per block of keys, by slices of the sketch; a task adds up a slice
    while its sorted rows stream past.  ``SKETCH_ROWS * width`` bits reach the driver.
    """
    size = min(_SLICE, width)

    def touched(batches):
        held, n = [], 0

        def flush():
            p1, p2 = (np.concatenate(x) for x in zip(*held, strict=True))
            for j in range(SKETCH_ROWS):
                cell, count = np.unique(_cells(p1, p2, j, width), return_counts=True)
                cut = np.searchsorted(cell, np.arange(0, width + 1, size))
                for s in np.flatnonzero(cut[1:] > cut[:-1]):
                    a, b = cut[s], cut[s + 1]
                    own = (cell[a:b] - s * size).astype("<u4")
                    yield pa.record_batch([pa.array([j * (width // size) + int(s)], pa.int32()), pa.array([np.diff(own, prepend=np.uint32(0)).tobytes()]),
                                           pa.array([np.packbits(count[a:b] > 1).tobytes()])], names=["slice", "steps", "more"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= _BLOCK_KEYS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merged(batches):
        at, counts = None, None
        for batch in batches:
            for s, steps, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != at:
                    if at is not None:
                        yield _slice_bits(at, counts)
                    at, counts = s, np.zeros(size, np.uint8)
                cell = np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.int64)
                twice = np.unpackbits(np.frombuffer(more, np.uint8), count=len(cell))
                counts[cell] = np.minimum(counts[cell] + 1 + twice, 2)
        if at is not None:
            yield _slice_bits(at, counts)

    def _slice_bits(s: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()])], names=["slice", "bits"])

    slices = (prefixes.select("p1", "p2").mapInArrow(touched, "slice int, steps binary, more binary")
              .repartition(shuffle_width(prefixes.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(merged, "slice int, bits binary"))
    out = np.zeros((SKETCH_ROWS * (width // size), size // 8), np.uint8)
    for r in slices.collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(SKETCH_ROWS, width // 8)


def screened(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` with ``state``: 0 may be shared, 1 first of a tail, 2 further down a tail.

    A tail starts at a conversation's first prefix with an estimate of one.  A task sees that where it has
    the conversation from its start; conversations that are cut by a split of the table, at most one a
    split, are settled by a minimum over their rows.
    """
    width = sketch_width(prefixes.count())
    bits = prefixes.sparkSession.sparkContext.broadcast(count_min(prefixes, width))

    def run(batches):
        before = (None, 0, False)  # conversation, depth and being in a tail of the last row
        for b in batches:
            if not b.num_rows:
                continue
            conv, d = b.column("conv").to_numpy(), b.column("d").to_numpy()
            p1, p2 = b.column("p1").to_numpy(), b.column("p2").to_numpy()
            shared = np.ones(len(conv), bool)
            for j in range(SKETCH_ROWS):
                cell = _cells(p1, p2, j, width)
                shared &= (bits.value[j][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            goes_on = before[:2] == (conv[0], d[0] - 1)
            new = np.concatenate(([not goes_on], (conv[1:] != conv[:-1]) | (d[1:] != d[:-1] + 1)))
            starts, seg = np.flatnonzero(np.concatenate(([True], new[1:]))), np.cumsum(np.concatenate(([False], new[1:])))
            alone = np.cumsum(~shared)
            tail = alone - (alone[starts] - ~shared[starts])[seg] > 0
            if goes_on and before[2]:
                tail[seg == 0] = True
            after_tail = np.concatenate(([goes_on and before[2]], tail[:-1] & ~new[1:]))
            before = (conv[-1], d[-1], bool(tail[-1]))
            yield pa.record_batch([*b.columns, pa.array(np.where(tail, np.where(after_tail, 2, 1), 0), pa.int8()), pa.array(~shared), pa.array(new & (d > 0))],
                                  names=[*b.schema.names, "state", "alone", "cut"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
    marked = materialise(prefixes.mapInArrow(run, f"{fields}, state byte, alone boolean, cut boolean"))
    cut = marked.where("cut").select("conv").distinct()
    start = (marked.join(F.broadcast(cut), "conv").groupBy("conv")
             .agg(F.min(F.when(F.col("alone"), F.col("d"))).alias("start"), F.lit(True).alias("was_cut")))
    gap = F.col("d") - F.col("start")
    state = F.when(F.col("was_cut"), F.when(gap == 0, 1).when(gap > 0, 2).otherwise(0)).otherwise(F.col("state"))
    return marked.join(F.broadcast(start), "conv", "left").withColumn("state", state).select(*prefixes.columns, "state")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, d, ends_sha256) from rows (p1, p2, d, conv): SHA-256 of the numerically sorted ids, comma-joined.

    Ranges of the ids become texts of bounded length; a task streams over the texts of a node, however
    many ids it has.
    """

    def chunks(batches):
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            conv = b.column(3).to_numpy()
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(conv) else []
            per = _CHUNK_CHARS // 21
            rows = [(*key[a], int(conv[x]), ",".join(map(str, conv[x:min(x + per, e)])))
                    for a, e in zip(new, [*new[1:], len(conv)], strict=True) for x in range(a, e, per)]
            yield pa.record_batch([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.string())],
                                  names=["p1", "p2", "d", "conv", "ids"])

    def hashed(batches):
        at, sha = None, None
        for b in batches:
            out = []
            for p1, p2, d, ids in zip(*(b.column(n).to_pylist() for n in ("p1", "p2", "d", "ids")), strict=True):
                if at == (p1, p2, d):
                    sha.update(b",")
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (p1, p2, d), hashlib.sha256()
                sha.update(ids.encode())
            yield _node_rows(out)
        if at is not None:
            yield _node_rows([(*at, sha.hexdigest())])

    def _node_rows(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)],
                               names=["p1", "p2", "d", "ends_sha256"])

    n = shuffle_width(ends.sparkSession)
    keys = ["p1", "p2", "d"]
    ranged = ends.select(*keys, "conv").repartitionByRange(n, *keys, "conv").sortWithinPartitions(*keys, "conv")
    texts = ranged.mapInArrow(chunks, "p1 long, p2 long, d long, conv long, ids string")
    return texts.repartition(n, *keys).sortWithinPartitions(*keys, "conv").mapInArrow(hashed, "p1 long, p2 long, d long, ends_sha256 string")


def _up(rows: DataFrame) -> DataFrame:
    """Children by the key of their parent."""
    return rows.where("d > 0").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("d") - 1).alias("d"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Input columns conv_id, turn, role, text; others are not read, and rows without a conv_id belong to no
    conversation.  Without conversations there is no root and the result is empty.
    """
    keys = ["p1", "p2", "d"]
    prefixes = screened(rebuilt(turns))
    shared, tails = prefixes.where("state = 0"), prefixes.where("state > 0")
    first = tails.where("state = 1")
    nodes = materialise(shared.groupBy(*keys).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                                  F.min("q1").alias("q1"), F.min("q2").alias("q2")))
    children = _up(nodes).unionByName(_up(first)).groupBy(*keys).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(shuffle_join(children), keys, "left").fillna(0, ["n_children"]))

    # A node's weight belongs to its smallest member, a tail's leaf to its conversation; running sums from
    # the longest prefix up give what lies below each prefix, and its members' sums add up to the node's.
    zero = F.lit(0).cast("long")
    weights = nodes.select(F.col("conv_id").alias("conv"), "d", F.lit(0).alias("kind"), zero.alias("p1"), zero.alias("p2"),
                           (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    leaves = first.select("conv", "d", F.lit(0).alias("kind"), zero.alias("p1"), zero.alias("p2"), F.lit(1).cast("long").alias("leaves"), zero.alias("saved"))
    paths = shared.select("conv", "d", F.lit(1).alias("kind"), "p1", "p2", zero.alias("leaves"), zero.alias("saved"))
    below = scan(weights.where("leaves > 0 or saved > 0").unionByName(leaves).unionByName(paths), "conv", [F.col("d").desc(), "kind"],
                 sums={"n_leaves": "leaves", "saved_tokens": "saved"})
    totals = below.where("kind = 1").groupBy(*keys).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = ends_digests(shared.where("last"))
    full = materialise(nodes.join(shuffle_join(totals), keys).join(shuffle_join(ends), keys, "left")
                       .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))))
    own = F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(_EMPTY)
    one = F.lit(1).cast("long")
    alone = [F.col("conv").alias("conv_id"), F.col("d").alias("depth"), one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
             one.alias("n_leaves"), zero.alias("saved_tokens"), own.alias("ends_sha256")]
    in_tails = tails.where("state = 2").select(*alone, F.col("conv").alias("parent_conv_id"))
    below_shared = full.withColumnRenamed("d", "depth").drop("chars", "p1", "p2").unionByName(first.select(*alone, "q1", "q2"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return _parents(below_shared, full).select(*out).unionByName(in_tails.select(*out))


def _parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with their parent's conv_id; parents of very many children are few and broadcast."""
    children = materialise(children.withColumn("up", F.col("depth") - 1))
    least = max(children.count() // _HOT_SHARE, 1)
    p = parents.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("d").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    on = ["q1", "q2", "up"]
    hot = F.broadcast(p.where(F.col("n_children") > least).drop("n_children").withColumnRenamed("parent_conv_id", "hot_id"))
    few = p.where(F.col("n_children") <= least).drop("n_children")
    marked = children.where("up >= 0").join(hot, on, "left")
    done = marked.where("hot_id is not null").withColumnRenamed("hot_id", "parent_conv_id")
    rest = marked.where("hot_id is null").drop("hot_id").join(few, on)
    top = children.where("up < 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return done.unionByName(rest).unionByName(top)


SQL = """
WITH t AS (
  SELECT conv_id AS c, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (  -- bytes of the decimal conv_id and its unsigned CRC-32, bit by bit
  SELECT c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda p: ascii(substr(c::VARCHAR, p::INT, 1))::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS r
  FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, xor(r, 4294967295::UBIGINT) % 6 AS h, c - c % 100 AS lead FROM b),
r AS (
  SELECT h.c, 0 AS src, i, t, chars FROM h JOIN t ON t.c = h.lead AND t.i <= h.h
  UNION ALL SELECT h.c, 1, i, t, chars FROM h JOIN t ON t.c = h.c AND t.i > h.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY src, i) AS d, t, chars FROM r),
p AS (
  SELECT c, 0 AS d, '' AS p, NULL AS q, 0 AS chars FROM h
  UNION ALL SELECT c, d, string_agg(t, '') OVER w, coalesce(string_agg(t, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), chars
  FROM n WINDOW w AS (PARTITION BY c ORDER BY d)),
l AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM p),
g AS (
  SELECT p, any_value(q) AS q, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '') AS ends
  FROM l GROUP BY p),
k AS (SELECT q AS p, count(*) AS n_children FROM g WHERE q IS NOT NULL GROUP BY q),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (p)),
s AS (
  SELECT l.p, sum((f.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens
  FROM f JOIN l ON l.c = f.conv_id AND l.d <= f.d GROUP BY l.p)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (p) LEFT JOIN g up ON up.p = f.q
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
