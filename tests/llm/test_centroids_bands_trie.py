import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
import zstandard

from vantage.llm import centroids, compression_bands, ordered, prefix_trie
from vantage.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


# --- operator 11 -------------------------------------------------------------------------------------------

def _lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < 1 << 27 for x in v)]
    start = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None))
    cents = [v for _, _, v in start[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        new = []
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else cents[c])
        cents = new
    out = [(i, *near(v)) for i, v in kept]
    total = sum(d for *_, d in out)
    return sorted(((i is None, i, c, d, sum(e for _, b, e in out if b == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for i, c, d in out), key=str)


def _rows(df):
    return sorted(((r.vec_id is None, *r) for r in df.collect()), key=str)


def test_centroids_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pylist()]
    assert _rows(QUERIES["op11_pca_centroids"](spark, SF)) == _lloyd(rows)


def test_centroids_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(64)]) for i in range(40)]
    rows += [(3, rows[3][1]), (3, [0.0] * 64), (None, [0.01] * 64), (101, None), (102, []), (103, [1.0] * 63), (104, [None] + [1.0] * 63),
             (105, [math.nan] * 64), (106, [math.inf] + [0.0] * 63), (107, [-2e6] * 64), (108, [0.1] * 64), (109, [0.1] * 64)]
    far = [(110, [1e30] + [0.0] * 63), (111, [1e308] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + far], "vec_id long, embedding array<double>, cluster string, cells long")
    got = _rows(centroids.with_summary(*centroids.cluster(df)))
    assert [r for r in got if r[1] not in (110, 111)] == _lloyd(rows)
    assert [r[1:] for r in got if r[1] in (110, 111)] == [(i, None, None, None, None, None) for i in (110, 111)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert _rows(centroids.with_summary(*centroids.cluster(few))) == _lloyd(rows[:3])
    for none in (spark.createDataFrame([], few.schema), spark.createDataFrame([(1, None)], few.schema)):
        assert centroids.with_summary(*centroids.cluster(none)).count() == 0


@pytest.mark.parametrize("spread", [1, 400, 1 << 26])
def test_filter_equals_all_distances(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(-spread, spread + 1, (16, 64))
    x = base[rng.integers(0, 16, 800)] + rng.integers(-(spread // 8) - 1, spread // 8 + 2, (800, 64))
    x = np.clip(x, -(1 << 27) + 1, (1 << 27) - 1)
    cents = np.concatenate((base[:8], base[:8]))  # every centroid twice: ties
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = np.ascontiguousarray(axes[:, ::-1])
    for lead in (1, 10, 64):
        near = centroids.Nearest(cents, mean, axes, lead)
        y = (x - mean) @ axes
        got = near(x, y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1)))
        want = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
        assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()
    assert near.verified < len(x) * len(cents)


# --- operator 12 -------------------------------------------------------------------------------------------

def _quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    data, c = text.encode(), zstandard.ZstdCompressor(level=3)

    def bad(piece):
        low, high = next((b.low, b.high) for b in reversed(compression_bands.BANDS) if len(piece) >= b.from_bytes)
        return not low <= len(piece) / len(c.compress(piece)) <= high

    pieces = [data[i:i + 4096] for i in range(0, len(data), 4096)]
    method = not data or not (bad(data) or len(data) > 4096 and 4 * sum(len(p) for p in pieces if bad(p)) > len(data))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, not failed and method


_RNG = random.Random(11)
_VOCABULARY = ["".join(_RNG.choice("etaoinshrdlu") for _ in range(_RNG.randrange(2, 9))) for _ in range(2500)]
_PROSE = [" ".join(_RNG.choice(_VOCABULARY) for _ in range(n)) for n in (19, 20, 25, 60, 300, 1500, 9000)]
_NOISE = "".join(_RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30_000))
_TEXTS = [None, "", " \n\t", "one", *_PROSE, _PROSE[4] + "\n" + _PROSE[4], "a b c d e f g h " * 30, "x" * 300_000,
          " ".join(_NOISE[i:i + 60] for i in range(0, 3000, 60)), _PROSE[5] + " " + " ".join(_NOISE[i:i + 70] for i in range(0, 9000, 70)),
          _PROSE[6] + " " + " ".join(_NOISE[i:i + 70] for i in range(0, 30000, 70)),
          "".join(f"record number {i} unchanged value\n" for i in range(3000)), "a\nb\na\n a\nA\r\n\x0b\n\n" * 3, "Ünï\x85cöde   # * <é> " * 9,
          "日本語の文章を" * 30, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " + _PROSE[3] + " w1 w2 w3 w4 w5 w6 w7 w8 w9",
          "\n".join(f"line {i} of a {_VOCABULARY[i]} long {_VOCABULARY[i + 40]} list" for i in range(400))]


def test_quality_of_odd_texts(spark):
    rows = list(enumerate(_TEXTS)) + [(None, _TEXTS[5]), (5, _TEXTS[5]), (5, None)]
    df = spark.createDataFrame([(i, t, "k", 2) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    got = sorted(((r.doc_id, *(r[c] for c in columns)) for r in compression_bands.assess(df).collect()), key=key)
    assert got == sorted(((i, *_quality(t)) for i, t in rows), key=key)
    reasons = {r.doc_id: r.reason for r in compression_bands.assess(df).collect()}
    assert {None, "words", "repeats", "repetitive", "incompressible", "chunks"} == set(reasons.values())
    kept = compression_bands.keep_good(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=key) == sorted(
        ((i, t, "k", 2) for i, t in rows if _quality(t)[-1]), key=key)
    none = spark.createDataFrame([], df.schema)
    assert compression_bands.assess(none).count() == 0 and compression_bands.keep_good(none).count() == 0


def test_quality_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
           for r in QUERIES["op12_compression_bands"](spark, SF).collect()}
    assert got == {i: _quality(t) for i, t in rows} and 0 < sum(v[-1] for v in got.values()) < len(got)


# --- operator 13 -------------------------------------------------------------------------------------------

def _trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h]) + tuple(mine[h:])
    members, last = {}, {}
    for c, t in whole.items():
        last.setdefault(t, []).append(c)
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(last.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def _conversations():
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 130), 200, 201, 350, 377, -3, -150, -151, 10**15 + 7]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None, "Ünï 日本"])))
    rows += [(700, None, "user", "a"), (700, 0, "user", "b"), (701, -1, "user", "c"), (None, 0, "user", "lost"), (701, 5, None, None), (701, 5, None, None)]
    rows += [(c, t, "user", "same words") for c in (900, 901, 902, 903) for t in range(700)]  # long copies
    rows += [(1000 + c, 0, "user", "hello") for c in range(300)]  # many ends in one node
    return rows


def _nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


_SCHEMA = "conv_id long, turn long, role string, text string, conv string, d int, p1 string"


@pytest.mark.parametrize("cells", [None, 8])
def test_trie_of_odd_rows(spark, monkeypatch, cells):
    """Against a trie in memory; with a sketch of 8 cells nothing is screened out and all counting is exact."""
    if cells:
        monkeypatch.setattr(prefix_trie, "sketch_width", lambda keys: cells)
    rows = _conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], _SCHEMA).repartition(5)
    assert _nodes(prefix_trie.trie(df)) == _trie(rows)


def test_trie_with_small_splits_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK_CHARS", 100)
    monkeypatch.setattr(prefix_trie, "_HOT_SHARE", 3)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    rows = _conversations()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "41")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        assert _nodes(prefix_trie.trie(spark.createDataFrame([(*r, "x", 1, None) for r in rows], _SCHEMA))) == _trie(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_trie_query_and_empty(spark):
    rows = [tuple(r.values()) for r in ds.dataset(f"{SF}/conversations.parquet").to_table(columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert _nodes(QUERIES["op13_prefix_trie"](spark, SF)) == _trie(rows)
    for none in ([], [(None, 1, "user", "x", None, None, None)]):
        assert prefix_trie.trie(spark.createDataFrame(none, _SCHEMA)).count() == 0


def test_scan_over_cut_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice([7, 7, 7, rng.randrange(40)]), i, rng.randrange(-10**18, 10**18)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        out = ordered.scan(spark.createDataFrame(rows, "g long, i long, v long"), "g", ["i"], sums={"s": "v"}, hashes={"h": ordered.Hash("v", 12345677)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {(r.g, r.i): (r.place, r.last, r.s, r.h) for r in out}
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        s = h = 0
        for p, (_, i, v) in enumerate(own):
            s, h = wrap(s + v), wrap(h + v * pow(12345677, p, 1 << 64))
            want[g, i] = (p, p == len(own) - 1, s, h)
    assert got == want


def test_ends_digest_streams_in_numeric_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK_CHARS", 60)
    ends = [(1, 2, 0, c) for c in [*range(95, 400), -5, 1000]] + [(1, 2, 1, 9)]
    got = {(r.p1, r.p2, r.d): r.ends_sha256 for r in prefix_trie.ends_digests(spark.createDataFrame(ends, "p1 long, p2 long, d long, conv long")).collect()}
    want = ",".join(map(str, sorted(c for *k, c in ends if k == [1, 2, 0])))
    assert got == {(1, 2, 0): hashlib.sha256(want.encode()).hexdigest(), (1, 2, 1): hashlib.sha256(b"9").hexdigest()}
