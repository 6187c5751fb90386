"""Ordered-greedy operators against sequential brute-force models."""

import random

from pyspark.sql import functions as F

from vantage.operators import greedy as G


def seq_leaders(n, edges):
    """The reference's loop: earliest unclaimed row leads and claims later matches."""
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    claimed, leader = set(), {}
    for i in range(n):
        if i in claimed:
            continue
        claimed.add(i)
        leader[i] = i
        for j in range(i + 1, n):
            if j not in claimed and j in adj.get(i, ()):
                claimed.add(j)
                leader[j] = i
    return leader


def seq_two_key(rows):
    seen1, seen2, out = set(), set(), set()
    for pos, k1, k2 in rows:
        if k1 in seen1 or k2 in seen2:
            continue
        seen1.add(k1)
        seen2.add(k2)
        out.add(pos)
    return out


def test_leader_golden(spark):
    # A~B, B~C, not A~C -> {A,B}, {C}
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "pos long")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    got = {r.pos: r.leader for r in G.leader_clusters(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_leader_random(spark):
    rng = random.Random(7)
    for _ in range(4):
        n = 40
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
        nodes = spark.createDataFrame([(i,) for i in range(n)], "pos long")
        e = spark.createDataFrame(sorted(edges) or [(0, 0)], "a long, b long").where("a < b")
        got = {r.pos: r.leader for r in G.leader_clusters(nodes, e).collect()}
        assert got == seq_leaders(n, edges)


def test_two_key_golden(spark):
    # (u1,k1), (u1,k2), (u2,k2) -> rows 1 and 3 kept
    df = spark.createDataFrame([(1, "u1", "k1"), (2, "u1", "k2"), (3, "u2", "k2")], "pos long, u string, k string")
    got = {r.pos for r in G.two_key_accept(df, "pos", "u", "k").where("accepted").collect()}
    assert got == {1, 3}


def test_two_key_random(spark):
    rng = random.Random(11)
    rows = [(i, f"u{rng.randrange(15)}", f"k{rng.randrange(15)}") for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, u string, k string")
    got = {r.pos for r in G.two_key_accept(df, "pos", "u", "k").where("accepted").collect()}
    assert got == seq_two_key(rows)


def test_tracker_clusters_match_sequential(spark, duck):
    """Spark clusters on sf0.001 equal the sequential loop over the oracle's edge list."""
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    found = duck.execute("SELECT kind, a, b FROM (" + E.oracle_sql()["join_role_fuzzy_dedup"] + ")").fetchall()
    rows = {}
    for kind, a, b in found:
        if kind == "member":
            rows.setdefault(a, []).append(b)
    # Rows of paired classes match, and so do rows of one class (roles have two tokens or more here).
    pairs = [(x, y) for kind, a, b in found if kind == "pair" for x in rows[a] for y in rows[b]]
    pairs += [(x, y) for own in rows.values() for x in own for y in own if x < y]
    edges = {(min(p), max(p)) for p in pairs}
    order = sorted({p for e in edges for p in e})
    idx = {p: i for i, p in enumerate(order)}
    lead = seq_leaders(len(order), {(idx[a], idx[b]) for a, b in edges})
    want = {order[i]: order[j] for i, j in lead.items()}
    got = {r.pos: r.leader for r in E.queries()["ddp_tracker_cluster"](spark, sf).collect()}
    assert got == want
