import random

import corpus_pipeline
from vantage.llm import line_store

LINES = [f"a line of forty code points or more, number {i:04d}" for i in range(60)]


def _docs(spark, seed=3, n=80):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "\n".join(rng.choice(LINES) for _ in range(6))) for i in range(n)], "doc_id long, text string")


def _shot(store):
    return sorted(map(tuple, store.postings.collect())), sorted(map(tuple, store.frequent.collect()))


def test_clashing_columns(spark):
    docs = _docs(spark).selectExpr("*", "doc_id as n_lines", "'x' as lost", "'y' as N_DROPPED", "'z' as __lost", "length(text) as n_chars")
    got = line_store.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "lost", "__lost", "n_chars", "n_lines", "n_dropped"]
    want = {r.doc_id: r for r in line_store.dedup_lines(docs.select("doc_id", "text")).collect()}
    rows = got.collect()
    assert len(rows) == 80 and all((r.text, r.n_lines, r.n_dropped) == tuple(want[r.doc_id][1:]) for r in rows)
    assert all((r["lost"], r["__lost"]) == ("x", "z") for r in rows) and any(r.n_dropped for r in rows)
    staged = corpus_pipeline.line_dedup(spark, docs, "")
    assert staged.columns == docs.columns
    for r in staged.collect():
        assert (r.n_lines, r.N_DROPPED, r.text) == (r.doc_id, "y", want[r.doc_id].text) and r.n_chars == len(r.text)


def test_filters_too_large_to_broadcast(spark):
    docs = _docs(spark)
    near = line_store.LineStore(spark, shards=4).insert(docs)
    far = line_store.LineStore(spark, shards=4, broadcast_bytes=0).insert(docs)
    rows = lambda s: sorted(map(tuple, s.admitted(s.keys(docs)).collect()))
    assert rows(near) == rows(far) and rows(near)


def test_changes_touch_their_shards_alone(spark, monkeypatch):
    docs = _docs(spark)
    store = line_store.LineStore(spark, shards=64).insert(docs)
    before = _shot(store)
    extra = spark.createDataFrame([(1000 + i, "one single line that the store does not hold as yet, twice\n" * 2) for i in range(5)], "doc_id long, text string")
    store.insert(extra)
    assert store.rewritten == 1 and len(store.frequent.collect()) == len(before[1]) + 1
    store.delete(extra)
    assert store.rewritten == 1 and _shot(store) == before
    store.delete(extra)  # not held: nothing changes, and nothing is owed
    assert store.rewritten == 0 and _shot(store) == before
    monkeypatch.setattr(line_store, "MAX_CHANGES", 2)
    store.insert(extra)
    assert len(store.changes) == 1 and len(store.frequent.collect()) == len(before[1]) + 1


def test_shards_follow_the_number_of_keys(spark, monkeypatch):
    monkeypatch.setattr(line_store, "KEYS_A_SHARD", 8)
    docs = _docs(spark)
    store = line_store.LineStore(spark).insert(docs.where("doc_id < 30"))
    few = store.shards
    store.insert(docs.where("doc_id >= 30"))
    whole = line_store.LineStore(spark).insert(docs)
    assert few < whole.shards and _shot(store) == _shot(whole)
    frequent = {(r.k0, r.k1) for r in store.frequent.collect()}
    assert frequent <= {tuple(r) for r in store.probe(store.keys(docs)).collect()}
