"""Word lookup by grams and best role against sequential models; keys of padded report numbers."""

import random

import pytest

from vantage.operators import contains as CT
from vantage.operators import queue as QU


def test_containing(spark):
    rng = random.Random(6)
    texts = list({(rng.choice("ab"), " ".join(rng.choice(["data", "dat", "atad", "dé", "資料", "資", "x y", "engineer"]) for _ in range(rng.randrange(1, 5)))) for _ in range(80)})
    words = [(b, w) for b in "abc" for w in ("data", "ata", "資", "資料", "dé", "é", "zzz", "engineer", "gine", "ab", "data x")]
    got = {tuple(r) for r in CT.containing(spark.createDataFrame(words, "block string, word string"), spark.createDataFrame(texts, "block string, text string")).collect()}
    assert got == {(b, w, t) for b, w in words for c, t in texts if b == c and len(w.encode()) > 2 and w in t} and len(got) > 100


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_best_role(spark, monkeypatch, common):
    monkeypatch.setattr(CT.best_texts, "__defaults__", (common,))
    rng = random.Random(common)
    vocabulary = ["data", "platform", "engineer", "engine", "sr", "lead", "ml", "資深", "資料", "growth"]
    role = lambda: " ".join(rng.choice(vocabulary).title() for _ in range(rng.randrange(1, 6)))
    apps = [(i, rng.choice(["c1", "c2", "c3", "none"]), role()) for i in range(120)] + [(500, "c1", "  "), (501, "c1", "data data sr platform")]
    cands = [(rng.choice(["c1", "c2", "c4"]), role(), f"u{i}", i) for i in range(90)] + [("c3", "Data", "only", 900)]
    got = {r.pos: (r.url, r.score) for r in QU.best_role(spark.createDataFrame(apps, "pos long, ckey string, role string"),
                                                        spark.createDataFrame(cands, "ckey string, cand_role string, url string, cand_pos long")).collect()}
    want = {}
    for i, key, r in apps:
        scored = [(-sum(w in cr.lower() for w in r.lower().split() if len(w.encode()) > 2), p, u) for k, cr, u, p in cands if k == key]
        if scored:
            s, _, u = min(scored)
            want[i] = (u, -s)
    assert got == want


def test_padded_report_numbers(spark):
    done = [("7", "u7", 1), ("007", "later", 2), ("12", "u12", 3), ("345", "u345", 4), ("7", "last", 5)]
    got = {r.report_num: r.m_url for r in QU.report_urls(spark.createDataFrame(done, "report_num string, qurl string, first_seq long")).collect()}
    assert got == {"7": "last", "007": "last", "12": "u12", "012": "u12", "345": "u345"}
