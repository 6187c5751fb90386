"""First-match index against all pairs, its growth, script-aware company keys and joins with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from vantage.functions import text as T
from vantage.operators import first_match as FM
from vantage.operators import upsert as U
from vantage.operators.skew import lookup


def matches(left, right):
    n = sum(w in right for w in left)
    return bool(left) and bool(right) and n >= 2 and n / min(len(left), len(right)) >= 0.6


def first_by_pairs(left, right):
    out = {}
    for i, b, t in left:
        hits = [p for p, b2, t2 in right if b == b2 and matches(t, t2)]
        if hits:
            out[i] = min(hits)
    return out


def lists(rng, n, words, longest, blocks):
    return [(i, rng.choice(blocks), [rng.choice(words) for _ in range(rng.randrange(longest + 1))]) for i in range(n)]


@pytest.mark.parametrize("longest,words", [(7, 12), (16, 25)])
def test_first_match_equals_pairs(spark, longest, words):
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(words)]
    left, right = lists(rng, 250, vocabulary, longest, ["a", "b", "", None]), lists(rng, 250, vocabulary, longest, ["a", "b", "", None, "c"])
    rng.shuffle(right)
    l = spark.createDataFrame(left, "id long, ckey string, tokens array<string>")
    r = spark.createDataFrame(right, "pos long, ckey string, tokens array<string>")
    got = {x.id: x.pos for x in FM.first_match(l, r, "ckey", "tokens", "id", "pos").collect()}
    want = first_by_pairs([x for x in left if x[1] is not None], right)
    assert got == want and len(want) > 40
    rows = FM.match_classes(l, r, "ckey", "tokens", "id", "pos").collect()
    own = {x.id: x.pos for x in rows if x.kind == "left"}
    theirs = {x.pos: x.id for x in rows if x.kind == "right"}
    pairs = {(x.id, x.pos) for x in rows if x.kind == "match"}
    for i, b, t in left:
        for p, b2, t2 in right:
            assert ((own.get(i), theirs.get(p)) in pairs) == (b is not None and b == b2 and matches(t, t2))


def _company(spark, n):
    """n additions and n rows of one company: a third share one role, the others have roles of their own."""
    roles = [["data", "developer"] if i % 3 == 0 else ["data", "developer", f"x{i}", f"y{i}"] for i in range(n)]
    l = spark.createDataFrame([(i, "c", t) for i, t in enumerate(roles)], "id long, ckey string, tokens array<string>")
    r = spark.createDataFrame([(i + 5, "c", t + ["z"]) for i, t in enumerate(roles)], "pos long, ckey string, tokens array<string>")
    return l, r


def test_candidates_are_linear_in_the_rows_of_one_company(spark):
    sizes = []
    for n in (300, 600):
        l, r = _company(spark, n)
        asked, known = FM.classes(l, "ckey", "tokens", "id", "id"), FM.classes(r, "ckey", "tokens", "pos", "pos")
        sizes.append(FM.probes(asked).join(FM.index(known), ["block", "key"]).count())
        got = {x.id: x.pos for x in FM.first_match(l, r, "ckey", "tokens", "id", "pos").collect()}
        assert len(got) == n and all(got[i] == 5 for i in range(0, n, 3))
    assert sizes[1] <= 2.2 * sizes[0] and sizes[0] < 300 * 40


def test_lookup_with_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 50}") for i in range(2000)], "id long, k string")
    entries = spark.createDataFrame([("hot", 1), ("hot", 2), ("k4", 3), ("k6", 4), ("none", 5)], "k string, v int")
    plain = sorted(map(tuple, rows.join(entries, ["k"]).collect()))
    for least in (0, 500, 10_000):
        assert sorted(map(tuple, lookup(rows, entries, ["k"], least).collect())) == plain


NAMES = [("鴻海精密", "鴻海精密"), ("Ｃａｆé  Ltd.", "caféltd"), ("Café ltd", "caféltd"), ("***", None), ("", None), (None, None), ("हिन्दी २", "हिन्दी२"),
         ("Яндекс", "яндекс"), ("A & B (EU)", "abeu"), ("㈱テスト", "株テスト")]


def test_safe_company_key(spark):
    df = spark.createDataFrame(NAMES, "name string, want string")
    rows = df.select("want", T.company_key_safe("name").alias("k"), T.company_key_safe_spaced("name").alias("s")).collect()
    assert all(r.k == r.want for r in rows)
    assert {r.s for r in rows} >= {"鴻海精密", "café ltd", "a  b eu", None}


def _tracker(spark, rows):
    return spark.createDataFrame([(i, 100 + i, c, r, f"[{900 + i}](x.md)", "3.0/5") for i, (c, r) in enumerate(rows)],
                                 "pos long, num int, company string, role string, report string, score_raw string")


def test_merge_keeps_companies_of_other_scripts_apart(spark):
    existing = _tracker(spark, [("台積電", "Data Platform Developer"), ("鴻海", "Data Platform Developer"), ("***", "Data Platform Developer")])
    adds = spark.createDataFrame([(1, 1, "鴻 海", "Data Platform Developer", "[1](y.md)"), (2, 2, "ソニー", "Data Platform Developer", "[2](y.md)"),
                                  (3, 3, "--", "Data Platform Developer", "[3](y.md)")],
                                 "add_id long, num int, company string, role string, report string")
    safe = {r.add_id: r.target_pos for r in U.dup_priority(adds, existing, "safe").collect()}
    parity = {r.add_id: r.target_pos for r in U.dup_priority(adds, existing).collect()}
    assert safe == {1: 1} and parity == {1: 0, 2: 0, 3: 0}


def test_number_tiers_take_the_first_row(spark):
    existing = _tracker(spark, [("a", "x"), ("b", "y"), ("c", "z")]).withColumn("num", F.lit(7)).withColumn("report", F.lit("[9](r.md)"))
    adds = spark.createDataFrame([(i, 7 if i % 2 else 8, "q", "q", "[9](r.md)" if i % 3 else "none") for i in range(1, 60)],
                                 "add_id long, num int, company string, role string, report string")
    got = {r.add_id: (r.tier, r.target_pos) for r in U.dup_priority(adds, existing).collect()}
    assert got == {i: (1, 0) if i % 3 else (2, 0) for i in range(1, 60) if i % 3 or i % 2}
