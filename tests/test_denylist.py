"""Deny-list by automaton and by gram join against plain containment."""

import random

from vantage.operators import documents as DO


def test_scan_and_join_agree_with_containment(spark):
    rng = random.Random(12)
    alphabet = "abcé資 "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    lines = [(i, j, text(rng.randrange(0, 60))) for i in range(60) for j in range(1, 4)] + [(900, 1, None), (901, 1, ""), (902, 1, "x" * 50_000 + "needle in a haystack")]
    patterns = [(i, text(n)) for i, n in enumerate((1, 2, 2, 3, 3, 4, 5, 6, 7, 7, 8))]
    for i in range(40):  # pieces of lines, of every length and offset
        line = rng.choice([t for *_, t in lines[:180] if len(t) > 20])
        a = rng.randrange(len(line) - 16)
        patterns.append((100 + i, line[a:a + rng.randrange(1, 40)]))
    patterns += [(200, "needle in a hay"), (201, None), (202, ""), (203, "never here at all"), (100, "zz")]
    want = {(d, n, p) for d, n, t in lines if t is not None for p, x in patterns if x is not None and x in t}
    dl = spark.createDataFrame(lines, "doc_id long, line_no int, line string")
    pt = spark.createDataFrame(patterns, "pattern_id long, pattern string")
    for got in (DO.denylist_scan(dl, pt), DO.denylist_scan(dl, pt, max_chars=10), DO.denylist_join(dl, pt)):
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert DO.denylist_join(dl, pt.limit(0)).count() == DO.denylist_scan(dl, pt.limit(0)).count() == 0


def test_the_join_runs_no_python_and_reads_lines_without_a_union(spark):
    df = DO.denylist_join(spark.createDataFrame([(1, 1, "some line of text")], "doc_id long, line_no int, line string").repartition(2),
                          spark.createDataFrame([(1, "line of"), (2, "a longer pattern of text")], "pattern_id long, pattern string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
