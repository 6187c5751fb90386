"""As-of join against a sequential model, and the labels it gives."""

import datetime as dt
import random

from vantage.operators.asof import latest_before


def test_latest_before(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    keys = ["hot", "hot", "hot", "a", "b", None]
    rows = [(i, rng.choice(keys), t0 + dt.timedelta(hours=rng.randrange(60)) if rng.random() > 0.02 else None) for i in range(800)]
    events = [(i, rng.choice([*keys, "c"]), t0 + dt.timedelta(hours=rng.randrange(60)), rng.choice(["x", "y", "z"])) for i in range(900)]
    r = spark.createDataFrame(rows, "pos long, url string, ts timestamp")
    e = spark.createDataFrame(events, "check_id long, url string, checked_at timestamp, result string")
    got = {x.pos: x.result for x in latest_before(r, e, "url", "ts", "pos", "checked_at", "check_id", "result").collect()}
    want = {}
    for i, key, at in rows:
        before = [(t, c, v) for c, k, t, v in events if key is not None and k == key and at is not None and t <= at]
        want[i] = max(before)[2] if before else None
    assert got == want and None in got.values() and len(set(got.values())) == 4
    none = latest_before(r, e.limit(0), "url", "ts", "pos", "checked_at", "check_id", "result").collect()
    assert len(none) == len(rows) and {x.result for x in none} == {None}


def test_all_labels_of_offers_occur(spark):
    import __spark_entry__ as E

    labels = {x.disposition for x in E.queries()["flt_disposition"](spark, "/root/testdata/sf0.001").select("disposition").distinct().collect()}
    assert labels >= {"added", "skipped_title", "skipped_dup", "skipped_expired", "failed"}
