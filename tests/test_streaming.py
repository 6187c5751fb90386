"""Bucketed streaming sinks: touched buckets only, batches that run again, repeats and late rows."""

import datetime as dt
import random

from vantage.streaming import ingest as ST

QST = "seq long, id long, status string, report_num string, score double, retries int"
OFF = "pos long, ts timestamp, url string, company string, title string"


def states(spark, rows):
    return spark.createDataFrame(rows, QST)


def latest(rows):
    out = {}
    for seq, i, status, *_ in rows:
        if i not in out or seq > out[i][0]:
            out[i] = (seq, status)
    return {i: s for i, (_, s) in out.items()}


def current(table):
    return {r.id: r.s.status for r in ST.current_states(table).collect()}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    rng = random.Random(1)
    table = ST.BucketTable(spark, str(tmp_path / "state"), n=16)
    first = [(s, rng.randrange(300), rng.choice(["pending", "failed"]), str(s), 1.0, 0) for s in range(900)]
    assert current(table) == {}
    assert len(ST.merge_states(table, states(spark, first), 0)) == 16
    second = [(1000 + k, i, "completed", "7", 4.0, 1) for k, i in enumerate((3, 5, 3))] + [(-1, 7, "skipped", "1", None, 0)]
    touched = ST.merge_states(table, states(spark, second), 1)
    assert 1 <= len(touched) <= 3 and current(table) == latest(first + second)
    assert {b: v for b, v in table.versions().items() if 1 in v} == {b: [0, 1] for b in touched}
    before = table.versions()
    assert ST.merge_states(table, states(spark, second), 1) == touched  # the same batch again
    assert table.versions() == before and current(table) == latest(first + second)
    third = [(2000, 3, "failed", "8", None, 2)]
    (only,) = ST.merge_states(table, states(spark, third), 2)
    assert table.versions() == {b: [1, 2] if b == only else [1] if b in touched else [0] for b in range(16)}
    assert current(table) == latest(first + second + third)


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    table = ST.BucketTable(spark, str(tmp_path / "state"), n=4)
    ST.merge_states(table, states(spark, [(1, 1, "pending", "1", None, 0)]), 0)
    half = ST.state_changes(states(spark, [(2, 1, "completed", "1", None, 0)])).withColumn("bucket", table.bucket("id"))
    half.selectExpr("*", "1 as v").write.mode("append").partitionBy("bucket", "v").parquet(table.path)
    assert current(table) == {1: "pending"}
    ST.merge_states(table, states(spark, [(2, 1, "failed", "1", None, 0)]), 1)
    assert current(table) == {1: "failed"}


def test_repeats_and_late_rows_of_a_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    batches = [
        [(1, t0, "u1", "A", "Engineer"), (2, t0, "u2", "A", "Engineer"), (3, t0, "u2", "B", "Engineer II"), (4, t0, "old", "A", "Engineer")],
        [(5, t0 + dt.timedelta(days=40), "u1", "A", "Engineer again"), (6, t0 + dt.timedelta(days=40), "u3", "C", "Engineer"),
         (7, t0 + dt.timedelta(days=40), "u4", "C", "Cook")],
        [(8, t0, " u5 ", "D", "Engineer  late"), (9, t0 - dt.timedelta(days=90), "u3", "C", "Engineer")],
    ]
    src = tmp_path / "src"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OFF).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        src.mkdir(exist_ok=True)
        (part,) = (tmp_path / f"b{i}").glob("*.parquet")
        target = src / f"{i}.parquet"
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + 60 * i,) * 2)  # files are taken in the order of their times
    history = spark.createDataFrame([("old",)], "url string")
    stream = ST.offer_stream(spark, str(src), "*.parquet", OFF, lambda raw: raw, files_per_batch=1)
    table = ST.offer_ingest(stream, history, ["engineer"], [], str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert table.committed() == 2
    got = sorted((r.pos, r.url, r.company, r.title, r.event_time) for r in ST.accepted_offers(table).collect())
    assert got == [(1, "u1", "A", "Engineer", t0), (2, "u2", "A", "Engineer", t0), (6, "u3", "C", "Engineer", t0 + dt.timedelta(days=40)),
                   (8, "u5", "D", "Engineer late", t0)]
    ST.accept_batch(table, spark.createDataFrame(batches[1], OFF), history, ["engineer"], [], 1)  # run again
    assert sorted(r.pos for r in ST.accepted_offers(table).collect()) == [1, 2, 6, 8]
