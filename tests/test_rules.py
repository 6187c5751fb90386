"""Micro goldens from the reference's own cases and the semantics traps."""

import datetime as dt

from pyspark.sql import functions as F

from vantage.functions import classify as K
from vantage.functions import status as S
from vantage.functions import text as T
from vantage.operators import aggregates as A
from vantage.operators import upsert as U
from vantage.plans import page_jobs as PJ


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).collect()[0].r


def test_liveness_reference_cases(spark):
    rows = [
        (1, 200, "https://x.example/job/1",
         "<html><body><nav><a href='/jobs'>Apply</a></nav><p>This job is no longer available. " + "x" * 400
         + "</p></body></html>"),
        (2, 200, "https://x.example/jobs",
         "<html><body><p>124 jobs found</p><a href='/a'>Apply now</a><p>" + "y " * 200 + "</p></body></html>"),
        (3, 200, "https://x.example/job/3",
         "<html><body><p>Applications are closed</p><a href='/login'>Log in to apply</a></body></html>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, status int, final_url string, html string")
    got = {r.page_id: r.result for r in PJ.liveness(df).collect()}
    assert got == {1: "expired", 2: "active", 3: "expired"}


def test_score_parsers(spark):
    cases = {"4.2/5": (4.2, 4.2, 4.2), "**4.2/5**": (0.0, 4.2, 4.2), "N/A": (0.0, 0.0, 0.0), "DUP": (0.0, 0.0, 0.0),
             "4.2": (4.2, 4.2, 0.0)}
    for raw, (js, loose, strict) in cases.items():
        assert one(spark, T.score_js("v"), raw) == js
        assert one(spark, T.score_loose("v"), raw) == loose
        assert one(spark, T.score_strict("v"), raw) == strict


def test_status_policies(spark):
    assert one(spark, S.status_alias("v"), "Rechazado") == "rejected"
    assert one(spark, S.status_repair("v"), "Rechazado") is None
    assert one(spark, S.status_contains("v"), "monitor") == "evaluated"
    assert one(spark, S.status_alias("v"), "monitor") == "skip"
    assert one(spark, S.status_strict("v"), "repost #12") == "Discarded"
    assert one(spark, S.status_repair("v"), "—") == "Discarded"
    assert one(spark, S.status_alias("v"), "**Aplicado** 2026-03-12") == "applied"
    assert one(spark, S.status_strict("v"), "weird") == "Evaluated"
    assert one(spark, S.status_rank_raw("v"), "**Applied**") == 0


def test_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    assert df.select(A.iso_week(F.col("d"))).collect()[0][0] == "2025-W01"


def test_entry_numbering(spark):
    # max 8; numbers 3, 20, 5 -> 9, 20, 21
    ins = spark.createDataFrame([(1, 3), (2, 20), (3, 5)], "add_order long, num int")
    max0 = spark.createDataFrame([(8,)], "max0 int")
    got = [r.entry_num for r in U.entry_numbers(ins, max0).orderBy("add_order").collect()]
    assert got == [9, 20, 21]


def test_js_whitespace(spark):
    assert one(spark, T.collapse_ws("v"), "  Data　Engineer ﻿") == "Data Engineer"


def test_word_boundary_and_tech(spark):
    assert one(spark, F.col("v").rlike(K.jsre(r"\bgo\b")), "égo") is True  # JS \b is ASCII: é is not a word char
    got = one(spark, K.tech_mentions("v"), "needs C++ and React Native")
    assert got == ["React"]


def test_company_size_policies(spark):
    assert one(spark, K.company_size("v"), "8 engineers, remote") == "enterprise"
    assert one(spark, K.company_size("v", policy="safe"), "8 engineers, remote") == "startup"


def test_merge_first_qualifying_wins(spark):
    existing = spark.createDataFrame(
        [(0, 1, "2024-01-01", "Acme", "Data Platform Engineer", "3.0/5", "Applied", "no", "[1](reports/1.md)", "")],
        "pos long, num int, date string, company string, role string, score_raw string, status_raw string, "
        "pdf string, report string, notes string")
    adds = spark.createDataFrame(
        [(1, 1, "a.tsv", 1, "Acme", "Data Platform Engineer", "4.5/5", "[1](reports/1.md)"),
         (2, 2, "b.tsv", 1, "Acme", "Data Platform Engineer", "4.8/5", "[1](reports/1.md)"),
         (3, 3, "c.tsv", 50, "Other", "Data Platform Engineer", "4.0/5", "[9](reports/9.md)"),
         (4, 4, "d.tsv", 50, "Other", "Data Platform Engineer", "4.0/5", "[9](reports/9.md)")],
        "add_order long, add_id long, file string, num int, company string, role string, score_raw string, report string")
    got = {r.add_id: (r.action, r.entry_num) for r in U.upsert(adds, existing).collect()}
    assert got[1][0] == "update" and got[2][0] == "lost"
    assert got[3] == ("insert", 50) and got[4] == ("insert", 51)
