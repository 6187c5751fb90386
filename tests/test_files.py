"""Path readers round trip, over several files and several splits of one file."""

from vantage.sources import files as FI
from vantage.sources import tracker as TR
from vantage.sources import reports as R


def test_lines_keep_file_and_order(spark, tmp_path):
    want = {}
    for f in range(3):
        lines = [f"line {f} {i} ü" for i in range(700 + f)] + ["", "end"]
        (tmp_path / f"t{f}.md").write_text("\n".join(lines) + "\n")
        want[f"t{f}.md"] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = FI.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.line_no)):
        got.setdefault(r.file, []).append(r.line)
        assert len(got[r.file]) == r.line_no
    assert got == want


def test_tracker_file(spark, tmp_path):
    p = tmp_path / "applications.md"
    p.write_text("# Tracker\n\n| # | Date | Company | Role | Score | Status | PDF | Report | Notes |\n|---|---|---|---|---|---|---|---|---|\n"
                 "| 2 | 2026-01-02 | Acme | Data Engineer | 4.2/5 | Applied | ✅ | [2](reports/2.md) | ok |\n"
                 "| 1 | 2026-01-01 | Beta | Analyst | N/A | SKIP | ❌ |  | |\n")
    rows = TR.src_pipe_table(FI.read_tracker(spark, str(p))).orderBy("pos").collect()
    assert [(r.pos, r.num, r.company, r.report) for r in rows] == [(5, 2, "Acme", "[2](reports/2.md)"), (6, 1, "Beta", "")]


def test_tsv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi"', "a|b"), (2, "ü", None)]
    df = spark.createDataFrame(rows, "id long, name string, notes string")
    df.coalesce(1).write.option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).csv(str(tmp_path / "q"))
    assert sorted(map(tuple, FI.read_tsv(spark, str(tmp_path / "q"), df.schema).collect())) == rows


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "id long, tags array<string>")
    df.write.json(str(tmp_path / "j"))
    assert sorted(map(tuple, FI.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == [(1, ["x", "y"]), (2, [])]
    (tmp_path / "one.json").write_text('{\n "id": 7,\n "tags": ["z"]\n}')
    assert [tuple(r) for r in FI.read_json(spark, str(tmp_path / "one.json"), df.schema, whole=True).collect()] == [(7, ["z"])]


def test_report_files_and_long_headers(spark, tmp_path):
    # A url after the first kilobyte, and characters of several bytes at every place.
    (tmp_path / "1.md").write_text("# R\n" + "é" * 1500 + "\n**URL:** https://x.example.com/1\n**Batch ID:** 12\n**TL;DR:** " + "ñ" * 200 + "\n")
    docs = FI.read_documents(spark, str(tmp_path)).select("path", "text")
    head = R.report_header(docs).collect()[0]
    assert (head.url, head.batch_id) == ("https://x.example.com/1", "12")
    assert R.report_summary(docs).collect()[0].tldr == "ñ" * 200


def test_long_urls_stay_whole(spark):
    from vantage.functions import html as H

    href = "/" + "a" * 1_100_000
    df = spark.createDataFrame([("https://x.example.com/b", href)], "base string, href string")
    got = df.select(H.absolute_url("base", "href").alias("u")).collect()[0].u
    assert got == "https://x.example.com" + href


def test_one_company_one_role_clusters_linearly(spark):
    from vantage.plans import dedup_jobs as DJ
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.col("id").alias("pos"), F.lit("acme").alias("ckey"),
                                       F.array(F.lit("data"), F.lit("pipeline"), F.lit("platform")).alias("tokens"))
    classes = DJ.dedup_classes(rows)
    assert classes.count() == 1 and DJ.dedup_edges(classes).count() == 0
    got = DJ.clusters(rows).agg(F.count(F.lit(1)), F.min("leader"), F.max("leader")).collect()[0]
    assert tuple(got) == (100_000, 0, 0)


LINTS = ["dq_score_format", "dq_metric_lint", "dq_absolute_paths", "dq_banned_phrases", "txt_urls", "cls_risk_phrases", "cls_archetype",
         "dq_document_structure", "src_report_scores", "src_report_fields", "src_report_summary"]


def test_queries_find_something(spark):
    """Every column that can vary has at least two values on the smallest tables."""
    import __spark_entry__ as E

    fixed = {"check", "severity"}
    for name in LINTS:
        rows = E.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
        assert len(rows) > 1, name
        for c in rows.columns:
            assert c in fixed or rows[c].nunique(dropna=False) > 1, (name, c)
