"""A row's text is rendered and taken apart once, however many filters and columns read it: counted in the optimised plan."""

import pytest
from pyspark.sql import functions as F

from vantage.functions import status as S
from vantage.operators import quality as DQ
from vantage.operators import upsert as U
from vantage.plans import dedup_jobs, doc_jobs, extra_jobs, merge_jobs, queue_jobs, report_jobs, tracker_jobs
from vantage.sources import additions as AD
from vantage.sources import reports as R
from vantage.sources import tracker as TR

TRACKER = "pos long, num int, date string, company string, role string, score_raw string, status_raw string, pdf string, report string, notes string"
ROW = (1, 2, "2001-01-01", "Acme", "Data Developer", "4.0/5", "Applied", "yes", "[2](reports/2.md)", "n")
REPORT = "| Gap | Severity | Mitigation |\n|--|--|--|\n| visa required | Hard | none |\n| Go | Nice to have | course |\n"


def mentions(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


@pytest.fixture
def trk(spark, tmp_path):
    spark.createDataFrame([ROW, (*ROW[:7], "no", "", "")], TRACKER).write.parquet(str(tmp_path / "trk"))
    return spark.read.parquet(str(tmp_path / "trk"))


def test_tracker_line_is_rendered_and_split_once(trk):
    apps = TR.tracker_from_fixture(trk).withColumn("status", S.status_alias("status_raw")).where("status = 'applied'")
    assert mentions(apps, "concat_ws") == 1 and mentions(apps, "split(") == 1
    assert apps.count() == 2


def test_merge_view_and_mixed_reader_render_once(trk):
    seen = TR.src_pipe_table(U.merge_view(TR.render_tracker(trk)), "nonzero")
    assert mentions(seen, "concat_ws") == 1 and seen.count() == 2
    mixed = TR.src_pipe_table_mixed(TR.render_tracker(trk), False)
    assert mentions(mixed, "concat_ws") == 1
    assert [r.has_pdf for r in mixed.collect()] == [True, False]


def test_followup_line_is_rendered_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, "2001-01-01", "Acme", "Data", "R", "O", "x")],
                          "num int, app_num int, date string, company string, role string, channel string, contact string, notes string").write.parquet(str(tmp_path / "fol"))
    rows = TR.src_followups(TR.render_followups(spark.read.parquet(str(tmp_path / "fol"))))
    assert mentions(rows, "concat_ws") == 1 and mentions(rows, "split(") == 1
    assert [(r.num, r.app_num, r.notes) for r in rows.collect()] == [(1, 2, "x")]


def test_additions_are_split_once_and_keep_both_layouts(spark, tmp_path):
    lines = ["| 3 | d | Acme | Dev | 4/5 | Applied | no | r | n |", "4\td\tAcme\tDev\t4/5\tApplied\tno\tr", "0\td\tAcme\tDev\tApplied\t4/5\tno\tr", "5\tshort", " "]
    spark.createDataFrame(list(enumerate(lines)), "file_no int, line string").withColumn("file", F.lit("f")).write.parquet(str(tmp_path / "adds"))
    rows = AD.src_additions(spark.read.parquet(str(tmp_path / "adds")))
    assert mentions(rows, "split(_l") == 2  # one by pipes, one by tabs
    assert sorted((r.num, r.score_raw, r.status, r.notes) for r in rows.collect()) == [(3, "4/5", "Applied", "n"), (4, "4/5", "Applied", "")]


def test_gap_block_is_searched_once(spark, tmp_path):
    spark.createDataFrame([("a", REPORT), ("b", "none"), ("c", None)], "path string, text string").write.parquet(str(tmp_path / "rep"))
    gaps = R.report_gaps(spark.read.parquet(str(tmp_path / "rep")))
    assert mentions(gaps, "Severity") == 1
    assert [(r.path, r.gap_idx, r.description, r.severity) for r in gaps.orderBy("gap_idx").collect()] == [("a", 0, "visa required", "hard"), ("a", 1, "Go", "nice to have")]


def test_blocker_rules_run_once_a_gap(spark, trk, monkeypatch):
    monkeypatch.setattr(report_jobs, "gap_rows", lambda s, d: s.createDataFrame([("visa required", "hard"), ("Go", "nice")], "description string, severity string"))
    monkeypatch.setattr(report_jobs, "script_apps", lambda s, d, *a: trk)
    found = report_jobs._blockers(spark, "")
    assert mentions(found, "contains(lower(severity") <= 1 and mentions(found, "explode(array(CASE") == 1
    assert [(r.frequency, r.percentage) for r in found.collect()] == [(1, 50)]


def test_damaged_lines_are_rendered_once(spark, trk, monkeypatch):
    monkeypatch.setattr(tracker_jobs, "view", lambda *a: trk)
    rows = DQ.dq_row_format(tracker_jobs._damaged_lines(spark, ""))
    assert mentions(rows, "concat_ws") == 2  # the short and the full form


def test_archetype_words_are_counted_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "React and REACT on Vue, uir"), (2, "quick"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(doc_jobs, "docs", lambda *a: spark.read.parquet(str(tmp_path / "docs")))
    votes = doc_jobs.cls_archetype(spark, "")
    assert mentions(votes, "regexp_extract_all") <= 6 and mentions(votes, "lower(text") == 1
    assert [(r.rank, r.archetype, r.votes) for r in votes.where("doc_id = 1").orderBy("rank").collect()] == [
        (1, "Frontend Product Engineer", 3), (2, "Full-stack Web Engineer", 0)]
    assert [r.votes for r in votes.where("doc_id = 2").collect()] == [0, 0]


def test_cards_are_cut_once(spark, tmp_path, monkeypatch):
    card = "<a class='jobTitle' href='/companies/c/jobs/1'>Dev</a><a class='companyName'>Acme</a>"
    spark.createDataFrame([(1, "https://x.example/l", card), (1, "https://x.example/l", card), (2, "https://x.example/l", "<p>none</p>"), (3, None, card), (4, "https://x.example/l", None)],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages")).withColumn("html", F.concat("html", F.lit("<br>")))
    plans = []
    monkeypatch.setattr(extra_jobs, "cut_table", lambda df, cut=extra_jobs.cut_table: (plans.append(df), cut(df))[1])
    rows = extra_jobs.html_cards(pages).collect()
    assert [(r.page_id, r.title, r.company) for r in rows] == [(1, "Dev", "Acme")] * 2
    assert mentions(plans[0], "<br>") == 1


def test_report_headers_and_queue_notes_are_rendered_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a", "**URL:** https://x.example/1\n**Batch ID:** 7\n")], "path string, text string").write.parquet(str(tmp_path / "rep"))
    head = R.report_header(spark.read.parquet(str(tmp_path / "rep")).withColumn("text", F.concat("text", F.lit("<end>"))))
    assert mentions(head, "<end>") == 1 and [tuple(r) for r in head.collect()] == [("a", "https://x.example/1", "7")]
    spark.createDataFrame([(1, "https://x.example/1", "Dev @ Acme Inc"), (2, "", "Dev @ Acme"), (3, "https://x.example/3", None)], "id long, url string, notes string").write.parquet(str(tmp_path / "q"))
    monkeypatch.setattr(queue_jobs, "inputs", lambda *a: spark.read.parquet(str(tmp_path / "q")).withColumn("notes", F.concat("notes", F.lit(" | 8%"))))
    found = queue_jobs.queue_candidates_by_company(spark, "")
    assert mentions(found, " | 8%") == 1
    assert [tuple(r) for r in found.collect()] == [("acme", "Dev", "https://x.example/1", 1)]


def test_keep_plan_joins_rows_to_leaders_once(spark, monkeypatch):
    cut = []
    monkeypatch.setattr(dedup_jobs, "cut_table", lambda df, make=dedup_jobs.cut_table: (cut.append(df.columns), make(df))[1])
    rows = spark.createDataFrame([(1, "3/5", "Applied"), (2, "4/5", "Evaluated")], "pos long, score_raw string, status_raw string").withColumn("tokens", F.array(F.lit("x")))
    plan = dedup_jobs.keep_plan(rows, spark.createDataFrame([(1, 1), (2, 1)], "pos long, leader long"))
    assert cut == [["pos", "leader", "status_raw", "score", "rank"]]
    assert sorted((r.pos, r.keeper, r.action, r.status) for r in plan.collect()) == [(1, 2, "remove", None), (2, 2, "keep", "Applied")]


def test_additions_rank_their_order_keys_alone(spark, tmp_path, monkeypatch):
    ranked = []
    monkeypatch.setattr(merge_jobs, "row_number_global", lambda df, *a, make=merge_jobs.row_number_global: (ranked.append(df.columns), make(df, *a))[1])
    rows = [(n, f"{n}-x.tsv", f"{n}\td\tAcme\tDev\tApplied\t4/5\tno\tr") for n in (30, 4, 200)]
    spark.createDataFrame(rows, "file_no long, file string, line string").write.parquet(str(tmp_path / "adds"))
    monkeypatch.setattr(merge_jobs, "view", lambda *a: spark.read.parquet(str(tmp_path / "adds")))
    got = merge_jobs.additions(spark, "").orderBy("add_order").collect()
    assert ranked == [["_row", "_k", "file"]] and [(r.num, r.add_order) for r in got] == [(4, 1), (30, 2), (200, 3)]
