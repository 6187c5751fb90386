"""Fixtures exercise the rules: no column of these results is constant."""

import pytest

NAMES = ["agg_ats_replacements", "join_company_lookup", "src_site_profile", "src_followups", "src_checklist", "src_state_tsv", "src_additions",
         "upsert_tracker", "join_queue_notes", "src_posting_payload", "src_experiences", "src_ats_greenhouse", "src_ats_ashby", "src_ats_lever",
         "agg_tech_gaps", "flt_disposition", "join_job_url", "upsert_status_log", "txt_company_key_safe"]
#: One file, one spelling of a default, one change kind: constant by their meaning.
SAME = {"src_checklist": {"file"}, "upsert_status_log": {"change", "column"}, "src_experiences": set()}


@pytest.mark.parametrize("name", NAMES)
def test_columns_take_two_values(duck, name):
    import __spark_entry__ as E

    sql = E.oracle_sql()[name]
    columns = [d[0] for d in duck.execute(f"SELECT * FROM ({sql}) LIMIT 0").description]
    counts = duck.execute("SELECT " + ", ".join(f'count(DISTINCT coalesce(CAST("{c}" AS VARCHAR), chr(0)))' for c in columns) + f" FROM ({sql})").fetchone()
    assert {c for c, n in zip(columns, counts, strict=True) if n < 2} <= SAME.get(name, set())


def test_typography_is_replaced(spark):
    import __spark_entry__ as E
    from pyspark.sql import functions as F

    from vantage.functions import html as H
    from vantage.sources.bindings import view

    pages = view(spark, "/root/testdata/sf0.001", "typed_pages")
    assert pages.where(H.ats_normalize("html") != F.col("html")).count() >= pages.count() - 1  # page 0 has none
    assert E.queries()["txt_ats_normalize"](spark, "/root/testdata/sf0.001").count() == pages.count()
