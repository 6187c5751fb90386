"""A sample of registered jobs against their DuckDB oracles on sf0.001 (the driver runs all of them at sf0.01)."""

import pytest

from tools.check import digest

SAMPLE = ["agg_cumulative_funnel", "src_pipe_table", "cls_status_repair", "agg_score_by_outcome", "src_report_gaps",
          "agg_breakdown_size", "upsert_tracker", "ddp_offers_two_key", "flt_posting_reason", "win_queue_ids",
          "src_html_anchors", "cls_liveness", "dq_denylist_scan", "src_jd_document", "stm_queue_state", "upsert_inbox", "ddp_tracker_keep"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_a_schema(spark):
    import __spark_entry__ as E

    assert len(E.queries()) >= 160
    assert set(E.oracle_sql()) <= set(E.queries())


def test_duckdb_plans_every_oracle(duck):
    import __spark_entry__ as E

    for name, sql in E.oracle_sql().items():
        try:
            duck.execute("EXPLAIN " + sql).fetchall()
        except Exception as e:  # noqa: BLE001
            pytest.fail(f"{name}: {e}")
