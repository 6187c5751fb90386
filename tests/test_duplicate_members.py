from tests.conftest import SF001
from tools.check import digest
from vantage.operators import quality as DQ


def test_members_between_the_ends_are_given(spark):
    rows = [(1, "Acme", "Data Engineer"), (4, "ACME!", "data engineer"), (3, "Other", "Data Engineer"), (9, "acme", "Data Engineer"), (9, "Acme", "Data-Engineer")]
    apps = spark.createDataFrame(rows, "num int, company string, role string")
    assert sorted(tuple(r) for r in DQ.duplicate_members(apps).collect()) == [("acme::data engineer", n) for n in (1, 4, 9)]
    assert [r.detail for r in DQ.dq_duplicates(apps).collect()] == ["3 rows, #1 to #9"]


def test_matches_oracle(spark, duck):
    import __spark_entry__ as E

    df = E.queries()["dq_duplicate_members"](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()["dq_duplicate_members"])
    cols = [d[0] for d in cur.description]
    assert rows and digest(df.columns, rows)[0] == digest(cols, cur.fetchall())[0]
    # The groups and their sizes are those of the findings.
    sizes = {r.key: int(r.detail.split(" ")[0]) for r in E.queries()["dq_duplicates"](spark, SF001).collect()}
    keys = [r[df.columns.index("dup_key")] for r in rows]
    assert {k: keys.count(k) for k in set(keys)} == sizes
