"""Joins of written tables: long ones are not broadcast, however well they compress."""

from pyspark.sql import functions as F

from vantage.session import MERGE_ROWS, cut_table


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_written_tables_are_not_broadcast(spark):
    rows = spark.range(2 * MERGE_ROWS).select((F.col("id") % 7).alias("k"), F.lit("same text").alias("v"))
    left, right = cut_table(rows), cut_table(rows.select("k", "v"))
    joined = left.join(right.withColumnRenamed("v", "w"), "k", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
    plan = _plan(joined)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sum(r.n for r in joined.collect()) == 2 * MERGE_ROWS


def test_empty_and_short_written_tables(spark):
    assert cut_table(spark.range(0).select("id")).count() == 0
    short = cut_table(spark.range(5).select("id"))
    assert sorted(r.id for r in short.join(short, "id").collect()) == [0, 1, 2, 3, 4]
