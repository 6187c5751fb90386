"""A history that nothing was appended to is read back empty."""

from pyspark.sql import functions as F

from vantage.operators import sinks as SK


def test_history_without_offers_is_read_back_empty(spark):
    path = SK.scratch_dir(spark, "history")
    rows = spark.createDataFrame([("u", "c", "t", "2024-01-11")], "url string, company string, title string, first_seen string")
    rows = rows.withColumn("first_seen", F.col("first_seen").cast("date"))
    SK.append_history(rows.where("url = 'none'"), path)
    back = SK.read_history(spark, path, rows.schema)
    assert back.columns == rows.columns and back.count() == 0
    SK.append_history(rows, path)
    assert SK.read_history(spark, path, rows.schema).collect() == rows.collect()


def test_history_append_job_without_new_offers(spark, tmp_path):
    from vantage.plans import QUERIES

    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{src}/events.parquet").where("ts < timestamp '2024-01-11'").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["snk_history_append"](spark, str(tmp_path)).count() == 0
