"""Structured Streaming: continuous offer ingest and the queue state table.

Both sinks are tables of hash buckets, ``bucket=<b>/v=<batch>``, that a micro-batch reads and writes only
where its keys fall:

* ``offer_ingest`` - offers arrive as files; title filter, then an anti-join with the history and with what
  earlier batches accepted, so a repeat is found however late it comes and no late row is dropped.
* ``queue_state`` - state-change events arrive as files; a batch rewrites the buckets it touches, as new
  versions, and leaves the others as they are.

A batch writes its own versions by dynamic partition overwrite and reads only older ones: run again, it
writes the same rows to the same places.  A marker tells readers that a batch is complete.  Both run with
``trigger(availableNow=True)`` and a checkpoint location in the shared checkpoint folder, so a restart
resumes from the committed offsets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import title_predicate
from ..operators.scan import first_by_key, normalized
from ..session import cut_table

BUCKETS = 64


def offer_stream(spark: SparkSession, src_dir: str, file_glob: str, schema, to_offers, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return to_offers(reader.parquet(src_dir))


class BucketTable:
    """A table of hash buckets whose versions are written by micro-batches.

    ``n`` buckets bound what the driver lists: a version or two each.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = BUCKETS):
        self.spark, self.path, self.n = spark, path.rstrip("/"), n
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.n)).cast("int")

    def versions(self) -> dict[int, list[int]]:
        """bucket -> its versions, ascending."""
        out: dict[int, list[int]] = {}
        for s in self._fs.globStatus(self._at(f"{self.path}/bucket=*/v=*")) or []:
            p = s.getPath()
            out.setdefault(int(p.getParent().getName().split("=")[1]), []).append(int(p.getName().split("=")[1]))
        return {b: sorted(v) for b, v in out.items()}

    def committed(self) -> int:
        """The last complete batch, -1 before any."""
        found = self._fs.globStatus(self._at(f"{self.path}/_batches/*")) or []
        return max((int(s.getPath().getName()) for s in found), default=-1)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

    def read(self, schema, buckets: Iterable[int] | None, below: int, newest: bool) -> DataFrame:
        """Rows of the given buckets (None: all) in versions under ``below``: the newest each, or all of them."""
        have = self.versions()
        paths = []
        for b in have if buckets is None else buckets:
            old = [v for v in have.get(b, []) if v < below]
            paths += [f"{self.path}/bucket={b}/v={v}" for v in (old[-1:] if newest else old)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Write the buckets of ``rows`` as version ``batch``; other buckets and versions stay."""
        (rows.withColumn("v", F.lit(batch)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "v").parquet(self.path))
        self._fs.create(self._at(f"{self.path}/_batches/{batch}"), True).close()

    def drop_replaced(self, batch: int) -> None:
        """Delete versions that a batch before ``batch`` replaced; those it needs to run again stay."""
        for b, vs in self.versions().items():
            for v in [v for v in vs if v < batch][:-1]:
                self._fs.delete(self._at(f"{self.path}/bucket={b}/v={v}"), True)


OFFER_COLUMNS = "url string, company string, title string, event_time timestamp, pos long"


def accept_batch(table: BucketTable, offers: DataFrame, history: DataFrame, positive, negative, batch: int) -> None:
    """Append the batch's offers that pass the title filter and whose url neither history nor an earlier batch has.

    Of several with one url in a batch the first by ``pos`` is accepted.
    """
    o = normalized(offers).where(title_predicate(F.col("title"), positive, negative) & (F.col("url") != ""))
    o = cut_table(o.select("url", "company", "title", F.col("ts").cast("timestamp").alias("event_time"), F.col("pos").cast("long").alias("pos"))
                  .withColumn("bucket", table.bucket("url")))
    earlier = table.read(OFFER_COLUMNS, table.touched(o), batch, newest=False).select("url")
    fresh = o.join(history.select("url").distinct(), "url", "left_anti").join(earlier, "url", "left_anti")
    table.write(first_by_key(fresh, "url"), batch)


def offer_ingest(stream: DataFrame, history: DataFrame, positive, negative, out_dir: str, ckpt_dir: str) -> BucketTable:
    table = BucketTable(stream.sparkSession, out_dir)
    q = (stream.writeStream.foreachBatch(lambda rows, batch: accept_batch(table, rows, history, positive, negative, batch))
         .option("checkpointLocation", ckpt_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def accepted_offers(table: BucketTable) -> DataFrame:
    return table.read(OFFER_COLUMNS, None, table.committed() + 1, newest=False)


STATE_COLUMNS = "id long, s struct<status:string,report_num:string,score:double,retries:int>, first_seq long, last_seq long"


def state_changes(batch: DataFrame) -> DataFrame:
    """Per id: the state at its last sequence number, plus first and last sequence."""
    return batch.groupBy("id").agg(
        F.max_by(F.struct("status", "report_num", "score", "retries"), F.col("seq")).alias("s"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def merge_states(table: BucketTable, changes: DataFrame, batch: int) -> list[int]:
    """Merge a batch of state changes into the buckets its ids fall into; returns these buckets."""
    table.drop_replaced(batch)
    new = cut_table(state_changes(changes).withColumn("bucket", table.bucket("id")))
    buckets = table.touched(new)
    old = table.read(STATE_COLUMNS, buckets, batch, newest=True).withColumn("bucket", table.bucket("id"))
    table.write(old.unionByName(new).groupBy("bucket", "id").agg(
        F.max_by("s", "last_seq").alias("s"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")), batch)
    return buckets


def queue_state(events: DataFrame, table_dir: str, ckpt_dir: str) -> BucketTable:
    """Keep the latest state of every id; each micro-batch rewrites the buckets it touches."""
    table = BucketTable(events.sparkSession, table_dir)
    q = (events.writeStream.foreachBatch(lambda rows, batch: merge_states(table, rows, batch)).option("checkpointLocation", ckpt_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def current_states(table: BucketTable) -> DataFrame:
    """The newest complete version of every bucket, found by listing directories."""
    return table.read(STATE_COLUMNS, None, table.committed() + 1, newest=True)
