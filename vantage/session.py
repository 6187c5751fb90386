"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "vantage") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (executors of a cluster need it installed there)."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master may get a scratch one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    path = tempfile.mkdtemp(prefix="vantage-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def once(value: Column) -> Column:
    """``value`` as the one row of a generator, for a ``select``.

    The optimiser copies a projected expression into every filter above it and works it out again at each mention;
    filters stay above a generator, so they read the value it made.
    """
    return F.explode(F.array(value))


#: Written tables with more rows than this are joined by merging, never broadcast.
MERGE_ROWS = 100_000


def cut_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back: lineage ends at those files.

    Spark takes the size of a table from its compressed files, where repetitive rows shrink a hundredfold, and
    would send millions of them through the driver as a broadcast; so joins of a longer table are told to merge.
    """
    path, rows = scratch_path(df.sparkSession), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written.hint("merge") if rows.get["rows"] > MERGE_ROWS else written
