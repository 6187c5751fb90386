"""Ordered running computations without a single-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task.  These helpers range-partition by the order key instead, compute the
running value inside each range partition, prefix-combine the tiny
per-partition summary (at most one row per partition), and add the carry-in
back with a broadcast join whose size is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_table

_PID = "_vx_pid"


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(
    df: DataFrame,
    order_cols: list[str],
    outputs: list[tuple[str, Column, str]],
    partition_cols: list[str] | None = None,
    n: int | None = None,
) -> DataFrame:
    """Add running aggregates in the total order ``order_cols``.

    ``outputs`` holds ``(name, value, kind)`` with kind ``sum``, ``max`` or
    ``last`` (last non-null value so far).  ``order_cols`` must be unique
    within ``partition_cols`` for a deterministic result.
    """
    part = list(partition_cols or [])
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [F.col(c) for c in part] + order_cols
    # Range bounds come from a sample of the input, and a shuffled input can arrive in a
    # different row order on each evaluation; partition ids are materialised once so the
    # local scan and the partition summary below read the same assignment.
    ranged = cut_table(df.repartitionByRange(_num_partitions(df, n), *keys)
                         .withColumn(_PID, F.spark_partition_id()))
    local_w = (Window.partitionBy(_PID, *part).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cols = []
    summary_aggs = []
    order_struct = F.struct(*order_cols)  # ``last`` needs ascending order columns
    for name, value, kind in outputs:
        v = f"_vx_v_{name}"
        ranged = ranged.withColumn(v, value)
        if kind == "sum":
            cols.append(F.sum(v).over(local_w).alias(f"_vx_l_{name}"))
            summary_aggs.append(F.sum(v).alias(f"_vx_s_{name}"))
        elif kind == "max":
            cols.append(F.max(v).over(local_w).alias(f"_vx_l_{name}"))
            summary_aggs.append(F.max(v).alias(f"_vx_s_{name}"))
        elif kind == "last":
            cols.append(F.last(v, ignorenulls=True).over(local_w).alias(f"_vx_l_{name}"))
            summary_aggs.append(
                F.max_by(F.col(v), F.when(F.col(v).isNotNull(), order_struct)).alias(f"_vx_s_{name}"))
        else:
            raise ValueError(kind)
    local = ranged.select("*", *cols)
    summary = local.groupBy(_PID, *part).agg(*summary_aggs)
    carry_w = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for name, _, kind in outputs:
        s = F.col(f"_vx_s_{name}")
        if kind == "sum":
            carry_cols.append(F.sum(s).over(carry_w).alias(f"_vx_c_{name}"))
        elif kind == "max":
            carry_cols.append(F.max(s).over(carry_w).alias(f"_vx_c_{name}"))
        else:
            carry_cols.append(F.last(s, ignorenulls=True).over(carry_w).alias(f"_vx_c_{name}"))
    carry = summary.select(_PID, *part, *carry_cols)
    # One summary row per range partition (times partition keys present in it).
    if not part:
        carry = F.broadcast(carry)
    joined = local.join(carry, [_PID, *part], "left")
    out_cols = []
    for name, _, kind in outputs:
        lo, ca = F.col(f"_vx_l_{name}"), F.col(f"_vx_c_{name}")
        if kind == "sum":
            out_cols.append((lo + F.coalesce(ca, F.lit(0))).alias(name))
        elif kind == "max":
            out_cols.append(F.greatest(lo, ca).alias(name))
        else:
            out_cols.append(F.coalesce(lo, ca).alias(name))
    keep = [c for c in df.columns]
    return joined.select(*[F.col(c) for c in keep], *out_cols)


def row_number_global(df: DataFrame, order_cols: list[str], name: str = "rn",
                      partition_cols: list[str] | None = None) -> DataFrame:
    """1-based position in the order (per ``partition_cols`` if given)."""
    return running(df, order_cols, [(name, F.lit(1).cast("long"), "sum")], partition_cols)
