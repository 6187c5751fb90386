"""Running values along very long ordered groups, without a task that holds a group.

Rows are range-partitioned by (group, order), so a group of any size is cut into ranges.  A task streams
over its sorted range; what it needs from the ranges before is one row per range, combined on the driver
(their number is that of the partitions).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, shuffle_width

_MASK = (1 << 64) - 1


class Hash(NamedTuple):
    """Running polynomial hash, modulo 2^64: sum of ``column`` at place p (from 0) times ``base`` ^ p."""

    column: str
    base: int


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _u64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _local(group: str, sums: list[str], hashes: list[Hash], columns: list[str]):
    """Running values inside one range; ``edge`` marks its first (1) and last (2) row (3: both)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        open_, held = None, None  # (group, rows, running values) so far; the batch that waits for its successor
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group).to_numpy()
            new = np.concatenate(([True], g[1:] != g[:-1]))
            starts = np.flatnonzero(new)
            seg = np.cumsum(new) - 1
            goes_on = open_ is not None and open_[0] == g[0]
            before = open_[1] if goes_on else 0
            at = np.arange(n) - starts[seg]
            place = at + np.where(seg == 0, before, 0)
            values = []
            for i, item in enumerate([*sums, *hashes]):
                if isinstance(item, Hash):
                    x = _u64(batch.column(item.column)) * _powers(item.base, n)[at]
                    if before:
                        x[seg == 0] *= np.uint64(pow(item.base, before, 1 << 64))
                else:
                    x = _u64(batch.column(item))
                total = np.cumsum(x, dtype=np.uint64)
                own = total - (total[starts] - x[starts])[seg]
                if goes_on:
                    own[seg == 0] += np.uint64(open_[2][i])
                values.append(own)
            last = np.concatenate((g[1:] != g[:-1], [False]))
            edge = np.zeros(n, np.int8)
            if held is None:
                edge[0] = 1
            else:
                held[2][-1] = held[0][-1] != g[0]
                yield _batch(held, part, columns)
            held = [g, batch, last, edge, place, values]
            open_ = (g[-1], int(place[-1]) + 1, [int(v[-1]) for v in values])
        if held is not None:
            held[2][-1] = True
            held[3][-1] += 2
            yield _batch(held, part, columns)

    return run


def _batch(held: list, part: int, columns: list[str]) -> pa.RecordBatch:
    _, batch, last, edge, place, values = held
    return pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge),
                            pa.array(place.astype(np.int64)), pa.array(last), *(pa.array(v.view(np.int64)) for v in values)], names=columns)


def _carries(edges: list, group: str, names: list[str], hashes: dict[str, Hash]) -> dict[int, tuple]:
    """range -> (group that goes on into it, its rows before, its running values before, last row is a group's last)."""
    firsts = {r["_part"]: r[group] for r in edges if r["_edge"] & 1}
    ends = {r["_part"]: r for r in edges if r["_edge"] & 2}
    out, open_ = {}, None
    order = sorted(firsts)
    for part, after in zip(order, [*order[1:], None], strict=False):
        end = ends[part]
        goes_on = open_ is not None and open_[0] == firsts[part]
        carry = (open_[1], open_[2]) if goes_on else (0, [0] * len(names))
        out[part] = (firsts[part], *carry, after is None or firsts[after] != end[group])
        same = goes_on and end[group] == firsts[part]
        own = [end[n] for n in names]
        if same:
            own = [c + (v * pow(hashes[n].base, carry[0], 1 << 64) if n in hashes else v) for n, c, v in zip(names, carry[1], own, strict=True)]
        open_ = (end[group], end["place"] + 1 + (carry[0] if same else 0), [v & _MASK for v in own])
    return out


def scan(rows: DataFrame, group: str, order: list[Column | str], sums: dict[str, str] | None = None,
         hashes: dict[str, Hash] | None = None) -> DataFrame:
    """``rows`` with ``place`` (long, from 0), ``last`` (boolean) and the named running values in its group.

    ``group`` is a long column without nulls, ``order`` decides all places or leaves only rows equal in
    every column tied.  ``sums`` and ``hashes`` name running sums and hashes of long columns without
    nulls, the row itself included.  Rows come back in order within each task.  The names ``_part`` and
    ``_edge`` are used inside; columns of ``rows`` may not have them.
    """
    sums, hashes = dict(sums or {}), dict(hashes or {})
    names = [*sums, *hashes]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    columns = [*rows.columns, "_part", "_edge", "place", "last", *names]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "_part int", "_edge byte", "place long",
                        "last boolean", *(f"`{n}` long" for n in names)])
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    local = materialise(ranged.mapInArrow(_local(group, list(sums.values()), list(hashes.values()), columns), fields))
    edges = local.where("_edge > 0").select("_part", "_edge", group, "place", *names).collect()
    carries = _carries(edges, group, names, hashes)
    width = max(carries, default=0) + 1
    first = np.zeros(width, np.int64)
    before = np.zeros(width, np.int64)
    ends = np.zeros(width, bool)
    value = {n: np.zeros(width, np.uint64) for n in names}
    power = {n: np.ones(width, np.uint64) for n in hashes}
    for part, (g, k, own, end) in carries.items():
        first[part], before[part], ends[part] = g, k, end
        for n, v in zip(names, own, strict=True):
            value[n][part] = v
            if n in hashes:
                power[n][part] = pow(hashes[n].base, k, 1 << 64)
    kept = [f.name for f in rows.schema.fields]

    def settle(batches):
        for batch in batches:
            part, edge = batch.column("_part").to_numpy(), batch.column("_edge").to_numpy()
            on = (batch.column(group).to_numpy() == first[part]) & (before[part] > 0)
            last = batch.column("last").to_numpy(zero_copy_only=False)
            out = [batch.column(n) for n in kept]
            out += [pa.array(batch.column("place").to_numpy() + np.where(on, before[part], 0)), pa.array(np.where(edge & 2 > 0, ends[part], last))]
            for n in names:
                v = _u64(batch.column(n))
                moved = (v * power[n][part] if n in hashes else v) + value[n][part]
                out.append(pa.array(np.where(on, moved, v).view(np.int64)))
            yield pa.record_batch(out, names=[*kept, "place", "last", *names])

    return local.mapInArrow(settle, ", ".join(f for f in fields.split(", ") if not f.startswith(("_part", "_edge"))))
