"""Which owners of 64-bit keys share them with another owner, from one exchange of packed keys.

Keys travel as arrays, a row per block of owners and shard, so a key costs 12 bytes and no row of its
own; a shard counts its keys with one sort.  A key that very many owners hold is spread like any other,
for it adds 12 bytes an owner to one shard.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .store import shuffle_width

#: Keys of one block of owners.
BLOCK_KEYS = 2_000_000
_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("owners", pa.binary()), ("keys", pa.binary()),
                     ("at", pa.binary())])


def _blocks(produce, shards: int):
    """``produce`` maps a record batch to (id columns, needed, keys) per owner."""

    def pack(part: int, block: int, owners: array, keys: bytearray, sizes: array) -> pa.RecordBatch:
        flat = np.frombuffer(keys, np.uint64)
        at = np.repeat(np.arange(len(sizes), dtype=np.uint32), np.frombuffer(sizes, np.int64))
        shard = (flat % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        flat, at = flat[order], at[order]
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        # The owners of a block travel with one of its shards, those of other blocks with other shards.
        home = (part + 7 * block) % shards
        used = [s for s in range(shards) if s == home or cut[s + 1] > cut[s]]
        return pa.record_batch([
            pa.array([part] * len(used), pa.int32()), pa.array([block] * len(used), pa.int32()), pa.array(used, pa.int32()),
            pa.array([owners.tobytes() if s == home else None for s in used], pa.binary()),
            pa.array([flat[cut[s]:cut[s + 1]].tobytes() for s in used], pa.binary()),
            pa.array([at[cut[s]:cut[s + 1]].tobytes() for s in used], pa.binary())], schema=_PACKED)

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        owners, keys, sizes = array("q"), bytearray(), array("q")
        for batch in batches:
            for ids, need, own in produce(batch):
                owners.extend((*ids, need))
                keys += own.tobytes()
                sizes.append(len(own))
                if len(keys) >= 8 * BLOCK_KEYS:
                    yield pack(part, block, owners, keys, sizes)
                    owners, keys, sizes, block = array("q"), bytearray(), array("q"), block + 1
        if owners:
            yield pack(part, block, owners, keys, sizes)

    return run


def _count(tab: pa.Table) -> pa.Table:
    """Per block of one shard: its owners that have keys which another owner has too, as gaps, and how many.

    Owners without such a key take no room: a row for each block with a count for each of its owners would grow
    with the blocks times the shards.
    """
    keys = [np.frombuffer(x, np.uint64) for x in tab.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(s), bool)
    shared[1:] |= same
    shared[:-1] |= same
    back = np.empty(len(s), bool)
    back[order] = shared
    gaps, counts, at = [], [], 0
    for k, o in zip(keys, tab.column("at").to_pylist(), strict=True):
        who, n = np.unique(np.frombuffer(o, np.uint32)[back[at:at + len(k)]], return_counts=True)
        gaps.append(np.diff(who, prepend=np.uint32(0)).tobytes())
        counts.append(n.astype(np.uint32).tobytes())
        at += len(k)
    out = pa.table({"part": tab.column("part"), "block": tab.column("block"), "owners": tab.column("owners"),
                    "gaps": pa.array(gaps, pa.binary()), "counts": pa.array(counts, pa.binary())})
    return out.filter(pc.or_(pc.is_valid(out["owners"]), pc.greater(pc.binary_length(out["counts"]), 0)))


def _choose(names: list[str]):
    def choose(tab: pa.Table) -> pa.Table:
        """Owners of one block with as many shared keys as they need."""
        meta = next(x for x in tab.column("owners").to_pylist() if x is not None)
        owners = np.frombuffer(meta, np.int64).reshape(-1, len(names) + 1)
        total = np.zeros(len(owners), np.int64)
        for g, c in zip(tab.column("gaps").to_pylist(), tab.column("counts").to_pylist(), strict=True):
            total[np.cumsum(np.frombuffer(g, np.uint32), dtype=np.int64)] += np.frombuffer(c, np.uint32)
        ok = total >= owners[:, -1]
        columns = {n: pa.array(owners[ok, i], pa.int64()) for i, n in enumerate(names)}
        return pa.table({**columns, "shared": pa.array(total[ok], pa.int64())})

    return choose


def sharing_owners(rows: DataFrame, produce, names: list[str]) -> DataFrame:
    """The ids (long columns ``names``) of owners that share at least the keys they need, and how many they share.

    ``produce`` runs in the tasks: it maps a record batch of ``rows`` to (ids, needed, keys) per owner,
    keys being distinct uint64 values.
    """
    packed = rows.mapInArrow(_blocks(produce, shuffle_width(rows.sparkSession)),
                             "part int, block int, shard int, owners binary, keys binary, at binary")
    counted = packed.groupBy("shard").applyInArrow(_count, "part int, block int, owners binary, gaps binary, counts binary")
    return counted.groupBy("part", "block").applyInArrow(_choose(names), ", ".join(f"{n} long" for n in [*names, "shared"]))
