"""Centroid clustering with PCA-rotated filtering (operator 11).

Vectors are integers; Lloyd rounds assign each to the nearest of k centroids.  Every vector is stored
with its leading coordinates in a PCA rotation and the norm of the rest.  For a centroid split the same
way, |lead - lead'|^2 + (rest - rest')^2 never exceeds the squared distance, so a centroid whose bound
lies above the distance to the most promising one is left out; the others are compared in integers.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import materialise, table

DIM = 64
SCALE = 64
K = 16
ROUNDS = 3
#: Components lie within +-2^27 units, so that a squared distance of 64 of them fits into a long.
LIMIT = 1 << 27
#: The stored leading coordinates hold this share of the variance.
EXPLAINED = 0.8
#: Allowance for rounding of the rotated coordinates, as a share of the squared lengths involved.
SLACK = 1e-9


def _grid(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are whole vectors, their integers, which of them lie within the limit)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    full = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) &
                          (np.asarray(column.value_lengths().fill_null(-1)) == dim))
    x = column.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    full, x = full[finite], x[finite]
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    near = (np.abs(x) < LIMIT).all(axis=1)
    x[~near] = 0
    return full, x.astype(np.int64), near


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """(vec_id, cells binary): ``floor(scale * x)`` per component as little-endian int32, a row per whole vector.

    Vectors that are null, of another length or hold a null or non-finite component give no row.  Where a
    component lies beyond the limit, ``cells`` is null.
    """

    def run(batches):
        for batch in batches:
            rows, x, near = _grid(batch.column(1), dim, scale)
            cells = [v if ok else None for v, ok in zip(_packed(x.astype("<i4")), near, strict=True)]
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(cells, pa.binary())], names=["vec_id", "cells"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(run, "vec_id long, cells binary")


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column without nulls as a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind).reshape(-1, width)


def seeds(grid: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors whose ids come first by SHA-256 of ``1:<vec_id>`` (equal ids: by their integers)."""
    first = grid.where("cells is not null and vec_id is not null").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), "cells").limit(k)
    return np.array([np.frombuffer(r.cells, "<i4") for r in first.collect()], np.int64)


def rotation(grid: DataFrame, dim: int = DIM, explained: float = EXPLAINED) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, rotation with the main axes first, number of leading axes) from the moments of all vectors.

    Each task sums its outer products; what reaches the driver are ``dim * (dim + 1) + 1`` sums.
    """

    def moments(batches):
        n, s, o = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _unpacked(batch.column(0), "<i4", dim).astype(np.float64)
            n, s, o = n + len(x), s + x.sum(axis=0), o + x.T @ x
        if n:
            flat = np.concatenate(([n], s, o.ravel()))
            yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    sums = grid.where("cells is not null").select("cells").mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    flat = np.zeros(1 + dim + dim * dim)
    for r in sums.collect():
        flat[r["at"]] = r["value"]
    n = max(flat[0], 1.0)
    mean = flat[1:dim + 1] / n
    spread, axes = np.linalg.eigh(flat[dim + 1:].reshape(dim, dim) / n - np.outer(mean, mean))
    spread, axes = np.maximum(spread[::-1], 0), np.ascontiguousarray(axes[:, ::-1])
    share = np.cumsum(spread) / spread.sum() if spread.sum() > 0 else np.ones(dim)
    return mean, axes, min(dim, int(np.searchsorted(share, explained)) + 1)


def rotated(grid: DataFrame, mean: np.ndarray, axes: np.ndarray, lead: int, dim: int = DIM) -> DataFrame:
    """(vec_id, cells, lead binary, rest double): what the filter needs, stored once."""

    def run(batches):
        for batch in batches:
            y = (_unpacked(batch.column(1), "<i4", dim) - mean) @ axes
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_packed(y[:, :lead]), pa.binary()),
                                   pa.array(np.sqrt((y[:, lead:] ** 2).sum(axis=1)))], names=["vec_id", "cells", "lead", "rest"])

    return materialise(grid.where("cells is not null").mapInArrow(run, "vec_id long, cells binary, lead binary, rest double"))


class Nearest:
    """Nearest centroid of blocks of vectors: bounds from rotated coordinates, decisions in integers."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.centroids, self.n_lead = centroids, lead
        y = (centroids - mean) @ axes
        self.lead, self.rest = y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1))
        self.size = (y ** 2).sum(axis=1)
        self.verified = 0

    def __call__(self, cells: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance); of equally near centroids the one with the smallest number."""
        n, k = len(cells), len(self.centroids)
        bound = ((lead ** 2).sum(axis=1)[:, None] - 2 * (lead @ self.lead.T) + (self.lead ** 2).sum(axis=1)) + (rest[:, None] - self.rest) ** 2
        bound -= SLACK * (((lead ** 2).sum(axis=1) + rest ** 2)[:, None] + self.size + 1)
        best = np.argmin(bound, axis=1)
        near = self._distance(cells, best)
        open_ = bound <= near[:, None]
        open_[np.arange(n), best] = False
        self.verified += n
        for c in range(k):
            rows = np.flatnonzero(open_[:, c] & (bound[:, c] <= near))
            self.verified += len(rows)
            d = self._distance(cells[rows], np.full(len(rows), c))
            wins = (d < near[rows]) | ((d == near[rows]) & (c < best[rows]))
            best[rows[wins]], near[rows[wins]] = c, d[wins]
        return best, near

    def _distance(self, cells: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        gap = cells.astype(np.int64) - self.centroids[centroid]
        return (gap * gap).sum(axis=1)


def _assigned(batches, nearest: Nearest, dim: int):
    for batch in batches:
        cells = _unpacked(batch.column("cells"), "<i4", dim)
        yield batch, cells, *nearest(cells, _unpacked(batch.column("lead"), "<f8", nearest.n_lead), batch.column("rest").to_numpy())


def new_centroids(stored: DataFrame, nearest: Nearest, dim: int = DIM) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster; empty clusters keep their centroid.

    A task adds up its vectors; ``k * (dim + 1)`` sums reach the driver.
    """
    k = len(nearest.centroids)

    def sums(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for _, cells, cluster, _ in _assigned(batches, nearest, dim):
            for c in np.unique(cluster):
                own = cells[cluster == c]
                total[c, 0] += len(own)
                total[c, 1:] += own.sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], names=["at", "value"])

    parts = stored.mapInArrow(sums, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = {r["at"]: int(r["value"]) for r in parts.collect()}
    out = nearest.centroids.copy()
    for c in range(k):
        if n := total.get(c * (dim + 1), 0):
            out[c] = [total.get(c * (dim + 1) + 1 + i, 0) // n for i in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows vec_id, cluster, distance; final centroids) after ``rounds`` Lloyd rounds.

    A row per vector of ``dim`` finite components, equal rows and ids included; rows without a vec_id are
    assigned but are no seeds.  With fewer than k vectors there are fewer centroids, with none an empty
    result.  A vector with a component of 2^27 units or more has no distance that fits a long: its row
    has null cluster and distance, and it moves no centroid.  Other columns are not read.
    """
    grid = materialise(integer_vectors(vectors, dim, scale))
    start = seeds(grid, k)
    far = grid.where("cells is null").selectExpr("vec_id", "cast(null as int) cluster", "cast(null as long) distance")
    if not len(start):
        return far, start.reshape(0, dim)
    mean, axes, lead = rotation(grid, dim)
    stored = rotated(grid, mean, axes, lead, dim)

    def near(centroids: np.ndarray) -> Nearest:
        return Nearest(centroids, mean, axes, lead)

    final = reduce(lambda centroids, _: new_centroids(stored, near(centroids), dim), range(rounds), start)

    def assign(batches):
        for batch, _, own, distance in _assigned(batches, near(final), dim):
            yield pa.record_batch([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance, pa.int64())],
                                  names=["vec_id", "cluster", "distance"])

    return materialise(stored.mapInArrow(assign, "vec_id long, cluster int, distance long").union(far)), final


def with_summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds inertias (null beyond a long) and the centroid's digest, from one row per cluster (at most k, broadcast)."""
    sums = assigned.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}
    long = [v if v < 1 << 63 else None for v in [*inertia.values(), sum(inertia.values())]]
    rows = [(c, s, long[-1], hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in zip(inertia, long, strict=False)]
    per = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster", "left").select("vec_id", "cluster", "distance", *per.columns[1:])


_TERM = "floor(64 * x::DOUBLE)::BIGINT"


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """Plain Lloyd rounds in SQL: a row per vector, centroid and component."""
    text = f"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings),
g AS (SELECT rid, vec_id, list_transform(embedding, lambda x: {_TERM}) AS v FROM raw
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
e AS (SELECT rid, unnest(range({DIM})) AS i, unnest(v) AS x FROM g),
s AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c FROM g WHERE vec_id IS NOT NULL QUALIFY c < {k}),
c0 AS (SELECT c, unnest(range({DIM})) AS i, unnest(v) AS x FROM s)"""
    for r in range(rounds + 1):
        text += f""",
d{r} AS (SELECT rid, c, sum((e.x - c{r}.x) * (e.x - c{r}.x))::BIGINT AS d FROM e JOIN c{r} USING (i) GROUP BY ALL),
a{r} AS (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
        if r < rounds:
            text += f""",
m{r} AS (SELECT c, i, sum(x)::HUGEINT AS t, count(*) AS n FROM a{r} JOIN e USING (rid) GROUP BY ALL),
c{r + 1} AS (SELECT c, i, coalesce(t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END, x)::BIGINT AS x FROM c{r} LEFT JOIN m{r} USING (c, i))"""
    return text + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  centroid_sha256 FROM a{rounds} JOIN g USING (rid) JOIN h USING (c)"""


@query("op11_pca_centroids", _sql())
def op11_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_summary(*cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
