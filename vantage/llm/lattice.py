"""Embedding near-duplicates by E8 lattice hashing (operator 5).

Each table projects the normalised vectors to eight random dimensions and decodes the projection to the
nearest point of the E8 lattice; the point is the vector's home cell.  A vector also probes the
neighbouring cells whose centres are nearest.  Two vectors meet where one's home is a home or a probe of
the other, and every meeting is verified by the cosine in double precision.

Cells are joined only where they hold at least two vectors, one of them at home; large cells are split
into blocks and compared block against block, so no cell is gathered in one task.  A pair that meets
several times is counted at its first meeting, so tasks return one row per vector, never pairs.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components
from .registry import query
from .store import materialise, table
from .textbatch import mix

COSINE = 0.98
TABLES, PROBES = 3, 6
#: Lattice unit as a share of the unit vector: the larger, the higher recall and the fuller cells.
SCALE = 0.35
SEED = 20240601
#: Vectors of one block of a cell.
BLOCK = 1024


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of ±1, or all ±1/2 with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for s in itertools.product((0.5, -0.5), repeat=8):
        if sum(x < 0 for x in s) % 2 == 0:
            out.append(np.array(s))
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer entries of even sum: round, then move the worst entry where the sum is odd."""
    r = np.rint(x)
    d = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(d[odd]).argmax(1)
    r[odd, worst] += np.where(d[odd, worst] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: E8 is D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def cell_code(points: np.ndarray, table_no: int) -> np.ndarray:
    """64-bit codes of lattice points (last axis) of one table."""
    odd = np.random.default_rng(SEED + 1).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mix((np.rint(points * 2).astype(np.int64).view(np.uint64) * odd).sum(-1, dtype=np.uint64) + np.uint64(table_no)).view(np.int64)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((tables, dim, 8)) / np.sqrt(8)


def codes(x: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, probe) cell codes of unit vectors: shapes (n, tables) and (n, tables, probes)."""
    home = np.empty((len(x), tables), np.int64)
    near = np.empty((len(x), tables, probes), np.int64)
    v = minimal_vectors()
    for t, p in enumerate(_projections(x.shape[1], tables)):
        y = x @ p / scale
        c = decode_e8(y)
        home[:, t] = cell_code(c, t)
        # Centres c + v nearest to y: those with the largest (y - c) . v less half of v . v, which is 2 for all.
        best = np.argpartition(-(y - c) @ v.T, probes, axis=1)[:, :probes]
        near[:, t] = cell_code(c[:, None, :] + v[best], t)
    return home, near


def _usable(v) -> np.ndarray | None:
    if v is None or any(c is None for c in v):
        return None
    x = np.asarray(v, float)
    return x if len(x) and np.isfinite(x).all() and x.any() else None



def _coded(tables: int, probes: int, scale: float):
    """Rows (rep, group, copies, unit vector, homes, probes) of the vectors that can link."""
    schema = pa.schema([("rep", pa.int64()), ("vh", pa.int64()), ("copies", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("unit", pa.binary()),
                        ("home", pa.list_(pa.int64())), ("probe", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                rep, vh, copies, label = (some.column(i).to_pylist() for i in range(4))
                by_dim: dict[int, list] = {}
                for i, v in enumerate(some.column(4).to_pylist()):
                    x = _usable(v)
                    if x is not None:
                        by_dim.setdefault(len(x), []).append((i, x))
                for dim, rows in by_dim.items():
                    x = np.stack([r[1] for r in rows])
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    home, near = codes(x, tables, probes, scale)
                    yield pa.record_batch([
                        pa.array([rep[i] for i, _ in rows], pa.int64()), pa.array([vh[i] for i, _ in rows], pa.int64()), pa.array([copies[i] for i, _ in rows], pa.int64()),
                        pa.array([label[i] for i, _ in rows], pa.string()), pa.array([dim] * len(rows), pa.int32()),
                        pa.array([u.tobytes() for u in x], pa.binary()),
                        pa.array(home.tolist(), pa.list_(pa.int64())), pa.array(near.reshape(len(x), -1).tolist(), pa.list_(pa.int64()))], schema=schema)

    return run


_FOUND = "rep long, vh long, links long, low long"


def _smallest_reached(ids: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per row the smallest id that it reaches over the links u - w (row numbers)."""
    low = ids.copy()
    while len(u):
        m = np.minimum(low[u], low[w])
        if (low[u] == m).all() and (low[w] == m).all():
            break
        np.minimum.at(low, u, m)
        np.minimum.at(low, w, m)
    return low


def _compare(cosine: float, tables: int):
    """Within a block pair: per vector the links first met here (with copies) and the smallest id reached over links."""

    def run(tab: pa.Table) -> pa.Table:
        t, cell = tab.column("t")[0].as_py(), tab.column("cell")[0].as_py()
        rep, vh, copies = (tab.column(c).to_numpy() for c in ("rep", "vh", "copies"))
        at_home, side = tab.column("at_home").to_numpy(), tab.column("side").to_numpy()
        i, j = tab.column("i")[0].as_py(), tab.column("j")[0].as_py()
        x = np.stack([np.frombuffer(u) for u in tab.column("unit").to_pylist()])
        home = np.array(tab.column("home").to_pylist(), np.int64)
        near = np.array(tab.column("probe").to_pylist(), np.int64).reshape(len(x), tables, -1)
        links, met = np.zeros(len(x), np.int64), [(np.zeros(0, np.int32),) * 2]
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        for a in range(0, len(left), 256):
            rows = left[a:a + 256]
            p, q = np.nonzero(x[rows] @ x[right].T >= cosine)
            p, q = rows[p], right[q]
            ok = at_home[p] | at_home[q]
            if i == j:
                # Classes of a repeated vec_id share their rep; the value's hash tells them apart.
                ok &= (rep[p] < rep[q]) | ((rep[p] == rep[q]) & (vh[p] < vh[q]))
            p, q = p[ok], q[ok]
            met.append((p.astype(np.int32), q.astype(np.int32)))
            for s in range(0, len(p), 65536):
                u, w = p[s:s + 65536], q[s:s + 65536]
                same = home[u] == home[w]
                uw = (near[w] == home[u][:, :, None]).any(2)
                wu = (near[u] == home[w][:, :, None]).any(2)
                first = ~(same | uw | wu)[:, :t].any(1)
                both = uw[:, t] & wu[:, t]
                first &= ~both | (np.minimum(home[u, t], home[w, t]) == cell)
                np.add.at(links, u[first], copies[w[first]])
                np.add.at(links, w[first], copies[u[first]])
        low = _smallest_reached(rep, *(np.concatenate(ends) for ends in zip(*met, strict=True)))
        keep = (links > 0) | (low != rep)
        return pa.table({"rep": pa.array(rep[keep], pa.int64()), "vh": pa.array(vh[keep], pa.int64()), "links": pa.array(links[keep], pa.int64()), "low": pa.array(low[keep], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Labels of any type are compared as text.  Vectors of one label and length link when their cosine is at least ``cosine``.  ``n_links`` counts the
    other rows linked directly, copies included; ``component_id`` is the smallest vec_id reachable;
    ``kept`` marks the row that is its component.  Null vectors or labels, zero vectors and vectors with
    null or non-finite entries link with nothing; a null vec_id gets 0 links and a null component; a
    repeated vec_id is one node with the links of all its rows added up; an empty table gives an empty result.  No pair
    below ``cosine`` links; a pair above it is missed only if it meets in none of the tables.
    """
    # Floats stay floats, which have their cosine in double precision; all other components become doubles.
    whole = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = rows.where("vec_id is not null and label is not null and embedding is not null")
    # A class is the rows of one label and value; rep and a hash of the value tell the classes apart.
    by_value = ["label", "embedding"]
    classes = materialise(usable.groupBy(*by_value).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                          .withColumn("vh", F.xxhash64(*by_value)))
    coded = materialise(classes.select("rep", "vh", "copies", "label", "embedding").mapInArrow(
        _coded(tables, probes, scale),
        "rep long, vh long, copies long, label string, dim int, unit binary, home array<long>, probe array<long>"))
    homes = coded.select("label", "dim", "rep", "vh", F.posexplode("home").alias("t", "cell"), F.lit(True).alias("at_home"))
    visits = coded.select("label", "dim", "rep", "vh", F.posexplode("probe").alias("k", "cell"), F.lit(False).alias("at_home")).withColumn(
        "t", F.expr(f"cast(k div {probes} as int)"))
    key = ["label", "dim", "t", "cell"]
    places = materialise(homes.select(*key, "rep", "vh", "at_home").union(visits.select(*key, "rep", "vh", "at_home")))
    full = (places.groupBy(*key).agg(F.count("*").alias("n"), F.max("at_home").alias("any"))
            .where("n > 1 and any").select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    met = places.join(full, key).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = (met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")))
    groups = dealt.join(coded.select("rep", "vh", "copies", "unit", "home", "probe"), ["rep", "vh"])
    found = materialise(groups.groupBy(*key, "i", "j").applyInArrow(_compare(cosine, tables), _FOUND))
    links = found.groupBy("rep", "vh").agg(F.sum("links").alias("links"))
    member = usable.join(classes.join(coded.select("rep", "vh"), ["rep", "vh"], "left_semi"), by_value).select("vec_id", "rep", "vh", "copies")
    edges = found.where("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b")).union(
        member.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    comp = connected_components(edges).withColumnRenamed("id", "vec_id")
    counted = (member.join(links, ["rep", "vh"], "left").groupBy("vec_id")
               .agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (rows.select("vec_id").join(counted, "vec_id", "left").join(comp, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False))))


@query("op5_e8_lattice")
def op5_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
