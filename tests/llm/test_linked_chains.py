"""Vectors that only a third one links, whose smaller neighbour has the smallest id, are of one component."""

import math

import numpy as np
import pytest

from vantage.llm import lattice

SCHEMA = "vec_id long, embedding array<double>, label string"


def _at(degrees: float) -> list[float]:
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.mark.parametrize("block", [1024, 2])
def test_a_chain_is_one_component(spark, block):
    # By angle 4 - 2 - 5 - 3 - 1: neighbours link at 10 degrees, others don't.
    rows = [(v, _at(10.0 * i), "x") for i, v in enumerate((4, 2, 5, 3, 1))] + [(9, _at(120.0), "x"), (8, _at(10.0), "y")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(
        spark.createDataFrame(rows, SCHEMA), tables=3, probes=24, scale=2.0, block=block).collect()}
    assert got == {4: (1, 1, False), 2: (2, 1, False), 5: (2, 1, False), 3: (2, 1, False), 1: (1, 1, True), 9: (0, 9, True), 8: (0, 8, True)}


def test_smallest_reached():
    rng = np.random.default_rng(5)
    ids, u, w = rng.permutation(60), rng.integers(0, 60, 45), rng.integers(0, 60, 45)
    low = lattice._smallest_reached(ids, u, w)
    want = ids.copy()
    for _ in range(60):
        for a, b in zip(u, w, strict=True):
            want[a] = want[b] = min(want[a], want[b])
    assert (low == want).all() and (lattice._smallest_reached(ids, u[:0], w[:0]) == ids).all()
