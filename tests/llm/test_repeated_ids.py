"""Vectors of one repeated id with different values link with each other and with each other's copies."""

from vantage.llm.lattice import near_duplicates


def test_classes_of_a_repeated_id_are_compared(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0]
    rows = [(1, a, "x"), (1, b, "x"), (5, a, "x"), (7, b, "x"), (9, [0.0, 1.0, 0.0, 0.0], "x")]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    # Rows 1a, 1b, 5 and 7 are all linked: three others each, those of both rows 1 added up.
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()} == {
        (1, 6, 1, True), (5, 3, 1, False), (7, 3, 1, False), (9, 0, 9, True)}
