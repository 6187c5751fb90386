from vantage.llm import decontaminate, lattice


def test_short_items_are_searched_exactly(spark):
    docs = spark.createDataFrame([(1, "so the quick brown fox runs"), (2, "the quick brown dog"), (3, "Quick, brown!"), (4, "zebra"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "The quick brown fox"), (11, "quick brown"), (12, "Zebra"), (13, "..."), (14, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.start_word, r.end_word) for r in decontaminate.find_items(docs, items).collect()}
    assert got == {(1, 10, 0, 1, 5), (1, 11, 0, 2, 4), (2, 11, 0, 1, 3), (3, 11, 0, 0, 2), (4, 12, 0, 0, 1)}
    assert [r.doc_id for r in decontaminate.without_items(docs, items).collect()] == [5]


def test_doubles_and_text_labels(spark):
    """Two vectors that are one as floats but have a cosine just below the limit, and labels that are no numbers."""
    c = 0.98
    near, far = [1.0, 0.0, 0.0, 0.0], [c - 1e-10, (1 - (c - 1e-10) ** 2) ** 0.5, 0.0, 0.0]
    exact = [c + 1e-10, (1 - (c + 1e-10) ** 2) ** 0.5, 0.0, 0.0]
    rows = [(1, near, "a"), (2, far, "a"), (3, near, "b"), (4, exact, "b"), (5, near, None), (6, near, "c"), (7, near, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df, tables=6, probes=24, scale=2.0).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False)}
