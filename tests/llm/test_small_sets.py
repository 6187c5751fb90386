from tests.llm import brute
from vantage.llm import ngram_join

WORDS = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()


def test_text_and_the_same_with_a_word_more(spark):
    """5 and 4 shingles: the larger set sees one element of the smaller one's prefix of one."""
    for first in ("a b c d e f g h", "b c d e f g h i"):
        rows = [(1, first), (2, "a b c d e f g h i")]
        got = sorted(tuple(r) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute.jaccard_classes(rows) == [(1, 4, 1), (2, 5, 1)]


def test_small_sizes(spark):
    rows = [(100 * n + c, " ".join(f"{w}{n}" for w in WORDS[c:n])) for n in range(5, 27) for c in (0, 1)]
    rows += [(10_000 + n, " ".join(f"{w}{n}" for w in WORDS[:n - 1])) for n in range(6, 27)]
    got = sorted(tuple(r) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute.jaccard_classes(rows)


def test_first_order_asks_for_no_more_than_a_linked_pair_shows():
    """The fewest shared elements that both extended prefixes hold, for all sizes and smallest intersections."""
    for n in range(1, 300):
        for m in range(-(-80 * n // 100), 100 * n // 80 + 1):
            both = -(-80 * (n + m) // 180)
            sent = [min(x, 2 * ngram_join.allowance(x, 80) + 1) for x in (n, m)]
            seen = min(both, sent[0] - (n - both), sent[1] - (m - both))
            assert seen >= max(1, sent[0] - ngram_join.allowance(n, 80) - 1)
