import random

from vantage.llm import paragraph_dedup


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.paragraph): r for r in paragraph_dedup.repeated_paragraphs(docs).collect()}


def words(rng, n):
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def test_short_sentences_and_cut_borders_count(spark):
    rng = random.Random(4)
    short = lambda: " ".join(words(rng, 5).capitalize() + "." for _ in range(4))
    passage = f"{words(rng, 6)}. {short()} {words(rng, 9)}. {short()} {words(rng, 6)}"
    got = found(spark, f"{words(rng, 40)} {passage} {words(rng, 12)}.", f"{words(rng, 9)}, {passage}, {words(rng, 20)}.")
    assert len(got) == 2 and sorted(r.removed for r in got.values()) == [False, True]
    assert all(r.n_words == 9 and 30 <= r.run_words <= len(passage.split()) for r in got.values())


def test_words_that_differ_beside_a_paragraph_do_not_count(spark):
    rng = random.Random(5)
    anchor = words(rng, 12) + "."
    got = found(spark, *(f"{words(rng, 5)}. same words. {anchor} {words(rng, 3)}. {words(rng, 20)}." for _ in range(3)))
    assert got == {}


def test_gap_between_two_paragraphs_counts_once(spark):
    rng = random.Random(6)
    passage = f"{words(rng, 10)}. {words(rng, 4)}. {words(rng, 4)}. {words(rng, 11)}. {words(rng, 5)}."
    got = found(spark, f"{words(rng, 9)}.\n{passage}\n{words(rng, 9)}.", f"{words(rng, 15)}.\n{passage}\n{words(rng, 8)}.")
    assert len(got) == 4 and {r.run_words for r in got.values()} == {34}
