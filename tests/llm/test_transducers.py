import itertools
import random
import time

import pytest

from vantage.llm import toxicity as t


def _brute(symbols):
    """Sum over every choice of one hit, by the rules as they read."""
    total = 0.0
    for i, (symbol, weight) in enumerate(symbols):
        if symbol not in t.HITS:
            continue
        reach, quoted, reported = 0, False, False
        for s, _ in symbols[:i]:
            reach = t.NEGATION_REACH if s == "negation" else reach if s == "quote" else max(reach - 1, 0)
            quoted ^= s == "quote"
            reported |= s == "report"
        kinds = {s for s, _ in symbols}
        if symbol == "threat" and not kinds & {"target", "insult"}:
            continue
        total += weight * (t.NEGATED if reach else 1) * (t.REPORTED if quoted or reported else 1) * (t.TARGETED if "target" in kinds else 1)
    return total


def _paths(machine, symbols, state):
    """The weights of all paths, one by one."""
    if not symbols:
        yield machine.finals.get(state, 0.0)
        return
    (symbol, weight), rest = symbols[0], symbols[1:]
    for output, w, to in machine.arcs.get((state, symbol), ()):
        for more in _paths(machine, rest, to):
            yield w * (weight if output == "pick" else 1.0) * more


def test_composition_against_paths_and_rules():
    machine, starts = t.clause_machine()
    rng = random.Random(2)
    cases = list(itertools.product((*t.HITS, *t.PLAIN), repeat=3))
    cases += [[rng.choice((*t.HITS, *t.PLAIN)) for _ in range(rng.randrange(4, 9))] for _ in range(400)]
    for case in cases:
        read = [(s, rng.random() + 0.5 if s in t.HITS else 0.0) for s in case]
        want = pytest.approx(_brute(read))
        assert machine.total(read, starts[False]) == want and sum(_paths(machine, read, starts[False])) == want
        assert machine.total(read, starts[True]) == pytest.approx(_brute([("quote", 0.0), *read]) if "negation" not in case else machine.total(
            [("quote", 0.0), *read], starts[False]))


def test_inflected_threats_and_quotes_over_clauses():
    g = t.Grammar({"idiot": 3.0})
    w = g.clause_weight
    assert w("i killed you") == w("i kill you") == w("he kills them") > 0 == w("i killed time")
    top = lambda text: g.features(text)[0]
    assert top('he said "stop. you idiot"') == pytest.approx(3 * t.REPORTED * t.TARGETED)
    assert top('"stop. calm down" you idiot.') == pytest.approx(3 * t.TARGETED) == top('"stop\nyou idiot')
    assert top('"a. b. c. idiot. d" x') == pytest.approx(3 * t.REPORTED)
    began = time.time()
    assert g.features('"idiot. ' * 30_000)[2] == 30_000
    assert time.time() - began < 10


def test_threats_are_learnt_and_score_without_labels(spark):
    rows = [(f"they kill me {i}" if i % 4 == 0 else f"we burn wood with them {i}", int(i % 4 == 0)) for i in range(200)]
    insults, threats = t.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert threats["kill"] > 1 and threats["burn"] == 0 and threats["beat"] == t.THREAT_WEIGHT and "kill" not in insults
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "I will kill you."), (2, "A calm day."), (3, None)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in t.score_toxicity(docs, t.fit(docs, none)).collect()}
    assert score[1] > score[2] == score[3] and max(score.values()) < 0.5
