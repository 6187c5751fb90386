import itertools
import math
import random
import time

import public_tokenizers
import pytest

from vantage.llm import secret_scan as s

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _piece_costs(piece):
    """Costs of one piece under every model, but for the choice of the model."""
    out = [sum(math.log10(s._alphabet(c)) for c in piece)]
    low = piece.lower()
    plain = low.translate(s._LEET)
    if plain in s.dictionary():
        out.append(math.log10(s.dictionary()[plain] + 1) + 0.6 * ((piece != low) + (plain != low)))
    if len(piece) >= 3 and len(set(piece)) == 1:
        out.append(math.log10(s._alphabet(piece[0]) * len(piece)))
    if len(piece) >= 3 and all(a + b in s._neighbours() for a, b in zip(low, low[1:])):
        out.append(math.log10(94 * 2 * len(piece)))
    out += [cost for pattern, cost in s.DATES if pattern.fullmatch(piece)]
    return out


def _brute(value):
    """The cheapest of all splits of ``value``."""
    n, best = len(value), math.inf
    for cuts in itertools.product((0, 1), repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        best = min(best, sum(min(_piece_costs(value[a:b])) + s.CHOICE for a, b in zip(at, at[1:])))
    return best


def test_cost_is_the_minimum_over_all_splits():
    rng = random.Random(5)
    parts = ["pass", "key", "my", "abc", "bcdef", "qwer", "aaa", "aaaa", "1999", "0231", "321", "x", "Z", "!", "p@ss", "Test", "cba", "root", "456"]
    for _ in range(250):
        value = "".join(rng.choice(parts) for _ in range(4))[:11]
        cost, segments = s.guess_cost(value)
        assert cost == pytest.approx(_brute(value)), value
        assert "".join(value[a:b] for _, a, b in segments) == value
        assert cost == pytest.approx(sum({"brute": lambda x: _piece_costs(x)[0]}.get(k, lambda x: min(_piece_costs(x)))(value[a:b]) + s.CHOICE
                                         for k, a, b in segments))


def test_walks_and_repeats_may_start_inside_words():
    for value in ("welcomeefghij", "passwordefghij", "letmeinopqrst", "helloooooo"):
        cost, segments = s.guess_cost(value)
        assert cost < 6 and segments[0][0] == "word" and segments[1][0] in ("walk", "repeat")
    assert s.guess_cost("mybirthday12311999", VOCABULARY)[0] < 12 and s.guess_cost("correcthorsebatterystaple", VOCABULARY)[0] < 20


def test_long_runs_take_linear_time():
    began = time.time()
    for value in ("a" * 30_000, "abcdefgh" * 4_000, "qwerty" * 5_000, "password" * 4_000):
        assert s.guess_cost(value)[0] > 0
    assert time.time() - began < 20


def guesses(text):
    return [text[a:b] for a, _, b, _ in s.guess_spans(text, s.GUESS_THRESHOLD, VOCABULARY)]


@pytest.mark.parametrize("text, want", [
    ('{"password":"test","user":"bob","city":"Paris"}', []), ("password=test&user=bob&city=Paris&zip=75001", []),
    ("the password is required", []), ('{"password":"p9!xQz,7&kL#w","user":"bob"}', ["p9!xQz,7&kL#w"]),
    ("password=p9!xQz7kL#w&user=bob", ["p9!xQz7kL#w"]), ("login(password='p9!xQz7kL#w')", ["p9!xQz7kL#w"]),
    ("login(password=p9!xQz7kL#w)", ["p9!xQz7kL#w"]), ('password = "horse 9x!Q plum"', ["horse 9x!Q plum"]),
    ('password="p9!xQz7kL#w', ["p9!xQz7kL#w"]), ("<password>: p9!xQz7kL#w</password>", []), ("password: p9!xQz7kL#w</b>", ["p9!xQz7kL#w"])])
def test_values_end_at_quotes_and_separators(text, want):
    assert guesses(text) == want
