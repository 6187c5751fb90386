import time

import pytest

from vantage.llm import secret_scan


def guesses(text):
    return [text[a:b] for a, _, b, _ in secret_scan.guess_spans(text, secret_scan.GUESS_THRESHOLD)]


@pytest.mark.parametrize("before, value", [
    ("DB_PASSWORD=", "p@ss!x9Q2#kL"), ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzQx81LpVw0"), ("db_pwd: ", "v!8Kq#2zLm"),
    ("client_secret = ", "$9dK!qmZ2xv"), ("userPassword=", "!zQ81kLmw#"), ("password:      ", "p@ss!x9Q2#kL"), ("token\t\t\t\t\t=\t\t\t\t\t", "p@ss!x9Q2#kL"),
    ("PGPASSWORD=", "p@ss!x9Q2#kL"), ("spring.datasource.password=", "p@ss!x9Q2#kL"), ("secretKey: ", "p@ss!x9Q2#kL"), ("userPin=", "p@ss!x9Q2#kL"),
    ("db-pass: ", "p@ss!x9Q2#kL"), ("auth_token=", "p@ss!x9Q2#kL"), ("password\n:\n", "p@ss!x9Q2#kL"), ("--password is ", "p@ss!x9Q2#kL")])
def test_names_with_a_credential_word(before, value):
    assert guesses(before + value) == guesses(f"see {before}{value} there") == [value]


@pytest.mark.parametrize("name", ["compass", "opinion", "author", "secretary", "tokenizer", "passenger", "shipping", "bypass"])
def test_other_words_that_hold_one(name):
    assert guesses(f"{name}: p@ss!x9Q2#kL") == []


def test_long_names_and_gaps_are_read_once():
    began = time.time()
    for text in ("x" * 200_000, "password" * 25_000, "password" + " " * 200_000, "a.pin_" * 30_000, "password \t" * 20_000):
        assert guesses(text) == []
    assert time.time() - began < 10
