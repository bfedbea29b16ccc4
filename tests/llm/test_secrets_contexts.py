"""Guess spans by a second finder, long texts in linear time, words by share."""
import random
import time

import pytest

from tests.llm.fixtures import documents, prose
from tidewheel.llm import secrets

NAMECHARS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
STOPS = set(" \t\n\r\x0b\x0c\"'<>,;")


def plain_values(text):
    """(start, end) of values behind ``name:``, ``name=`` and ``name=>``, character by character."""
    out, i, until = [], 0, 0
    while i < len(text):
        if text[i] not in NAMECHARS:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in NAMECHARS:
            j += 1
        name, k = text[i:j], j
        if k < len(text) and text[k] in "\"'":
            k += 1
        blanks = 0
        while k < len(text) and text[k].isspace() and blanks < 3:
            k, blanks = k + 1, blanks + 1
        mark = 2 if text[k : k + 2] == "=>" else 1 if text[k : k + 1] in (":", "=") and text[k : k + 1] else 0
        if mark and i >= until and secrets._patterns()[4].search(secrets.PARTS.sub("_", name).lower()):
            k += mark
            blanks = 0
            while k < len(text) and text[k].isspace() and blanks < 3:
                k, blanks = k + 1, blanks + 1
            if k < len(text) and text[k] in "\"'":
                k += 1
            e = k
            while e < len(text) and text[e] not in STOPS:
                e += 1
            if e - k >= 8:
                out.append((k, e))
                until = e
        i = j
    return out


def test_values_by_a_second_finder():
    r = random.Random(12)
    bits = ["pwd", "clientSecret", "note", "DB_PASSWORD", ":", "=", " => ", ": ", " ", "\n", "Zq8$kfP2!xWv9Lm3", "hunter2hunter2", "aaaaaaaaaa", "x&y=", "\"", "'", ",", ";", "secret", "2024-01-05xx", "-", "é"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        assert [v for v in secrets._values(text, secrets._patterns()) if "//" not in text and "</" not in text] == plain_values(text), text
        base, spans = secrets.find(text)
        until, want = 0, []
        for s, e in plain_values(text):
            if s < until:
                continue
            until, value = e, text[s:e].rstrip(".)]}")
            if len(value) >= 8 and not any(a <= s and s + len(value) <= b for a, _, b in base) and secrets.guess_cost(value) >= secrets.LEAST_GUESSES:
                want.append((s, 3, s + len(value)))
        assert [x for x in spans if x[1] == 3] == want, text


def test_an_early_end_decides_alike():
    r = random.Random(5)
    bits = ["a", "7", "qwerty", "2024", "admin", "P@ss", "zz", "ab", "ab", "$k", "monkey", "1999-12-31", "é", "X"]
    for _ in range(2000):
        v = "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))
        for enough in (3.0, 8.0):
            assert (secrets.guess_cost(v, enough=enough) >= enough) == (secrets.guess_cost(v) >= enough), v


@pytest.mark.parametrize("text,value", [
    ("$pass => 'Zq8$kfP2!xWv9Lm3'", "Zq8$kfP2!xWv9Lm3"), ("<password>Zq8$kfP2!xWv9Lm3</password>", "Zq8$kfP2!xWv9Lm3"),
    ("at postgres://bob:Zq8$kfP2xWv9Lm3@db:5432/x", "Zq8$kfP2xWv9Lm3"), ("<note>Zq8$kfP2!xWv9Lm3</note>", None), ("http://a.example:8080/x@y", None), ("ftp://bob:password@host/", None),
])
def test_contexts(text, value):
    assert [text[s:e] for s, k, e in secrets.find(text)[1] if k == 3] == ([value] if value else [])


@pytest.mark.parametrize("text", ["pwd=a&", "password=abcdefghijkl ", "token:", "<pwd>", "a://b:", "pwd=" + "a" * 999 + "&", "pwd: Zq8$kfP2!xWv9Lm3 "])
def test_long_texts_take_linear_time(text):
    took = []
    for n in (200_000, 1_600_000):
        begun = time.process_time()
        secrets.find(text * (n // len(text)))
        took.append(time.process_time() - begun)
    assert took[1] < 24 * max(took[0], 0.05)  # eight times the text; a square would be 64


def test_words_do_not_depend_on_the_number_of_rows(spark):
    rows = [(i, prose(i, 300) + (" Umbrella weather again." if i % 100 == 0 else ""), "en", "s", 0) for i in range(2000)]
    few, many = (secrets.dictionary(documents(spark, rows * k).select("text"), least=1, share=5e-4) for k in (1, 3))
    assert few == many and "umbrella" not in few and len(few) > 20
    assert "umbrella" in secrets.dictionary(documents(spark, rows), least=20, share=0.0)
