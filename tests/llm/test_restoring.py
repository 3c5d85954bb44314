"""Restoring disguised words under a character model of a small vocabulary."""

from __future__ import annotations

import numpy as np
import pytest

from psephos.llm.toxicity import SYMBOLS, Restorer, symbol, trigram_costs

VOCABULARY = "you are an idiot and a stupid clown fool shit asshole ass the green house stands near a small river where people walk in the morning with their dogs"


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros(SYMBOLS**3)
    s = [0, 0, *map(symbol, VOCABULARY), 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        counts[(a * SYMBOLS + b) * SYMBOLS + c] += 50
    return Restorer(trigram_costs(counts))


@pytest.mark.parametrize("word, meant", [("idi07", "idiot"), ("id107", "idiot"), ("fo01", "fool"), ("57upid", "stupid"), ("455hole", "asshole"), ("shi+", "shit"), ("a$$", "ass"), ("(lown", "clown"), ("1d10t", "idiot"), ("57up1d!!", "stupid"), ("455h01e", "asshole")])
def test_substitutions_at_the_ends(restorer, word, meant):
    assert meant in restorer.word(word)


@pytest.mark.parametrize("word, meant", [("river,", "river"), ("(house)", "house"), ("idi0t.", "idiot"), ("walk", "walk"), ("dogs!!!", "dogs")])
def test_signs_around_words(restorer, word, meant):
    assert meant in restorer.word(word)


def test_no_letters_no_words(restorer):
    assert restorer.word("2024") == () and restorer.word("--") == ()


@pytest.mark.parametrize("n", [3, 40, 41, 200_000])
def test_long_runs(restorer, n):
    assert "idiot" in restorer.word("idi" + "o" * n + "t")


@pytest.mark.parametrize("word, meant", [("the-green-house-stands-near-a-small-river-where-idi0t-people-walk", "idiot"), ("you_are_an_id.i0t_in_the_morning_with_their_dogs_walk", "idiot")])
def test_joined_words(restorer, word, meant):
    assert meant in restorer.word(word)


@pytest.mark.parametrize("text", ["you idiot", "the green house stands near a small river idiot people walk in the morning"])
def test_spaced_stretches(restorer, text):
    assert "idiot" in restorer.spaced([c for c in text if c != " "])


def test_very_long_words(restorer):
    word = "id107-" * 50_000
    assert "idiot" in restorer.word(word)
