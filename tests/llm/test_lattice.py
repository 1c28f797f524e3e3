"""Viterbi decoding of character lattices against all paths, one by one."""

from __future__ import annotations

import itertools
import random

import numpy as np

from clauselake.llm import toxicity

WORDS = frozenset({"idiot", "loser", "scum", "stupid", "all", "boss", "ass"})


def model():
    return toxicity.language_model(np.random.default_rng(7).integers(0, 50, (28, 28, 28)).astype(float))


def paths(word):
    """Every string the lattice holds with its cost."""
    for choice in itertools.product(*toxicity.lattice(word)):
        yield "".join(x for x, _ in choice), [c for _, c in choice]


def plain(word, language, known):
    """The best string over all paths; equal strings take their best path."""
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    best = []
    for text, costs in paths(word):
        a = b = 0
        score = sum(costs)
        for c in text:
            score += language[a, b, code(c)]
            a, b = b, code(c)
        best.append((score + language[a, b, 0] + 6 * (text in known), text))
    return max(best)


def tokens():
    rng = random.Random(3)
    out = ["1d10t", "l0ooser", "$cum", "5tuupid", "a11", "b0ss", "a$$", "4$s", "idioot", "scumm", "77", "xyz"]
    return out + ["".join(rng.choices("ab1l0s$5ooio", k=rng.randrange(1, 8))) for _ in range(300)]


def test_decoding_equals_all_paths():
    language = model()
    for word in tokens():
        if not list(toxicity.lattice(word)):
            continue
        many = toxicity.decode(word, language, WORDS.__contains__, keep=10_000)
        assert many == plain(word, language, WORDS)[1], word


def test_a_known_word_is_reached_exactly_if_a_path_spells_it():
    restorer = toxicity.Restorer(model(), WORDS)
    for word in tokens():
        assert restorer._reaches(word) == any(t in WORDS for t, _ in paths(word)), word


def test_tokens_that_reach_no_known_word_are_left_without_decoding(monkeypatch):
    restorer = toxicity.Restorer(model(), WORDS)
    monkeypatch.setattr(toxicity, "decode", None)
    assert restorer.words("book 1234 teeth nothing")[0] == ["book", "1234", "teeth", "nothing"]
