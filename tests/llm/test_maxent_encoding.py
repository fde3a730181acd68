"""Texts are encoded by one lookup per word, with the sums a count word by word gives."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from wayfare.llm.maxent_lm import LEAVES, Head, Vocabulary, _logits


def test_encoded_words_equal_a_plain_count():
    counts = {"": 9, "the": 40, "a": 12, "rare": 3}
    head = Head(Vocabulary(counts, {"": 0, "the": 1, "a": 2}, 80, 30))
    words = [b"the", b"new", b"rare", b"the", b"new", "é".encode(), b""]
    places, log, rare, known, other = head.encoded(words)
    leaf = lambda w: 3 + zlib.crc32(w) % LEAVES
    assert places.tolist() == [1, leaf(b"new"), leaf(b"rare"), 1, leaf(b"new"), leaf("é".encode()), 0]
    assert log == pytest.approx(2 * math.log10(41) + math.log10(4) + math.log10(10))
    assert rare == pytest.approx(math.log10(4)) and known == 4
    assert other == {b"new": 2, "é".encode(): 1}


def test_an_empty_vocabulary_knows_no_word():
    places, log, rare, known, other = Head(Vocabulary({}, {}, 0, 0)).encoded([b"x", b""])
    assert (log, rare, known, dict(other)) == (0.0, 0.0, 0, {b"x": 1, b"": 1}) and len(places) == 2


def test_logits_are_sums_of_rows():
    rng = np.random.default_rng(0)
    weights, bias = rng.random((50, 4), dtype=np.float32), rng.random((9, 4), dtype=np.float32)
    features = [rng.integers(0, 50, 9) for _ in range(3)]
    z = (weights[features[0]] + weights[features[1]] + weights[features[2]] + bias).T
    assert np.allclose(_logits(weights, bias, features), z - z.max(axis=0), atol=1e-6)
