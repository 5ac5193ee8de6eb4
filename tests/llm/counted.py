"""Scores of texts from counted words and pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest


def level_means(counts):
    """The mean count of each level."""
    of = {}
    for n in counts.values():
        of.setdefault(n.bit_length(), []).append(n)
    return {0: 0.0, **{k: sum(v) / len(v) for k, v in of.items()}}


def exact_scores(texts, trained, prior):
    """Scores by the counts themselves, from words of each text; the end is None."""
    every = {k: [None, *t, None] for k, t in texts.items()}
    words = Counter(w for k in trained for w in every[k][1:])
    pairs = Counter(p for k in trained for p in zip(every[k], every[k][1:]))
    word, pair = level_means(words), level_means(pairs)
    total = sum(words.values()) + len(words) + 1
    seen = lambda w: word[words[w].bit_length()]
    # The words' own probabilities, with the unseen word's, sum to 1.
    assert sum((seen(w) + 1) / total for w in words) + 1 / total == pytest.approx(1)

    def chance(a, b):
        both = min(pair[pairs[a, b].bit_length()], seen(a), seen(b))
        return (both + prior * (seen(b) + 1) / total) / (seen(a) + prior)

    return {k: sum(np.log10(chance(a, b)) for a, b in zip(t, t[1:])) for k, t in every.items()}
