"""Matrices by their definition, for comparisons."""

from __future__ import annotations

import numpy as np


def gram_of(counts: np.ndarray) -> np.ndarray:
    """Co-occurrences by their definition."""
    n = counts.sum(axis=1)
    kept, n = counts[n >= 2].astype(float), n[n >= 2]
    pairs = (n * (n - 1))[:, None]
    return kept.T @ (kept / pairs) - np.diag((kept / pairs).sum(axis=0))


def matrix_of(cells, size: int, row="i", column="j", value="q") -> np.ndarray:
    matrix = np.zeros((size, size))
    for c in cells.collect():
        matrix[c[row], c[column]] = c[value]
    return matrix
