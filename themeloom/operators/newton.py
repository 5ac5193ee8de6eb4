"""Search for the logits of many documents at once, and what follows from them: by Newton steps, or where there
are many topics by a limited memory of past steps, which needs no topics x topics matrix per step.

Shapes: b documents, n terms (padded with count 0), K topics. ``topics`` is b x n x K,
``counts`` b x n, ``eta`` and ``mu`` b x (K-1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from themeloom.constants import LARGE_TOPICS, LIMITED_MEMORY, LIMITED_ROUNDS, NEWTON_ROUNDS, SMALLEST_NORMAL


@dataclass(frozen=True)
class Inferred:
    eta: np.ndarray    # b x (K-1)
    bound: np.ndarray  # b
    nu: np.ndarray | None   # b x (K-1) x (K-1)
    phi: np.ndarray | None  # b x n x K


def _exponentials(eta: np.ndarray) -> np.ndarray:
    logits = np.concatenate([eta, np.zeros((len(eta), 1))], axis=1)
    return np.exp(logits - logits.max(axis=1, keepdims=True))


def _mix(topics: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.maximum(np.matmul(topics, weights[:, :, None])[:, :, 0], SMALLEST_NORMAL)


def objective(topics, counts, eta, mu, precision) -> np.ndarray:
    e = _exponentials(eta)
    off = eta - mu
    fit = (counts * np.log(_mix(topics, e))).sum(axis=1) - counts.sum(axis=1) * np.log(e.sum(axis=1))
    return 0.5 * ((off @ precision) * off).sum(axis=1) - fit


def derivatives(topics, counts, eta, mu, precision):
    """Gradient, Hessian, and expected topic counts per term."""
    e = _exponentials(eta)
    share = topics * e[:, None, :] / _mix(topics, e)[:, :, None]
    phi = counts[:, :, None] * share
    per_topic = phi.sum(axis=1)
    theta = e / e.sum(axis=1, keepdims=True)
    even = counts.sum(axis=1)[:, None] * theta
    slope = (eta - mu) @ precision - (per_topic - even)[:, :-1]
    curve = np.matmul(share.transpose(0, 2, 1), phi) - even[:, :, None] * theta[:, None, :]
    diagonal = np.arange(curve.shape[1])
    curve[:, diagonal, diagonal] -= per_topic - even
    return slope, curve[:, :-1, :-1] + precision, phi


def _step(curve: np.ndarray, slope: np.ndarray, eta: np.ndarray, length: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Newton step. Where the curvature is not positive definite, its concave part, that of the
    documents' mixture terms, is left out: what remains always is."""
    good = _positive(curve)
    if not good.all():
        e = _exponentials(eta[~good])
        theta = (e / e.sum(axis=1, keepdims=True))[:, :-1]
        even = length[~good, None] * theta
        convex = precision - even[:, :, None] * theta[:, None, :]
        diagonal = np.arange(convex.shape[1])
        convex[:, diagonal, diagonal] += even
        curve = curve.copy()
        curve[~good] = convex
    return np.linalg.solve(curve, slope[:, :, None])[:, :, 0]


def _positive(matrices: np.ndarray) -> np.ndarray:
    """Which matrices are positive definite."""
    try:
        np.linalg.cholesky(matrices)
        return np.ones(len(matrices), dtype=bool)
    except np.linalg.LinAlgError:
        if len(matrices) == 1:
            return np.zeros(1, dtype=bool)
        half = len(matrices) // 2
        return np.concatenate([_positive(matrices[:half]), _positive(matrices[half:])])


def gradient(topics, counts, eta, mu, precision) -> np.ndarray:
    """The slope alone: expected counts are summed over the terms without being kept."""
    e = _exponentials(eta)
    weight = counts / _mix(topics, e)
    per_topic = np.matmul(weight[:, None, :], topics)[:, 0, :] * e
    even = counts.sum(axis=1)[:, None] * e / e.sum(axis=1, keepdims=True)
    return (eta - mu) @ precision - (per_topic - even)[:, :-1]


def map_logits(topics, counts, eta, mu, precision) -> np.ndarray:
    """Logits that minimise the objective, starting from ``eta``."""
    return search(topics, counts, eta, mu, precision)[0]


def search(topics, counts, eta, mu, precision) -> tuple[np.ndarray, np.ndarray]:
    """The same, and which documents settled before the steps ran out."""
    if topics.shape[2] > LARGE_TOPICS:
        return limited_memory(topics, counts, eta, mu, precision)
    return newton_steps(topics, counts, eta, mu, precision)


def _taken(topics, counts, eta, mu, precision, step, gain, value, scale) -> np.ndarray:
    """How much of each step is taken: halved until the objective falls enough. Close to the minimum,
    where rounding hides the fall, all of it."""
    length = np.ones(len(eta))
    check = gain > 1e-9 * scale
    while check.any():
        trial = objective(topics[check], counts[check], eta[check] - length[check, None] * step[check], mu[check], precision)
        low = trial > value[check] - 1e-4 * length[check] * gain[check]
        halved = np.flatnonzero(check)[low]
        length[halved] *= 0.5
        check[:] = False
        check[halved[length[halved] > 1e-12]] = True
    return length


def newton_steps(topics, counts, eta, mu, precision) -> tuple[np.ndarray, np.ndarray]:
    """A document is done when the expected gain of a step is negligible."""
    result, settled = np.array(eta, dtype=float), np.zeros(len(eta), bool)
    open_rows = np.arange(len(result))
    eta = result.copy()
    for _ in range(NEWTON_ROUNDS):
        value = objective(topics, counts, eta, mu, precision)
        slope, curve, _ = derivatives(topics, counts, eta, mu, precision)
        step = _step(curve, slope, eta, counts.sum(axis=1), precision)
        gain = (slope * step).sum(axis=1)
        scale = 1.0 + np.abs(value)
        length = _taken(topics, counts, eta, mu, precision, step, gain, value, scale)
        eta = eta - length[:, None] * step
        result[open_rows] = eta
        going = gain > 1e-16 * scale
        settled[open_rows] = ~going
        if not going.any():
            break
        if np.count_nonzero(going) <= 0.75 * len(going):
            topics, counts, eta, mu = topics[going], counts[going], eta[going], mu[going]
            open_rows = open_rows[going]
    return result, settled


def limited_memory(topics, counts, eta, mu, precision) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton steps from the last ``LIMITED_MEMORY`` steps and changes of the slope, for all documents
    at once. The first guess of the curvature is the prior's and the proportions' diagonal."""
    result, settled = np.array(eta, dtype=float), np.zeros(len(eta), bool)
    open_rows = np.arange(len(result))
    eta = result.copy()
    slope = gradient(topics, counts, eta, mu, precision)
    past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # step, change of slope, 1 / their product or 0
    for _ in range(LIMITED_ROUNDS):
        value = objective(topics, counts, eta, mu, precision)
        e = _exponentials(eta)
        theta = (e / e.sum(axis=1, keepdims=True))[:, :-1]
        diagonal = np.diag(precision) + counts.sum(axis=1)[:, None] * theta * (1.0 - theta)
        step, shares = slope.copy(), []
        for s, y, inverse in reversed(past):
            share = inverse * (s * step).sum(axis=1)
            step -= share[:, None] * y
            shares.append(share)
        step /= diagonal
        for (s, y, inverse), share in zip(past, reversed(shares)):
            step += (share - inverse * (y * step).sum(axis=1))[:, None] * s
        gain = (slope * step).sum(axis=1)
        scale = 1.0 + np.abs(value)
        length = _taken(topics, counts, eta, mu, precision, step, gain, value, scale)
        moved = -length[:, None] * step
        eta = eta + moved
        result[open_rows] = eta
        after = gradient(topics, counts, eta, mu, precision)
        change, slope = after - slope, after
        bend = (moved * change).sum(axis=1)
        # A pair without positive curvature is left out for its document.
        usable = bend > 1e-12 * np.sqrt(np.square(moved).sum(axis=1) * np.square(change).sum(axis=1))
        past.append((moved, change, np.where(usable, 1.0 / np.where(usable, bend, 1.0), 0.0)))
        past = past[-LIMITED_MEMORY:]
        going = gain > 1e-19 * scale
        settled[open_rows] = ~going
        if not going.any():
            break
        if np.count_nonzero(going) <= 0.75 * len(going):
            topics, counts, eta, mu, slope = topics[going], counts[going], eta[going], mu[going], slope[going]
            past = [(s[going], y[going], inverse[going]) for s, y, inverse in past]
            open_rows = open_rows[going]
    return result, settled


def inverse_curvature(curve: np.ndarray, inverse: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """Inverse of each matrix and half the log of its determinant. A matrix that is not
    positive definite gets a dominant diagonal first: the larger of each entry and the sum
    of the other magnitudes in its row, and a little more."""
    try:
        lower = np.linalg.cholesky(curve)
    except np.linalg.LinAlgError:
        if len(curve) > 1:
            parts = [inverse_curvature(one[None], inverse) for one in curve]
            return np.concatenate([p[0] for p in parts]) if inverse else None, np.concatenate([p[1] for p in parts])
        matrix = curve[0].copy()
        diagonal = np.diag(matrix)
        others = np.abs(matrix).sum(axis=1) - np.abs(diagonal)
        raised = np.maximum(diagonal, others)
        np.fill_diagonal(matrix, raised + 1e-8 * max(1.0, raised.max()))
        curve = matrix[None]
        lower = np.linalg.cholesky(curve)
    half = np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    return np.linalg.inv(curve) if inverse else None, half


def evaluate(topics, counts, eta, mu, precision, entropy, sums: bool = True) -> Inferred:
    """Posterior covariance, expected counts and bound at ``eta``; without ``sums`` the bound alone."""
    _, curve, phi = derivatives(topics, counts, eta, mu, precision)
    nu, half_log = inverse_curvature(curve, sums)
    bound = -objective(topics, counts, eta, mu, precision) - half_log - entropy
    return Inferred(eta, bound, nu, phi if sums else None)
