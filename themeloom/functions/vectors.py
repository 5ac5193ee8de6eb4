"""Arithmetic on ARRAY<DOUBLE> columns with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def number_array(values: Sequence[float]) -> Column:
    """Literal ARRAY<DOUBLE>. It is written as one string, which Spark folds into one constant: a
    literal for each number would take seconds to plan where there are thousands."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def linear_map(vector: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """``matrix`` (one sequence per result entry) times ``vector``."""
    rows = F.array(*[number_array(row) for row in matrix])
    return F.transform(rows, lambda row: dot(row, vector))


def quadratic_form(vector: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """``vector' matrix vector``."""
    return dot(linear_map(vector, matrix), vector)


def softmax_with_reference(eta: Column) -> Column:
    """Topic proportions of K-1 logits; the last topic has logit 0. Shifted by the
    maximum, so large logits do not overflow.

    Maximum and sum are taken by ``aggregate`` and handed to its closing step, so each
    is computed once per row and not once per entry."""
    logits = F.concat(eta, number_array([0.0]))
    shifted = F.aggregate(
        logits,
        F.lit(float("-inf")),
        lambda top, v: F.greatest(top, v),
        lambda top: F.transform(logits, lambda v: F.exp(v - top)),
    )
    return divided_by_total(shifted)


def divided_by_total(vector: Column) -> Column:
    """The vector scaled to sum to 1."""
    return F.aggregate(
        vector,
        F.lit(0.0),
        lambda acc, v: acc + v,
        lambda acc: F.transform(vector, lambda v: v / acc),
    )


def sum_vectors(vector: str, length: int) -> Column:
    """Aggregate: entry-wise sum of an array column of known length, partially
    summed before the shuffle like any other sum."""
    return F.array(*[F.sum(F.get(F.col(vector), F.lit(k))) for k in range(length)])


def sum_scaled(weight: Column, vector: str, length: int) -> Column:
    """Aggregate: entry-wise sum of ``weight * vector``."""
    return F.array(*[F.sum(weight * F.get(F.col(vector), F.lit(k))) for k in range(length)])
