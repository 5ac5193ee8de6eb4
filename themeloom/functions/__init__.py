"""Column expressions shared by the operators."""

from themeloom.functions.vectors import (
    divided_by_total,
    dot,
    linear_map,
    number_array,
    quadratic_form,
    softmax_with_reference,
    sum_vectors,
    sum_scaled,
)

__all__ = [
    "divided_by_total",
    "dot",
    "linear_map",
    "number_array",
    "quadratic_form",
    "softmax_with_reference",
    "sum_scaled",
    "sum_vectors",
]
