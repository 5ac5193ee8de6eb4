"""Topics from anchor terms, and the first state of the model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.constants import (
    INITIAL_VARIANCE,
    SIMPLEX_ROUNDS,
    SIMPLEX_SLACK,
    SIMPLEX_STEP,
    SIMPLEX_TOLERANCE,
    SMALLEST_DOUBLE,
)
from themeloom.functions import number_array, sum_scaled, sum_vectors
from themeloom.lookup import lookup_join
from themeloom.operators.ragged import list_column, square


def anchor_rows(cells: DataFrame, picks: list[int]) -> DataFrame:
    """Submatrix of the anchor rows, transposed: (j, x), x[k] the cell of anchor k."""
    ours = cells.where(F.col("i").isin(picks))
    per_anchor = [F.sum(F.when(F.col("i") == a, F.col("q")).otherwise(0.0)) for a in picks]
    return ours.groupBy("j").agg(F.array(*per_anchor).alias("x"))


def row_by_anchor(cells: DataFrame, picks: list[int], terms: int) -> DataFrame:
    """(term_id, products): inner products of every row with every anchor row, in one pass
    over the matrix."""
    x = anchor_rows(cells, picks)
    joined = lookup_join(cells, x, "j", terms * (16 + 8 * len(picks)), spread="i", how="left")
    joined = joined.withColumn("x", F.coalesce("x", number_array([0.0] * len(picks))))
    return joined.groupBy(F.col("i").alias("term_id")).agg(
        sum_scaled(F.col("q"), "x", len(picks)).alias("products")
    )


def anchor_cross(products: DataFrame, picks: list[int]) -> DataFrame:
    """(k1, k2, v): inner products of the anchor rows with each other."""
    order = F.array_position(F.array(*[F.lit(a) for a in picks]), F.col("term_id")) - 1
    ours = products.where(F.col("term_id").isin(picks)).select(order.cast("int").alias("k1"), "products")
    return ours.select("k1", F.posexplode("products").alias("k2", "v"))


def simplex_weights(products: DataFrame, picks: list[int]) -> DataFrame:
    """(term_id, weights): every row as a mixture of the anchor rows.

    Exponentiated gradient on the simplex from equal weights. The anchors' own K x K
    products go to every task; terms are solved together, a batch as one matrix. Anchor
    terms get weight 1 on themselves.
    """
    topics = len(picks)
    cross = np.zeros((topics, topics))
    for cell in anchor_cross(products, picks).collect():
        cross[cell["k1"], cell["k2"]] = cell["v"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                weights = _simplex(square(batch.column("products")), cross)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("term_id"), list_column(weights)], names=["term_id", "weights"]
                )

    parts = products.sparkSession.sparkContext.defaultParallelism
    solved = (
        products.select("term_id", "products")
        .repartition(parts, "term_id")
        .mapInArrow(solve, "term_id INT, weights ARRAY<DOUBLE>")
    )
    return anchor_one_hot(solved, picks)


def anchor_one_hot(weights: DataFrame, picks: list[int]) -> DataFrame:
    """Replace the weights of anchor terms by unit vectors."""
    position = F.array_position(F.array(*[F.lit(a) for a in picks]), F.col("term_id"))
    unit = F.transform(
        F.sequence(F.lit(1), F.lit(len(picks))),
        lambda k: F.when(k == position, 1.0).otherwise(0.0),
    )
    return weights.withColumn("weights", F.when(position > 0, unit).otherwise(F.col("weights")))


def _simplex(target: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights per row of ``target`` (its products with the anchors). An update that would
    raise the squared error is not taken; that row goes on with half the step. Without this
    the fixed step overshoots where anchor rows are long, and rounding decides the result."""
    weights = np.full(target.shape, 1.0 / target.shape[1])
    active = np.arange(len(target))
    before = np.full(len(target), np.inf)
    step = np.full(len(target), 2.0 * SIMPLEX_STEP)
    for _ in range(SIMPLEX_ROUNDS):
        now, aim = weights[active], target[active]
        slope = aim - now @ cross
        size = np.sqrt(np.square(slope).sum(axis=1))
        scaled = slope * step[:, None]
        moved = now * np.exp(scaled - scaled.max(axis=1, keepdims=True))
        moved /= moved.sum(axis=1, keepdims=True)
        taken = _error(moved, aim, cross) <= _error(now, aim, cross) + SIMPLEX_SLACK
        weights[active[taken]] = moved[taken]
        step[~taken] *= 0.5
        going = ~(taken & (np.abs(before - size) < SIMPLEX_TOLERANCE))
        before[taken] = size[taken]
        active, before, step = active[going], before[going], step[going]
        if not len(active):
            break
    return weights


def _error(weights: np.ndarray, target: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Half the squared error, up to a constant per row."""
    return 0.5 * (weights * (weights @ cross)).sum(axis=1) - (weights * target).sum(axis=1)


def recover_topics(weights: DataFrame, probability: DataFrame, topics: int, terms: int) -> DataFrame:
    """(term_id, b): topic-word probabilities. ``b[k]`` is proportional to the weight of
    topic k times the probability of the term, and sums to 1 over the terms."""
    joined = lookup_join(weights, probability, "term_id", 16 * terms, spread="term_id")
    mass = joined.select(
        "term_id", F.transform("weights", lambda w: w * F.col("prob")).alias("mass")
    )
    return topic_normalised(mass, "mass", topics)


def topic_normalised(df: DataFrame, column: str, topics: int) -> DataFrame:
    """(term_id, b): entry k of the array column divided by its sum over all terms."""
    totals = df.agg(sum_vectors(column, topics)).scalar()
    return df.withColumn("_totals", totals).select(
        "term_id", F.zip_with(column, "_totals", lambda v, t: v / t).alias("b")
    )


def refill(topics_table: DataFrame, vocab: DataFrame, topics: int, terms: int) -> DataFrame:
    """Give terms left out of the recovery the smallest positive probability and scale
    every topic to 1 again."""
    joined = lookup_join(
        vocab.select("term_id"), topics_table, "term_id", terms * (16 + 8 * topics), "term_id", "left"
    )
    floor = number_array([SMALLEST_DOUBLE] * topics)
    return topic_normalised(
        joined.select("term_id", F.coalesce("b", floor).alias("b")), "b", topics
    )


def per_aspect(topics_table: DataFrame, aspects: int) -> DataFrame:
    """One copy of the topics for every aspect: (aspect, term_id, b)."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(aspects - 1)))
    return topics_table.select(numbers.alias("aspect"), "term_id", "b")


def initial_logits(documents: DataFrame, topics: int) -> DataFrame:
    """(doc_id, eta, mu): all zero at the start, for every document."""
    zeros = number_array([0.0] * (topics - 1))
    return documents.select("doc_id", zeros.alias("eta"), zeros.alias("mu"))


def initial_covariance(topics: int) -> np.ndarray:
    return INITIAL_VARIANCE * np.eye(topics - 1)


def long_topics(topics_table: DataFrame) -> DataFrame:
    """(topic, term_id, prob) of (term_id, b)."""
    keep = [c for c in topics_table.columns if c not in ("term_id", "b")]
    return topics_table.select(*keep, "term_id", F.posexplode("b").alias("topic", "prob"))


