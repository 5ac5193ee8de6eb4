"""Anchor terms: the rows of the normalised co-occurrence matrix that span its topics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F

from themeloom.constants import TIE_DIGITS
from themeloom.functions import dot, linear_map, number_array
from themeloom.lookup import lookup_join
from themeloom.operators.products import VECTOR_BYTES, NormalisedGram, dense_rows
from themeloom.operators.recover import row_by_anchor
from themeloom.workspace import Workspace

CELLS_PER_PART = 1 << 18
MOST_PARTS = 16384
MOST_AHEAD = 32


def row_norms(cells: DataFrame) -> DataFrame:
    """(i, r): squared length of every row."""
    return cells.groupBy("i").agg(F.sum(F.col("q") * F.col("q")).alias("r"))


def argmax_row(norms: DataFrame) -> DataFrame:
    """The row with the largest norm; the smallest index wins a tie."""
    return largest_rows(norms, 1)


def largest_rows(norms: DataFrame, rows: int) -> DataFrame:
    """The rows with the largest norms, in order. One pass that keeps as many candidates per
    task, not a sort. Norms are compared at 12 decimals: whether two equal rows tie must not
    depend on the order in which their cells were summed."""
    return norms.orderBy(F.desc(F.round("r", TIE_DIGITS)), F.asc("i")).limit(rows)


@dataclass(frozen=True)
class Anchors:
    """``picks``: the anchor term ids in pick order. ``products``: (term_id, products), the
    inner products of every row with the K anchor rows."""

    picks: list[int]
    products: DataFrame

    def table(self) -> DataFrame:
        """(rank, term_id), rank from 1."""
        spark = self.products.sparkSession
        return spark.createDataFrame(list(enumerate(self.picks, 1)), "rank INT, term_id INT")


def find_anchors(space: Workspace, cells: DataFrame, topics: int, terms: int) -> Anchors:
    """Anchors of a stored row-normalised matrix (i, j, q), which is never rewritten: picks join it
    once to the picked rows."""
    # Every round groups by i again: partition and cache once, by the number of stored cells and
    # not by the session's usual number. In order, so that reading one row skips the cached
    # batches without it.
    parts = max(1, min(MOST_PARTS, cells.count() // CELLS_PER_PART))
    rows = cells.repartition(parts, "i").sortWithinPartitions("i").persist()
    ahead = _ahead(terms, VECTOR_BYTES)
    try:
        return _search(
            space,
            row_norms(rows),
            (lambda picks: dense_rows(rows, picks, terms)) if ahead > 1 else None,
            lambda picks, _: row_by_anchor(rows, picks, terms),
            topics,
            terms,
            ahead,
        )
    finally:
        rows.unpersist()


def find_corpus_anchors(
    space: Workspace, matrix: NormalisedGram, norms: DataFrame, topics: int, ahead: int | None = None
) -> Anchors:
    """Anchors without the matrix: ``norms`` (i, r) are the squared lengths of its rows, and picks take
    two sparse passes over the documents, for the candidates' rows and for the products with those picked."""
    ahead = ahead or _ahead(matrix.terms, matrix.limit)
    dense = matrix.dense_rows if ahead > 1 else None
    return _search(space, norms, dense, matrix.with_rows, topics, matrix.terms, ahead)


def _ahead(terms: int, limit: int) -> int:
    """Candidates whose rows the driver may hold."""
    return max(1, min(MOST_AHEAD, limit // (8 * max(1, terms))))


def _search(
    space: Workspace,
    norms: DataFrame,
    dense: Callable[[list[int]], np.ndarray] | None,
    products: Callable[[list[int], np.ndarray | None], DataFrame],
    topics: int,
    terms: int,
    ahead: int,
) -> Anchors:
    """Pick ``topics`` rows one after another: each time the row with the largest part
    outside the span of the rows picked before.

    Every row keeps its squared residual ``r``, its coordinates ``along`` the picked directions and its
    inner products with the picked rows. With the picked row a,

        next coordinate = (product - along . along_a) / sqrt(r_a),   r -= coordinate^2.

    Residuals only shrink. So the driver takes the rows of the ``ahead`` largest residuals (``dense``, as columns),
    and picks among them as long as the best one stays above the largest residual of all other rows: these
    are the picks that a search over all rows makes. Then one job takes all rows' products with
    the picked ones and stores the state, one row per term. What reaches the driver are the candidates' rows,
    which are bounded, and their coordinates; with ``ahead`` 1 only the latter.
    """
    space = space.part()
    state = norms.select(
        "i",
        "r",
        F.lit(False).alias("picked"),
        F.array().cast("array<double>").alias("along"),
        F.array().cast("array<double>").alias("products"),
    )
    state, picks, number = space.table(state, "state_0"), [], 0
    while len(picks) < topics:
        best = largest_rows(state.where("not picked").select("i", "r", "along"), ahead + 1).collect()
        if not best or best[0]["r"] <= 0.0:
            raise ValueError(f"only {len(picks)} independent co-occurrence rows, {topics} topics asked for")
        rest = _key(best[ahead]["r"], best[ahead]["i"]) if len(best) > ahead else (0.0, 0)
        best = best[:ahead]
        held = dense([b["i"] for b in best]) if dense and len(best) > 1 else None
        chosen, lower = _chosen(best, held, rest, topics - len(picks))
        new = [best[c]["i"] for c in chosen]
        size = len(chosen)
        # lower (coordinates) = products - along_a . along, for the new picks a together.
        inverse = np.linalg.inv(lower)
        before = np.array([best[c]["along"] for c in chosen]).reshape(size, len(picks))
        step = np.hstack([inverse, -inverse @ before])
        found = products(new, None if held is None else held[:, chosen])
        found = found.select(F.col("term_id").alias("i"), F.col("products").alias("new"))
        joined = lookup_join(state, found, "i", (16 + 8 * size) * terms, spread="i", how="left")
        joined = joined.withColumn("new", F.coalesce("new", number_array([0.0] * size)))
        joined = joined.withColumn("coordinates", linear_map(F.concat("new", "along"), step.tolist()))
        picks += new
        number += 1
        state = space.table(
            joined.select(
                "i",
                (F.col("r") - dot(F.col("coordinates"), F.col("coordinates"))).alias("r"),
                (F.col("picked") | F.col("i").isin(new)).alias("picked"),
                F.concat("along", "coordinates").alias("along"),
                F.concat("products", "new").alias("products"),
            ),
            f"state_{number}",
        )
        space.drop(f"state_{number - 1}")
    return Anchors(picks, state.select(F.col("i").alias("term_id"), "products"))


def _key(r: float, i: int) -> tuple[float, int]:
    """Orders rows as ``largest_rows`` does, the best one last."""
    return round(r, TIE_DIGITS), -i


def _chosen(best: list[Row], rows: np.ndarray | None, rest: tuple[float, int], most: int) -> tuple[list[int], np.ndarray]:
    """The picks among the candidates, in order, and the lower triangle of their coordinates along the
    new directions: entry (t, u) that of pick t along u."""
    left = np.array([b["r"] for b in best])
    if rows is None:
        return [0], np.array([[math.sqrt(left[0])]])
    along = np.array([b["along"] for b in best]).reshape(len(best), -1)
    cross = rows.T @ rows - along @ along.T
    new = np.zeros((len(best), 0))
    chosen: list[int] = []
    while len(chosen) < min(most, len(best)):
        pick = max((c for c in range(len(best)) if c not in chosen), key=lambda c: _key(left[c], best[c]["i"]))
        if chosen and (_key(left[pick], best[pick]["i"]) <= rest or left[pick] <= 0.0):
            break
        chosen.append(pick)
        coordinate = (cross[:, pick] - new @ new[pick]) / math.sqrt(left[pick])
        new = np.column_stack([new, coordinate])
        left = left - coordinate * coordinate
    return chosen, np.tril(new[chosen])
