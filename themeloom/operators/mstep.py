"""Updates of prior mean, prior covariance and topics."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.constants import RIDGE_ROUNDS, RIDGE_TOLERANCE
from themeloom.functions import number_array, sum_vectors
from themeloom.operators.aggregate import cross_products, small_matrix
from themeloom.operators.covariates import Vectors
from themeloom.operators.ragged import list_column
from themeloom.operators.recover import topic_normalised


@dataclass(frozen=True)
class Moments:
    """Sums of products over all documents: all the M-step needs of covariates and logits."""

    xx: np.ndarray  # D x D
    xy: np.ndarray  # D x (K-1)
    yy: np.ndarray  # (K-1) x (K-1)
    documents: int

    @staticmethod
    def of(both: np.ndarray, covariates: int, documents: int) -> Moments:
        d = covariates
        return Moments(both[:d, :d], both[:d, d:], both[d:, d:], documents)


def moment_table(covariates: DataFrame, eta: DataFrame, width: int) -> DataFrame:
    """(i, vec): summed products of the vector (x, eta) of each document."""
    joined = covariates.select("doc_id", "x").join(eta.select("doc_id", "eta"), "doc_id")
    return cross_products(joined.select(F.concat("x", "eta").alias("both")), "both", width)


def moments(covariates: DataFrame, eta: DataFrame, columns: int, topics: int) -> Moments:
    width = columns + topics - 1
    table = moment_table(covariates, eta, width)
    documents = eta.count()
    return Moments.of(small_matrix(table, width), columns, documents)


def ridge_coefficients(sums: Moments) -> np.ndarray:
    """D x (K-1) coefficients of a variational ridge regression per topic, whose first
    covariate is an intercept without penalty. Works on the summed products only.

    The penalty depends on the scale of the covariates: ``design`` brings them to one.
    """
    columns, topics = sums.xy.shape
    if columns == 1:
        return sums.xy / sums.xx[0, 0]  # the mean: there is nothing to penalise
    return np.column_stack([_ridge(sums, k) for k in range(topics)])


def _ridge(sums: Moments, k: int) -> np.ndarray:
    xx, xy, yy = sums.xx, sums.xy[:, k], sums.yy[k, k]
    columns = len(xy)
    shape = (1.0 + sums.documents) / 2.0
    penalty, noise_rate, noise = float(columns), 1.0, 1.0
    w = np.zeros(columns)
    for _ in range(RIDGE_ROUNDS):
        diagonal = np.full(columns, penalty)
        diagonal[0] = 0.0
        spread = np.linalg.inv(np.diag(diagonal) + noise * xx)
        previous, w = w, noise * (spread @ xy)
        squares = max(0.0, yy - 2.0 * (w @ xy) + w @ xx @ w)
        noise = shape / (0.5 * (squares + np.sum(spread * xx)) + noise_rate)
        noise_rate = 1.0 / (noise + 1.0)
        energy = w[1:] @ w[1:] + np.diag(spread)[1:].sum()
        penalty = columns / (4.0 / (penalty + 1.0) + energy)
        if np.abs(w - previous).sum() <= RIDGE_TOLERANCE:
            return w
    warnings.warn(f"coefficients of topic {k} still moved after {RIDGE_ROUNDS} updates", stacklevel=3)
    return w


@dataclass(frozen=True)
class SparseMoments:
    """The same where x is sparse: ``xx`` as cells with i <= j."""

    i: np.ndarray
    j: np.ndarray
    v: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    documents: int

    def xx_times(self, w: np.ndarray) -> np.ndarray:
        """Product of the matrix with a vector or with columns."""
        found, off = np.zeros_like(w), self.i != self.j
        weight = self.v.reshape(-1, *[1] * (w.ndim - 1))
        np.add.at(found, self.i, weight * w[self.j])
        np.add.at(found, self.j[off], weight[off] * w[self.i[off]])
        return found


def sparse_products(covariates: DataFrame) -> DataFrame:
    """(i, j, v): cells i <= j of the summed products of sparse vectors. A document adds a cell per pair of
    its own entries, and tasks add those up before the shuffle."""
    entry = F.explode(F.arrays_zip(F.col("x.at").alias("i"), F.col("x.v").alias("a")))
    left = covariates.select("x", entry.alias("e"))
    right = F.explode(F.arrays_zip(F.col("x.at").alias("j"), F.col("x.v").alias("b")))
    pairs = left.select("e", right.alias("f")).where("e.i <= f.j")
    return pairs.groupBy("e.i", "f.j").agg(F.sum(F.col("e.a") * F.col("f.b")).alias("v"))


def sparse_moments(cells: DataFrame, xy: np.ndarray, yy: np.ndarray, documents: int) -> SparseMoments:
    found = cells.select("i", "j", "v").toArrow()
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    return SparseMoments(i.astype(np.int64), j.astype(np.int64), v, xy, yy, documents)


def sparse_ridge_coefficients(sums: SparseMoments) -> np.ndarray:
    """The regression of ``ridge_coefficients`` without the covariates' square matrix or its inverse.

    Indicators of one column's levels never occur together, so their block of the matrix is diagonal. A set of
    columns without common documents, as large as a greedy choice makes it, is eliminated; a dense system is left for
    the others alone. What the updates need of the inverse is its diagonal, since

        trace (inverse x'x) = (columns - sum of penalty times diagonal) / noise."""
    columns, topics = sums.xy.shape
    if columns == 1:
        return sums.xy / sums.v[0]
    apart = _apart(sums, columns)
    rest = np.setdiff1d(np.arange(columns), apart)
    place = np.empty(columns, np.int64)
    place[apart], place[rest] = np.arange(len(apart)), np.arange(len(rest))
    inside = np.isin(np.arange(columns), apart)
    own = np.zeros(len(apart))
    both = inside[sums.i] & inside[sums.j]
    own[place[sums.i[both]]] = sums.v[both]
    dense = np.zeros((len(rest), len(rest)))
    among = ~inside[sums.i] & ~inside[sums.j]
    dense[place[sums.i[among]], place[sums.j[among]]] = sums.v[among]
    dense[place[sums.j[among]], place[sums.i[among]]] = sums.v[among]
    border = np.zeros((len(apart), len(rest)))
    one, two = inside[sums.i] & ~inside[sums.j], ~inside[sums.i] & inside[sums.j]
    border[place[sums.i[one]], place[sums.j[one]]] = sums.v[one]
    border[place[sums.j[two]], place[sums.i[two]]] = sums.v[two]

    def solve(penalty: float, noise: float, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and the diagonal of the inverse."""
        free = np.where(rest == 0, 0.0, penalty)
        alone, edge = penalty + noise * own, noise * border
        scaled = edge / alone[:, None]
        left = np.linalg.inv(np.diag(free) + noise * dense - edge.T @ scaled)
        w, diagonal = np.empty(columns), np.empty(columns)
        w[rest] = left @ (noise * xy[rest] - scaled.T @ (noise * xy[apart]))
        w[apart] = (noise * xy[apart] - edge @ w[rest]) / alone
        diagonal[rest] = np.diag(left)
        diagonal[apart] = 1.0 / alone + ((scaled @ left) * scaled).sum(axis=1)
        return w, diagonal

    return np.column_stack([_sparse_ridge(sums, k, solve) for k in range(topics)])


def _apart(sums: SparseMoments, columns: int) -> np.ndarray:
    """Columns, intercept excluded, no two of which occur in one document; those with few neighbours first."""
    off = (sums.i != sums.j) & (sums.v != 0.0)
    i, j = np.concatenate([sums.i[off], sums.j[off]]), np.concatenate([sums.j[off], sums.i[off]])
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    start = np.searchsorted(i, np.arange(columns + 1))
    taken, blocked = [], np.zeros(columns, bool)
    blocked[0] = True
    for column in np.argsort(np.diff(start), kind="stable").tolist():
        if not blocked[column]:
            taken.append(column)
            blocked[j[start[column] : start[column + 1]]] = True
    return np.sort(np.array(taken, np.int64))


def _sparse_ridge(sums: SparseMoments, k: int, solve) -> np.ndarray:
    xy, yy = sums.xy[:, k], sums.yy[k, k]
    columns = len(xy)
    shape = (1.0 + sums.documents) / 2.0
    penalty, noise_rate, noise = float(columns), 1.0, 1.0
    w = np.zeros(columns)
    for _ in range(RIDGE_ROUNDS):
        previous, (w, diagonal) = w, solve(penalty, noise, xy)
        squares = max(0.0, yy - 2.0 * (w @ xy) + w @ sums.xx_times(w))
        spread = (columns - penalty * diagonal[1:].sum()) / noise
        noise = shape / (0.5 * (squares + spread) + noise_rate)
        noise_rate = 1.0 / (noise + 1.0)
        penalty = columns / (4.0 / (penalty + 1.0) + w[1:] @ w[1:] + diagonal[1:].sum())
        if np.abs(w - previous).sum() <= RIDGE_TOLERANCE:
            return w
    warnings.warn(f"coefficients of topic {k} still moved after {RIDGE_ROUNDS} updates", stacklevel=3)
    return w


def prior_mean(covariates: DataFrame, gamma: np.ndarray) -> DataFrame:
    """(doc_id, mu): covariates, dense or sparse, times coefficients, which are sent to the tasks."""
    spark = covariates.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(gamma))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mu = Vectors(batch.column("x")).times(shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(mu)], names=["doc_id", "mu"])

    return covariates.select(F.col("doc_id").cast("bigint").alias("doc_id"), "x").mapInArrow(
        multiply, "doc_id BIGINT, mu ARRAY<DOUBLE>"
    )


def residual_scatter(eta: DataFrame, mu: DataFrame, size: int) -> DataFrame:
    """(i, vec): sum of (eta - mu)(eta - mu)' over the documents."""
    joined = eta.select("doc_id", "eta").join(mu.select("doc_id", "mu"), "doc_id")
    off = F.zip_with("eta", "mu", lambda e, m: e - m)
    return cross_products(joined.select(off.alias("off")), "off", size)


def scatter_from_moments(sums: Moments | SparseMoments, gamma: np.ndarray) -> np.ndarray:
    """The same for mu = covariates times ``gamma``, without another pass."""
    cross = gamma.T @ sums.xy
    square = sums.xx @ gamma if isinstance(sums, Moments) else sums.xx_times(gamma)
    return sums.yy - cross - cross.T + gamma.T @ square


def prior_covariance(scatter: np.ndarray, nu: np.ndarray, documents: int, shrink: float) -> np.ndarray:
    full = (scatter + nu) / documents
    return shrink * np.diag(np.diag(full)) + (1.0 - shrink) * full


def prior_covariance_table(scatter: DataFrame, nu: DataFrame, documents: int, shrink: float) -> DataFrame:
    """(i, j, v): the same from tables of rows (i, vec)."""
    both = scatter.join(nu.select("i", F.col("vec").alias("nu")), "i")
    cells = both.select(
        "i",
        F.posexplode(F.zip_with("vec", "nu", lambda a, b: (a + b) / documents)).alias("j", "v"),
    )
    kept = F.when(F.col("i") == F.col("j"), F.col("v")).otherwise((1.0 - shrink) * F.col("v"))
    return cells.select("i", "j", kept.alias("v"))


def topic_update(phi: DataFrame, topics: int, totals: Sequence[float] | None = None) -> DataFrame:
    """(term_id, b): expected counts summed over the aspects, every topic scaled to 1. With the ``totals``
    of the topics the counts are read once."""
    summed = phi.groupBy("term_id").agg(sum_vectors("phi", topics).alias("phi"))
    if totals is None:
        return topic_normalised(summed, "phi", topics)
    return summed.select("term_id", F.zip_with("phi", number_array(totals), lambda v, t: v / t).alias("b"))
