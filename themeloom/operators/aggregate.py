"""Sums over the documents after inference."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.functions import sum_vectors
from themeloom.operators.ragged import list_column, ragged, square

BOUND_UNITS = 1 << 20
MERGE_TASKS = 64


def _row_sums(result: DataFrame, kind: str, size: int) -> DataFrame:
    return (
        result.where(F.col("kind") == kind)
        .groupBy(F.col("idx").alias("i"))
        .agg(sum_vectors("vec", size).alias("vec"))
    )


def nu_sum(result: DataFrame, size: int) -> DataFrame:
    """(i, vec): rows of the summed posterior covariances."""
    return _row_sums(result, "nu", size)


def moment_sum(result: DataFrame, width: int) -> DataFrame:
    """(i, vec): rows of the summed products of covariates and logits."""
    return _row_sums(result, "moment", width)


def crossed(result: DataFrame, covariates: int, size: int) -> np.ndarray:
    """Summed products of sparse covariates with logits: as many numbers as coefficients."""
    found = np.zeros((covariates, size))
    for batch in _row_sums(result, "cross", size).toArrow().combine_chunks().to_batches():
        found[batch.column("i").to_numpy()] = square(batch.column("vec"))
    return found


def stacked_logits(result: DataFrame) -> DataFrame:
    """(doc_id, eta): stays a distributed table, told apart by id and not by order."""
    return result.where(F.col("kind") == "doc").select("doc_id", F.col("vec").alias("eta"))


def total_bound(result: DataFrame) -> DataFrame:
    """(documents, bound). Bounds are added as multiples of 2^-20, which is exact: the sum does not depend on the
    order of the documents."""
    whole = F.rint(F.col("bound") * F.lit(float(BOUND_UNITS))).cast("decimal(38,0)")
    return result.where(F.col("kind") == "doc").agg(
        F.count(F.lit(1)).alias("documents"), (F.sum(whole).cast("double") / BOUND_UNITS).alias("bound")
    )


@dataclass(frozen=True)
class IterationSums:
    """What the M-step needs of all documents, in one place: nothing here grows with them."""

    documents: int
    unsettled: int
    bound: float
    nu: np.ndarray      # (K-1) x (K-1)
    moment: np.ndarray  # of (x, eta)
    weight: np.ndarray  # K


def iteration_sums(result: DataFrame, size: int, width: int) -> IterationSums:
    """All sums of a stored result of inference in one job. Tasks add the partial sums they read to one typed
    row each, ``MERGE_TASKS`` of them at most, and the driver adds those. Of the documents only bounds
    are read, and they are added as ``total_bound`` does."""
    def part(kinds: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
        given = result.where(F.col("kind").isin(*kinds))
        none = {c: F.lit(None).cast(result.schema[c].dataType) for c in ("idx", "vec", "bound") if c not in columns}
        return given.select("kind", *[none.get(c, F.col(c)).alias(c) for c in ("idx", "vec", "bound")])

    rows = part(("doc", "unsettled"), ("bound",)).unionByName(part(("nu", "moment", "weight"), ("idx", "vec")))
    sizes = {"nu": (size, size), "moment": (width, width), "weight": (1, size + 1)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {kind: np.zeros(shape) for kind, shape in sizes.items()}
        count, bound = Counter(), 0
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist(), object)
            count.update(kinds.tolist())
            bound += _whole_sum(batch.column("bound").drop_null().to_numpy())
            for kind, total in sums.items():
                ours = pa.array(kinds == kind)
                if count[kind] and ours.true_count:
                    index = batch.column("idx").filter(ours).fill_null(0).to_numpy()
                    vectors, starts = ragged(batch.column("vec").filter(ours))
                    np.add.at(total, index, vectors[starts[0] : starts[-1]].reshape(-1, total.shape[1]))
        values = [count["doc"], count["unsettled"], str(bound), *[t.tobytes() for t in sums.values()]]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["documents", "unsettled", "bound", *sizes])

    schema = "documents BIGINT, unsettled BIGINT, bound STRING, nu BINARY, moment BINARY, weight BINARY"
    found = rows.coalesce(MERGE_TASKS).mapInArrow(add, schema).collect()

    def total(kind: str) -> np.ndarray:
        return sum((np.frombuffer(r[kind]).reshape(sizes[kind]) for r in found), np.zeros(sizes[kind]))

    bound = sum(int(r["bound"]) for r in found) / BOUND_UNITS
    counts = (sum(r[c] for r in found) for c in ("documents", "unsettled"))
    return IterationSums(*counts, bound, total("nu"), total("moment"), total("weight")[0])


def _whole_sum(bounds: np.ndarray) -> int:
    """Exact sum of the bounds in units: halves of the numbers are added apart, so that neither overflows."""
    whole = np.rint(bounds * BOUND_UNITS).astype(np.int64)
    return (int((whole >> 32).sum()) << 32) + int((whole & 0xFFFFFFFF).sum())


def phi_by_aspect(result: DataFrame, topics: int) -> DataFrame:
    """(aspect, term_id, phi): expected topic counts."""
    return (
        result.where(F.col("kind") == "phi")
        .groupBy("aspect", F.col("idx").alias("term_id"))
        .agg(sum_vectors("vec", topics).alias("phi"))
    )


def cross_products(df: DataFrame, column: str, width: int) -> DataFrame:
    """(i, vec): rows of the sum of v v' over an array column of ``width`` numbers. Every
    task multiplies its rows as one matrix and emits ``width`` rows."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = square(batch.column(0))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), list_column(total)], names=["i", "vec"]
        )

    partial = df.select(column).mapInArrow(multiply, "i INT, vec ARRAY<DOUBLE>")
    return partial.groupBy("i").agg(sum_vectors("vec", width).alias("vec"))


def small_matrix(rows: DataFrame, size: int, index: str = "i") -> np.ndarray:
    """A size x size result (topics and covariates squared, never documents or terms)."""
    matrix = np.zeros((size, size))
    for row in rows.collect():
        matrix[row[index]] = row["vec"]
    return matrix


def long_matrix(rows: DataFrame) -> DataFrame:
    """(i, j, v) of (i, vec)."""
    return rows.select("i", F.posexplode("vec").alias("j", "v"))
