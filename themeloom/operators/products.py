"""Products of the row-normalised co-occurrence matrix with vectors, without the matrix.

With w = 1 / (n (n - 1)) of a document, counts c and row sums s, row i of the matrix times a vector x is

    1 / s_i  sum over documents of  w c_i (c . x - x_i),

so a product takes one inner product per document and one sum per term: two sparse passes, done in one
where x can be sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from themeloom.functions import number_array, sum_scaled, sum_vectors
from themeloom.lookup import lookup_join
from themeloom.operators.gram import Documents, gram_rows, usable
from themeloom.operators.ragged import list_column
from themeloom.operators.recover import anchor_rows

VECTOR_BYTES = 128 * 1024 * 1024  # vectors over all terms up to this size are sent whole


@dataclass(frozen=True)
class NormalisedGram:
    """``corpus``: rows (n, term_ids, counts). ``sums``: (term_id, s), row sums of the matrix; terms without
    a co-occurrence have no row. Vectors over the terms are tables (term_id, x), x an array with one number per
    vector; terms with zeros may miss. Up to ``limit`` bytes they are arrays and broadcast, larger ones are
    joined."""

    corpus: DataFrame
    sums: DataFrame
    terms: int
    limit: int = VECTOR_BYTES

    def row_cells(self, picks: list[int]) -> DataFrame:
        """(i, j, q): the rows of the terms ``picks``."""
        scale = self.sums.where(F.col("term_id").isin(picks)).select(F.col("term_id").alias("i"), "s")
        found = gram_rows(self.corpus, self.terms, picks).join(F.broadcast(scale), "i")
        return found.select("i", "j", (F.col("q") / F.col("s")).alias("q"))

    def fits(self, width: int) -> bool:
        """Whether so many vectors may be sent whole."""
        return self.terms * 8 * width <= self.limit

    def dense_rows(self, picks: list[int]) -> np.ndarray:
        """The same as columns of an array over all terms; only where that ``fits``."""
        return dense_rows(self.row_cells(picks), picks, self.terms)

    def times(self, vectors: np.ndarray | DataFrame, width: int) -> DataFrame:
        """(term_id, products): the products of every row with ``width`` vectors, given as the columns of an
        array or as a table; rows whose products are all exactly 0 may miss."""
        if isinstance(vectors, np.ndarray):
            shared = self.corpus.sparkSession.sparkContext.broadcast(np.ascontiguousarray(vectors))
            partial = usable(self.corpus).mapInArrow(_multiply(shared, self.terms, width), "term_id INT, v ARRAY<DOUBLE>")
            sums = partial.groupBy("term_id").agg(sum_vectors("v", width).alias("v"))
        else:
            sums = self._joined(vectors, width)
        scaled = lookup_join(sums, self.sums, "term_id", 16 * self.terms, spread="term_id")
        return scaled.select("term_id", F.transform("v", lambda v: v / F.col("s")).alias("products"))

    def with_rows(self, picks: list[int], dense: np.ndarray | None = None) -> DataFrame:
        """(term_id, products): inner products of rows with those of ``picks``, ``dense`` if the caller has them."""
        if dense is None and self.fits(len(picks)):
            dense = self.dense_rows(picks)
        if dense is None:
            dense = anchor_rows(self.row_cells(picks), picks).withColumnRenamed("j", "term_id")
        return self.times(dense, len(picks))

    def row_by_anchor(self, picks: list[int]) -> DataFrame:
        """The same with a row of zeros for every row that has none."""
        found = self.with_rows(picks)
        zeros = number_array([0.0] * len(picks))
        joined = lookup_join(self.sums, found, "term_id", self.terms * (16 + 8 * len(picks)), "term_id", "left")
        return joined.select("term_id", F.coalesce("products", zeros).alias("products"))

    def _joined(self, vectors: DataFrame, width: int) -> DataFrame:
        entries = usable(self.corpus).withColumn("rid", F.monotonically_increasing_id()).select(
            "rid",
            (1.0 / (F.col("n") * (F.col("n") - 1))).alias("w"),
            F.inline(F.zip_with("term_ids", "counts", lambda t, c: F.struct(t.alias("term_id"), c.alias("c")))),
        )
        size = self.terms * (16 + 8 * width)
        known = lookup_join(entries, vectors, "term_id", size, "rid", "left", self.limit)
        known = known.withColumn("x", F.coalesce("x", number_array([0.0] * width)))
        # One row per document with its entries: no document is read twice.
        together = known.groupBy("rid").agg(
            F.first("w").alias("w"),
            sum_scaled(F.col("c"), "x", width).alias("t"),
            F.collect_list(F.struct("term_id", "c", "x")).alias("entries"),
        )
        each = together.select("w", "t", F.inline("entries"))
        part = F.zip_with("t", "x", lambda t, x: F.col("w") * F.col("c") * (t - x))
        return each.select("term_id", part.alias("v")).groupBy("term_id").agg(sum_vectors("v", width).alias("v"))


def dense_rows(cells: DataFrame, picks: list[int], terms: int) -> np.ndarray:
    """Rows ``picks`` of a matrix given by cells, as columns."""
    order = np.argsort(picks)
    dense = np.zeros((terms, len(picks)))
    for batch in cells.where(F.col("i").isin(picks)).select("i", "j", "q").toArrow().to_batches():
        column = order[np.searchsorted(picks, batch.column("i").to_numpy(), sorter=order)]
        dense[batch.column("j").to_numpy(), column] = batch.column("q").to_numpy()
    return dense


def _multiply(shared: Broadcast, terms: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = shared.value, np.zeros((terms, width))
        for batch in batches:
            docs = Documents(batch)
            for k in range(width):
                x = vectors[docs.ids, k]
                inner = np.bincount(docs.doc, docs.counts * x, minlength=len(docs.pairs))
                part = docs.counts * (inner[docs.doc] - x) / docs.pairs[docs.doc]
                total[:, k] += np.bincount(docs.ids, part, minlength=terms)
        some = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), list_column(total[some])], names=["term_id", "v"])

    return run
