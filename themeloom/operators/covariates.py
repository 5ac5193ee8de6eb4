"""Covariates of the documents as numeric vectors, dense or sparse.

Dense vectors are arrays. A sparse one is a struct of the places ``at`` and the values ``v`` of its entries, which is what a
categorical column with many levels needs: a document has one of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructType

from themeloom.lookup import lookup_join
from themeloom.operators.ragged import ragged, square

DENSE_LEVELS = 64  # a categorical column with more makes the vectors sparse


@dataclass(frozen=True)
class Design:
    """(doc_id, x) and the names of the entries of x; the first is the intercept."""

    table: DataFrame
    names: list[str]


def design(
    documents: DataFrame,
    categories: Sequence[str] = (),
    numbers: dict[str, Column] | None = None,
    sparse: bool | None = None,
) -> Design:
    """Intercept, an indicator per level of each categorical column but its last, and each
    number centred and scaled to unit variance. Missing levels get no indicator, missing
    numbers the mean. Levels are listed by the driver, as the coefficients are."""
    levels = {}
    for column in categories:
        found = documents.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()
        levels[column] = [row[0] for row in found]
    scaled = _scaled(documents, numbers or {})
    names = ["intercept", *(f"{c}={level}" for c, found in levels.items() for level in found[:-1]), *scaled]
    if sparse is None:
        sparse = any(len(found) > DENSE_LEVELS for found in levels.values())
    if sparse:
        return Design(_sparse(documents, levels, scaled), names)
    entries = [F.lit(1.0)]
    for column, found in levels.items():
        entries += [F.when(F.col(column) == level, 1.0).otherwise(0.0) for level in found[:-1]]
    vector = F.array(*entries, *scaled.values()).cast("array<double>")
    return Design(documents.select("doc_id", vector.alias("x")), names)


def _scaled(documents: DataFrame, numbers: dict[str, Column]) -> dict[str, Column]:
    if not numbers:
        return {}
    sums = [f for c in numbers.values() for f in (F.avg(c), F.stddev_pop(c))]
    found = documents.agg(*sums).first()
    scaled = {}
    for at, (name, column) in enumerate(numbers.items()):
        mean, sd = found[2 * at], found[2 * at + 1]
        value = (column - F.lit(mean)) / F.lit(sd) if sd else F.lit(0.0)
        scaled[name] = F.coalesce(value, F.lit(0.0))
    return scaled


def _sparse(documents: DataFrame, levels: dict[str, list], scaled: dict[str, Column]) -> DataFrame:
    """Levels are looked up in a table of their places, whatever their number."""
    spark, offset, places = documents.sparkSession, 1, []
    rows = documents
    for number, (column, found) in enumerate(levels.items()):
        place = f"_place_{number}"
        kind = documents.schema[column].dataType
        known = StructType().add("_level", kind).add(place, IntegerType())
        table = spark.createDataFrame([(level, offset + k) for k, level in enumerate(found[:-1])], known)
        size = sum(24 + len(str(level)) for level in found)
        rows = lookup_join(rows.withColumn("_level", F.col(column)), table, "_level", size, "doc_id", "left").drop("_level")
        places.append(place)
        offset += max(0, len(found) - 1)
    entries = [F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("v"))]
    entries += [F.struct(F.col(place).alias("at"), F.lit(1.0).alias("v")) for place in places]
    entries += [F.struct(F.lit(offset + k).alias("at"), c.cast("double").alias("v")) for k, c in enumerate(scaled.values())]
    there = F.filter(F.array(*entries), lambda e: e["at"].isNotNull())
    x = F.struct(F.transform(there, lambda e: e["at"]).alias("at"), F.transform(there, lambda e: e["v"]).alias("v"))
    return rows.select("doc_id", x.alias("x"))


def is_sparse(rows: DataFrame) -> bool:
    return isinstance(rows.schema["x"].dataType, StructType)


def width(x: Column, sparse: bool) -> Column:
    """The least length of a vector that has these entries."""
    return F.array_max(x["at"]) + 1 if sparse else F.size(x)


class Vectors:
    """The vectors of a batch: entry e of the batch is the value ``v[e]`` at ``at[e]`` of row ``doc[e]``."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.StructArray):
            places, starts = ragged(column.field("at"))
            values, own = ragged(column.field("v"))
            self.dense = None
            self.at, self.v = places[starts[0] : starts[-1]], values[own[0] : own[-1]]
            self.doc = np.repeat(np.arange(len(column)), np.diff(starts))
        else:
            self.dense = square(column)
        self.rows = len(column)

    def times(self, gamma: np.ndarray) -> np.ndarray:
        """Products of all rows with the columns of ``gamma``."""
        if self.dense is not None:
            return self.dense @ gamma
        found = np.zeros((self.rows, gamma.shape[1]))
        np.add.at(found, self.doc, self.v[:, None] * gamma[self.at])
        return found

    def add_crossed(self, total: np.ndarray, other: np.ndarray) -> None:
        """Adds the sum of x times the rows of ``other`` (transposed) to ``total``."""
        if self.dense is not None:
            total += self.dense.T @ other
        else:
            np.add.at(total, self.at, self.v[:, None] * other[self.doc])
