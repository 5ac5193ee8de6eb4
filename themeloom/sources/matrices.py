"""Matrices and vectors stored as nested arrays in JSON files, and matrices as a record per stretch of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _field(spark: SparkSession, path: str, field: str, kind: str) -> tuple[DataFrame, Column]:
    names = field.split(".")
    schema = f"`{names[-1]}` {kind}"
    for name in reversed(names[:-1]):
        schema = f"`{name}` STRUCT<{schema}>"
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(path), F.col(".".join(f"`{name}`" for name in names))


def read_vector(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Array of numbers at the dotted ``field`` as rows (i, value), i from 0."""
    data, column = _field(spark, path, field, "ARRAY<DOUBLE>")
    return data.select(F.posexplode(column).alias("i", "value"))


def read_matrix(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Array of rows at the dotted ``field`` as cells (i, j, value), both from 0."""
    data, column = _field(spark, path, field, "ARRAY<ARRAY<DOUBLE>>")
    rows = data.select(F.posexplode(column).alias("i", "row"))
    return rows.select("i", F.posexplode("row").alias("j", "value"))


def write_matrix_rows(cells: DataFrame, path: str, stretch: int = 4096) -> None:
    """Cells (i, j, value) as JSON records {"i", "first", "row"}: a stretch of a row from column ``first``. No record grows
    with the matrix, and records are written and read apart. Columns without a cell are null."""
    at = F.pmod("j", F.lit(stretch))
    keyed = cells.select("i", (F.col("j") - at).alias("first"), at.cast("int").alias("at"), "value")
    held = keyed.groupBy("i", "first").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("held"))
    last = F.array_max(F.map_keys("held"))
    row = F.transform(F.sequence(F.lit(0), last), lambda k: F.try_element_at("held", k))
    held.select("i", "first", row.alias("row")).write.mode("overwrite").json(path)


def read_matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cells (i, j, value) of records that ``write_matrix_rows`` wrote, or whole rows without ``first``."""
    reader = spark.read.schema("i BIGINT, first BIGINT, row ARRAY<DOUBLE>").option("mode", "FAILFAST")
    cells = reader.json(path).select("i", F.coalesce("first", F.lit(0)).alias("first"), F.posexplode("row").alias("at", "value"))
    return cells.where(F.col("value").isNotNull()).select("i", (F.col("first") + F.col("at")).alias("j"), "value")
