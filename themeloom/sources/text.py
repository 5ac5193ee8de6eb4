"""Text files, one row per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files at ``path`` as column ``value``."""
    return spark.read.text(path)
