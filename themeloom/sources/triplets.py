"""Document-term counts from CSV files of (document, term, count)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "doc_id BIGINT, term BIGINT, cnt DOUBLE"


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV files with a header line; terms are 1-based there and 0-based here.

    Documents are told apart by their id, so gaps in the ids and any order of the
    lines are fine. A damaged line fails the read instead of vanishing.
    """
    lines = spark.read.schema(SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return lines.select("doc_id", (F.col("term") - 1).cast("int").alias("term_id"), "cnt")


def nested_documents(triplets: DataFrame) -> DataFrame:
    """One row per document with its (term_id, cnt) entries in term order.

    Counts are summed per (document, term) first, so a document holds at most one
    entry per vocabulary term.
    """
    counts = triplets.groupBy("doc_id", "term_id").agg(F.sum("cnt").alias("cnt"))
    entries = F.sort_array(F.collect_list(F.struct("term_id", "cnt")))
    return counts.groupBy("doc_id").agg(entries.alias("terms"))


def check_document_count(triplets: DataFrame, expected: int) -> int:
    """Number of documents; warns when it differs from ``expected``."""
    found = triplets.select("doc_id").distinct().count()
    if found != expected:
        warnings.warn(f"expected {expected} documents, found {found}", stacklevel=2)
    return found
