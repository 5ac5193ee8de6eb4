"""Prepare a corpus for fitting."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from themeloom.operators.corpus import (
    Vocabulary,
    corpus_rows,
    doc_terms,
    document_term,
    vocabulary,
)
from themeloom.operators.covariates import is_sparse, width
from themeloom.operators.mstep import prior_mean
from themeloom.workspace import Workspace

ENTRY_BYTES = 16                  # one term of one document
BUCKET_BYTES = 256 * 1024 * 1024
MOST_BUCKETS = 65536              # Spark itself allows 100,000


@dataclass(frozen=True)
class Corpus:
    """Stored rows (doc_id, aspect, x, n, term_ids, counts), bucketed by doc_id. ``aspects``
    is the largest aspect plus 1, ``covariates`` the length of x (an array, or sparse: see ``design``), ``path`` the folder of the rows
    where they are just as stored."""

    rows: DataFrame
    buckets: int
    documents: int
    terms: int
    covariates: int
    aspects: int = 1
    vocab: Vocabulary | None = None
    path: str | None = None

    def prior_means(self, gamma: np.ndarray) -> DataFrame:
        """(doc_id, mu) under coefficients."""
        return prior_mean(self.rows, gamma)


def bucket_count(df: DataFrame, entries: int) -> int:
    """Enough buckets for ``BUCKET_BYTES`` of entries each. A small corpus gets the session's
    shuffle partitions, or two buckets per core if that is less. Every task of an iteration
    emits its own sums over the terms, so buckets are larger than usual partitions."""
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fewest = min(usual, 2 * spark.sparkContext.defaultParallelism)
    return min(MOST_BUCKETS, max(fewest, math.ceil(entries * ENTRY_BYTES / BUCKET_BYTES)))


def build_corpus(
    space: Workspace,
    documents: DataFrame,
    min_doc_share: float,
    covariates: DataFrame | None = None,
    aspects: DataFrame | None = None,
    partitions: int | None = None,
    vocab: Vocabulary | None = None,
) -> Corpus:
    """From texts (doc_id, text). Covariates are (doc_id, x), aspects (doc_id, aspect); both
    may miss. Splitting texts into words is the costly part, so the counts are stored between
    choosing the vocabulary and using it, and removed after."""
    space = space.part()
    terms = space.table(doc_terms(documents), "terms")
    if vocab is None:
        vocab = vocabulary(space, terms, documents.count(), min_doc_share)
    buckets = partitions or bucket_count(terms, terms.count() if vocab.entries is None else vocab.entries)
    triplets = document_term(terms, vocab)
    built = store_corpus(space, triplets, documents, vocab.terms, covariates, aspects, buckets, vocab)
    space.drop("terms")
    return built


def store_corpus(
    space: Workspace,
    triplets: DataFrame,
    documents: DataFrame,
    terms: int,
    covariates: DataFrame | None = None,
    aspects: DataFrame | None = None,
    partitions: int | None = None,
    vocab: Vocabulary | None = None,
) -> Corpus:
    """From triplets (doc_id, term_id, cnt); ``documents`` names every document."""
    described = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    if covariates is None:
        described = described.withColumn("x", F.array(F.lit(1.0)))
    else:
        described = described.join(covariates.select("doc_id", "x"), "doc_id", "left")
    if aspects is None:
        described = described.withColumn("aspect", F.lit(0))
    else:
        described = described.join(aspects.select("doc_id", "aspect"), "doc_id", "left")
        described = described.withColumn("aspect", F.coalesce(F.col("aspect").cast("int"), F.lit(0)))
    buckets = partitions or bucket_count(triplets, triplets.count())
    space = space.part()
    rows = space.bucketed(corpus_rows(triplets, described, buckets), "corpus", "doc_id", buckets)
    sparse = is_sparse(rows)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(width(F.col("x"), sparse)).alias("d"),
        F.min(width(F.col("x"), sparse)).alias("e"),
        F.max("aspect").alias("a"),
        F.count("x").alias("x"),
    ).first()
    if facts["x"] < facts["n"]:
        raise ValueError(f"{facts['n'] - facts['x']} documents have no covariates or are not named")
    if facts["n"] and (facts["d"] < 1 or (facts["d"] != facts["e"] and not sparse)):
        raise ValueError("every document needs covariates of the same length")
    return Corpus(rows, buckets, facts["n"], terms, facts["d"] or 1, (facts["a"] or 0) + 1, vocab, space.path("corpus"))
