"""Inputs of the registered queries, all derived from the tables of one folder.

The parameters (topics, logits, prior means) are simple functions of the tables, so SQL can
state them too:

    topics      share of a term among the tokens of a group of documents, each
                count raised by 0.01; groups are the four languages, or English, German and
                the rest
    covariates  intercept, language indicators, log length centred and scaled (z)
    aspect      0 for documents without label, else 1 + quality
    logits      0.8 [language is k] - 0.2 + 0.1 (k + 1) z
    prior mean  0.5 [language is k]
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.operators.anchors import Anchors, find_corpus_anchors
from themeloom.operators.corpus import corpus_entries, corpus_rows, doc_terms, document_term, vocabulary
from themeloom.operators.covariates import Design, design
from themeloom.operators.estep import Prior, Topics, infer
from themeloom.operators.gram import gram_profile, gram_row_sums, normalised_norms
from themeloom.operators.products import NormalisedGram
from themeloom.operators.recover import simplex_weights
from themeloom.params import FitParams
from themeloom.plans.corpus import Corpus, build_corpus
from themeloom.plans.em import fit_corpus
from themeloom.plans.model import Model
from themeloom.workspace import Workspace

SMOOTHING = 0.01
PRECISION_DIAGONAL, PRECISION_OTHER = 0.05, 0.01
ANCHORS = 3


def precision(size: int) -> np.ndarray:
    matrix = np.full((size, size), PRECISION_OTHER)
    np.fill_diagonal(matrix, PRECISION_DIAGONAL)
    return matrix


class Given:
    """Each input is built once per session and folder, and stored."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.space = Workspace(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def lines(self) -> DataFrame:
        return self.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))

    # All words.

    @cached_property
    def terms(self) -> DataFrame:
        return self.space.table(doc_terms(self.documents), "terms")

    @cached_property
    def words(self):
        if "corpus" in self.__dict__:  # it has all words: the same table
            return self.corpus.vocab
        return vocabulary(self.space, self.terms, self.documents.count(), 0.0, "words")

    @cached_property
    def all_triplets(self) -> DataFrame:
        return self.space.table(document_term(self.terms, self.words), "all_triplets")

    @cached_property
    def described(self) -> DataFrame:
        return self.aspects.join(self.design.table, "doc_id")

    @cached_property
    def all_rows(self) -> DataFrame:
        parts = self.spark.sparkContext.defaultParallelism
        return self.space.table(corpus_rows(self.all_triplets, self.described, parts), "all_rows")

    @cached_property
    def foreign_sums(self) -> DataFrame:
        foreign = self.documents.where(F.col("lang") != "en").select("doc_id")
        if "corpus" in self.__dict__:  # it has the same entries and lengths
            rows = self.corpus.rows.join(foreign.select(F.col("doc_id").cast("bigint")), "doc_id", "left_semi")
            return self.space.table(gram_row_sums(rows), "foreign_sums")
        entries = self.all_triplets.join(foreign, "doc_id", "left_semi")
        described = foreign.withColumn("aspect", F.lit(0)).withColumn("x", F.array(F.lit(1.0)))
        rows = corpus_rows(entries, described, self.spark.sparkContext.defaultParallelism)
        return self.space.table(gram_row_sums(rows), "foreign_sums")

    # The model's documents, with all words.

    @cached_property
    def corpus(self) -> Corpus:
        return build_corpus(self.space, self.documents.select("doc_id", "text"), 0.0, self.design.table, self.aspects)

    @property
    def vocab(self) -> DataFrame:
        return self.corpus.vocab.table

    @property
    def triplets(self) -> DataFrame:
        """Read from the corpus: they lie by document, as its buckets do."""
        return corpus_entries(self.corpus.rows)

    def triplets_with(self, *tables: DataFrame) -> DataFrame:
        """Triplets with the columns of ``tables``, by document: they are joined to the corpus by its buckets, before its
        rows are taken apart, so only the tables are shuffled."""
        rows, names = self.corpus.rows.select("doc_id", "term_ids", "counts"), []
        for table in tables:
            names += [c for c in table.columns if c != "doc_id"]
            rows = rows.join(table.withColumn("doc_id", F.col("doc_id").cast("bigint")).hint("shuffle_hash"), "doc_id")
        return corpus_entries(rows, *names)

    # Co-occurrences.

    @cached_property
    def profile(self) -> DataFrame:
        return self.space.table(gram_profile(self.corpus.rows, self.corpus.terms), "profile")

    @cached_property
    def matrix(self) -> NormalisedGram:
        sums = self.space.table(gram_row_sums(self.corpus.rows), "row_sums")
        return NormalisedGram(self.corpus.rows, sums, self.corpus.terms)

    @cached_property
    def norms(self) -> DataFrame:
        return self.space.table(normalised_norms(self.profile), "norms")

    @cached_property
    def anchors(self) -> Anchors:
        return find_corpus_anchors(self.space, self.matrix, self.norms, ANCHORS)

    @cached_property
    def weights(self) -> DataFrame:
        return self.space.table(simplex_weights(self.anchors.products, self.anchors.picks), "weights")

    # Given parameters.

    @cached_property
    def design(self) -> Design:
        return design(self.documents, ["lang"], {"z": F.log(1 + F.col("n_chars"))})

    @cached_property
    def aspects(self) -> DataFrame:
        joined = self.documents.select("doc_id").join(self.read("labels"), "doc_id", "left")
        return joined.select("doc_id", F.coalesce(F.col("quality") + 1, F.lit(0)).cast("int").alias("aspect"))

    @cached_property
    def eta(self) -> DataFrame:
        entry = [0.8 * F.get("x", F.lit(k + 1)) - 0.2 + 0.1 * (k + 1) * F.get("x", F.lit(4)) for k in range(3)]
        return self.design.table.select("doc_id", F.array(*entry).alias("eta"))

    @cached_property
    def mu(self) -> DataFrame:
        entry = [0.5 * F.get("x", F.lit(k + 1)) for k in range(3)]
        return self.design.table.select("doc_id", F.array(*entry).alias("mu"))

    def group_topics(self, groups: list[Column], name: str) -> Topics:
        counts = self.triplets_with(self.documents.select("doc_id", "lang")).groupBy("term_id").agg(
            *[F.sum(F.when(g, F.col("cnt")).otherwise(0.0)).alias(f"c{k}") for k, g in enumerate(groups)]
        )
        counts = self.space.table(counts, f"{name}_counts")
        total = counts.agg(*[F.sum(f"c{k}") for k in range(len(groups))]).first()
        share = [
            (F.col(f"c{k}") + SMOOTHING) / (total[k] + SMOOTHING * self.corpus.terms)
            for k in range(len(groups))
        ]
        table = self.space.table(counts.select("term_id", F.array(*share).alias("b")), name)
        return Topics(table, len(groups), self.corpus.terms)

    @cached_property
    def topics4(self) -> Topics:
        return self.group_topics([F.col("lang") == name for name in ("de", "en", "es", "fr")], "topics4")

    @cached_property
    def topics3(self) -> Topics:
        english, german = F.col("lang") == "en", F.col("lang") == "de"
        return self.group_topics([english, german, ~(english | german)], "topics3")

    @cached_property
    def prior3(self) -> Prior:
        return Prior.of(np.linalg.inv(precision(2)))

    @cached_property
    def mu3(self) -> DataFrame:
        entry = [0.5 * F.get("x", F.lit(2)), 0.1 * F.get("x", F.lit(4))]
        return self.design.table.select("doc_id", F.array(*entry).alias("mu"))

    @cached_property
    def inferred3(self) -> DataFrame:
        """Inference with three topics for all documents, stored but for the expected counts of every entry, which no
        query reads: they are as many as the entries."""
        rows = self.corpus.rows.drop("x").join(self.mu3, "doc_id")
        start = rows.withColumn("eta", F.array(F.lit(0.0), F.lit(0.0)))
        found = infer(start, self.topics3, self.prior3, 3, detail=True)
        return self.space.table(found.where(F.col("kind") != "doc_phi"), "inferred3")

    @cached_property
    def inferred_blocks(self) -> DataFrame:
        """The same with the topics sent to blocks of documents."""
        rows = self.corpus.rows.drop("x").join(self.mu3, "doc_id")
        start = rows.withColumn("eta", F.array(F.lit(0.0), F.lit(0.0)))
        return self.space.table(infer(start, self.topics3, self.prior3, 3, topic_bytes=0), "inferred_blocks")

    @cached_property
    def covariate_iterations(self) -> Model:
        """Two iterations with all covariates and aspects."""
        params = FitParams(topics=3, aspects=3, max_iterations=2, threshold=-1.0)
        return fit_corpus(self.space, self.corpus, self.topics3, params)

    @cached_property
    def two_iterations(self) -> Model:
        rows = self.corpus.rows.withColumn("x", F.array(F.lit(1.0)))
        plain = replace(self.corpus, rows=rows, covariates=1, path=None)
        params = FitParams(topics=3, aspects=3, max_iterations=2, threshold=-1.0)
        return fit_corpus(self.space, plain, self.topics3, params)


_GIVEN: dict[tuple[str, str], Given] = {}


def given(spark: SparkSession, folder: str) -> Given:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _GIVEN:
        _GIVEN[key] = Given(spark, folder)
    return _GIVEN[key]
