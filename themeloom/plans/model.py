"""A fitted model: its tables, saving and loading."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.functions import softmax_with_reference
from themeloom.operators.control import top_words
from themeloom.operators.estep import Prior, Topics
from themeloom.operators.recover import long_topics
from themeloom.sources.tables import save_tables
from themeloom.workspace import Workspace

TABLES = ("topics", "doc_topics", "prior_mean", "gamma", "sigma", "history", "vocabulary")


@dataclass(frozen=True)
class Model:
    topics: Topics
    gamma: np.ndarray             # covariates x (topics - 1)
    sigma: np.ndarray
    logits: DataFrame             # doc_id, eta, bound
    prior_means: DataFrame        # doc_id, mu
    history: list[tuple[int, float, float | None]] = field(default_factory=list)
    converged: bool = False
    vocab: DataFrame | None = None  # term_id, term
    unsettled: list[int] = field(default_factory=list)  # documents that ran out of steps, per iteration
    space: Workspace | None = None  # holds the tables of a fit that made its own

    def close(self) -> None:
        """Remove the tables that the fit wrote in a workspace of its own; ``save`` the model before."""
        if self.space is not None:
            self.space.close()

    @property
    def prior(self) -> Prior:
        return Prior.of(self.sigma)

    def doc_topics(self) -> DataFrame:
        """(doc_id, theta, eta, bound)."""
        return self.logits.select(
            "doc_id", softmax_with_reference(F.col("eta")).alias("theta"), "eta", "bound"
        )

    def top_words(self, words: int = 5) -> DataFrame:
        return top_words(long_topics(self.topics.table), self.vocab, words)

    def tables(self) -> dict[str, DataFrame]:
        """All results as tables."""
        spark = self.logits.sparkSession
        gamma = [(d, k, float(v)) for (d, k), v in np.ndenumerate(self.gamma)]
        sigma = [(i, j, float(v)) for (i, j), v in np.ndenumerate(self.sigma)]
        tables = {
            "topics": self.topics.table,
            "doc_topics": self.doc_topics(),
            "prior_mean": self.prior_means,
            "gamma": spark.createDataFrame(gamma, "covariate INT, topic INT, coef DOUBLE"),
            "sigma": spark.createDataFrame(sigma, "i INT, j INT, value DOUBLE"),
            "history": spark.createDataFrame(
                [(*row, self.converged, open_) for row, open_ in zip_longest(self.history, self.unsettled)],
                "iteration INT, bound DOUBLE, gain DOUBLE, converged BOOLEAN, unsettled BIGINT",
            ),
        }
        if self.vocab is not None:
            tables["vocabulary"] = self.vocab
        return tables

    def save(self, folder: str, mode: str = "errorifexists") -> dict[str, str]:
        return save_tables(self.tables(), folder, "parquet", mode)


def load(spark: SparkSession, folder: str) -> Model:
    """A model written by ``save``."""
    folder = folder.rstrip("/")

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    topics = read("topics")
    facts = topics.agg(F.max(F.size("b")).alias("k"), (F.max("term_id") + 1).alias("v")).first()
    history = read("history").orderBy("iteration").collect()
    jvm = spark._jvm.org.apache.hadoop.fs
    vocab_path = jvm.Path(f"{folder}/vocabulary")
    has_vocab = vocab_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(vocab_path)
    return Model(
        topics=Topics(topics, facts["k"], facts["v"]),
        gamma=_matrix(read("gamma"), "covariate", "topic", "coef"),
        sigma=_matrix(read("sigma"), "i", "j", "value"),
        logits=read("doc_topics").select("doc_id", "eta", "bound"),
        prior_means=read("prior_mean"),
        history=[(r["iteration"], r["bound"], r["gain"]) for r in history],
        converged=bool(history) and history[-1]["converged"],
        vocab=read("vocabulary") if has_vocab else None,
        unsettled=[r["unsettled"] for r in history if r["unsettled"] is not None],
    )


def _matrix(cells: DataFrame, row: str, column: str, value: str) -> np.ndarray:
    found = cells.collect()
    matrix = np.zeros((max(c[row] for c in found) + 1, max(c[column] for c in found) + 1))
    for c in found:
        matrix[c[row], c[column]] = c[value]
    return matrix
