"""Inference for documents under fixed parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from themeloom.functions import number_array, softmax_with_reference
from themeloom.operators.covariates import is_sparse
from themeloom.operators.estep import Prior, Topics, infer
from themeloom.operators.corpus import Vocabulary
from themeloom.plans.corpus import Corpus, build_corpus
from themeloom.plans.model import Model
from themeloom.workspace import Workspace


def score(
    rows: DataFrame,
    topics: Topics,
    prior: Prior,
    means: DataFrame | None = None,
    start: DataFrame | None = None,
    aspects: int = 1,
    detail: bool = False,
    sums: bool = True,
    gamma: np.ndarray | None = None,
) -> DataFrame:
    """Result rows of ``infer`` for corpus rows; without ``sums`` those of documents alone. Prior means (doc_id, mu) and start logits
    (doc_id, eta) are 0 where neither given nor columns of the rows; ``gamma`` gives means by the rows' covariates. Terms outside the vocabulary are not in the rows;
    a document left without terms gets its prior mean."""
    zeros = number_array([0.0] * (topics.topics - 1))
    for name, given in (("mu", means), ("eta", start)):
        if name == "mu" and gamma is not None:
            continue
        if given is None and name not in rows.columns:
            rows = rows.withColumn(name, zeros)
        elif given is not None:
            rows = rows.join(given.select("doc_id", name), "doc_id", "left")
            rows = rows.withColumn(name, F.coalesce(name, zeros))
    if gamma is None:
        rows = rows.drop("x")
    return infer(rows, topics, prior, aspects, detail, sums=sums, gamma=gamma)


def scored_documents(result: DataFrame) -> DataFrame:
    """(doc_id, eta, theta, bound)."""
    docs = result.where(F.col("kind") == "doc")
    return docs.select(
        "doc_id",
        F.col("vec").alias("eta"),
        softmax_with_reference(F.col("vec")).alias("theta"),
        "bound",
    )


def score_texts(
    space: Workspace, documents: DataFrame, model: Model, covariates: DataFrame | None = None
) -> DataFrame:
    """New texts (doc_id, text) under a fitted or loaded model. Terms are matched by their string
    with the model's vocabulary, others are ignored; covariates (doc_id, x) must be those of the fit."""
    if model.vocab is None:
        raise ValueError("the model has no vocabulary to match the texts with")
    terms = model.vocab.agg(F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0))).first()[0]
    vocab = Vocabulary(model.vocab, model.topics.terms, terms, None)
    return score_corpus(build_corpus(space, documents, 0.0, covariates, vocab=vocab), model)


def score_corpus(corpus: Corpus, model: Model) -> DataFrame:
    """Documents of a corpus under a fitted model, with the model's coefficients applied to
    their covariates. The corpus must be built with the model's vocabulary; see ``score_texts``."""
    known = model.gamma.shape[0]
    # Of sparse covariates new documents may have only some of the fit's.
    if corpus.covariates > known or (corpus.covariates < known and not is_sparse(corpus.rows)):
        raise ValueError(f"the model has {known} covariates, the corpus {corpus.covariates}")
    if corpus.terms != model.topics.terms:
        raise ValueError(f"the model has {model.topics.terms} terms, the corpus {corpus.terms}")
    return scored_documents(score(corpus.rows, model.topics, model.prior, sums=False, gamma=model.gamma))
