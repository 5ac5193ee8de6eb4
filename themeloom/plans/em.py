"""The fit: inference per document and updates in turn."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from themeloom.functions import linear_map, number_array
from themeloom.operators.aggregate import crossed, iteration_sums, phi_by_aspect
from themeloom.operators.control import verdict
from themeloom.operators.corpus import check_dimensions
from themeloom.operators.covariates import is_sparse
from themeloom.operators.estep import Prior, Topics, infer, share_topics
from themeloom.operators.mstep import (
    Moments,
    prior_covariance,
    ridge_coefficients,
    scatter_from_moments,
    sparse_moments,
    sparse_products,
    sparse_ridge_coefficients,
    topic_update,
)
from themeloom.operators.recover import initial_covariance
from themeloom.params import FitParams
from themeloom.plans.corpus import Corpus, build_corpus
from themeloom.plans.initialise import initialise
from themeloom.plans.journal import Journal, last_saved
from themeloom.plans.model import Model
from themeloom.workspace import Workspace


def fit(
    documents: DataFrame,
    params: FitParams,
    covariates: DataFrame | None = None,
    aspects: DataFrame | None = None,
    space: Workspace | None = None,
) -> Model:
    """Fit topics to texts (doc_id, text); see ``build_corpus`` and ``fit_corpus``. Without ``space`` the tables are in a
    workspace of the model, which its ``close`` removes."""
    own = None if space else Workspace(documents.sparkSession)
    space = space or own
    corpus = build_corpus(
        space, documents, params.min_doc_share, covariates, aspects, params.partitions
    )
    start = initialise(space, corpus, params.topics)
    return replace(fit_corpus(space, corpus, start.topics, params), space=own)


def continue_fit(space: Workspace, folder: str, params: FitParams | None = None) -> Model:
    """Go on with a fit whose driver ended, from the folder of its workspace alone: after the last iteration that it
    completed, with its settings or others. A fit that had ended is returned as it was."""
    saved = last_saved(space.spark, space.part(), folder)
    params = params or saved.params
    done = [bound for _, bound, _ in saved.model.history]
    if verdict(done, params.threshold, params.max_iterations).stop:
        return saved.model
    return resume(space, saved.corpus, saved.model, params)


def resume(space: Workspace, corpus: Corpus, model: Model, params: FitParams) -> Model:
    """Go on with a fitted or loaded model on the corpus it was fitted to, or on one of the same terms
    and covariates; the bounds of both fits form one history. ``max_iterations`` counts all of them,
    and at least one more is done."""
    if corpus.covariates != model.gamma.shape[0]:
        raise ValueError(f"the model has {model.gamma.shape[0]} covariates, the corpus {corpus.covariates}")
    if model.topics.terms > corpus.terms:
        raise ValueError(f"the model has {model.topics.terms} terms, the corpus {corpus.terms}")
    # A saved model knows terms only up to the last one that has topics.
    topics = replace(model.topics, terms=corpus.terms)
    return fit_corpus(space, corpus, topics, params, model.sigma, model.gamma, model.logits, model.history, model.unsettled)


def fit_corpus(
    space: Workspace,
    corpus: Corpus,
    start: Topics,
    params: FitParams,
    sigma: np.ndarray | None = None,
    gamma: np.ndarray | None = None,
    logits: DataFrame | None = None,
    history: Sequence[tuple[int, float, float | None]] = (),
    unsettled: Sequence[int] = (),
) -> Model:
    """Variational EM from starting topics.

    Coefficients and logits (doc_id, eta; one row per document) start at 0 where not given, also for
    documents without a row. ``history`` is that of the iterations before.

    An iteration is one job over the documents, whose result is stored once, one that adds up what tasks
    summed, and one that scales the topics. Corpus and logits are bucketed alike by document, so their join
    needs no shuffle. Prior means follow from covariates and coefficients and are never stored; sums
    of products over (x, eta) leave the job with the rest, so updating the prior takes no
    pass of its own. Covariates, topics and prior are refreshed before every iteration. After it a record is
    written from which ``continue_fit`` can go on should the driver end.
    """
    check_dimensions(params.topics, corpus.terms)
    if (start.topics, start.terms) != (params.topics, corpus.terms):
        raise ValueError(
            f"start topics are {start.topics} of {start.terms} terms, not {params.topics} of {corpus.terms}"
        )
    if corpus.aspects > params.aspects:
        raise ValueError(f"the corpus has {corpus.aspects} aspects, the settings {params.aspects}")
    space = space.part()
    topics, size = start, params.topics - 1
    sparse = is_sparse(corpus.rows)
    width = size if sparse else corpus.covariates + size
    cells = space.table(sparse_products(corpus.rows), "products") if sparse else None
    sigma = initial_covariance(params.topics) if sigma is None else sigma
    gamma = np.zeros((corpus.covariates, size)) if gamma is None else gamma
    history, unsettled = list(history), list(unsettled)
    journal = Journal(space, corpus, params)
    bounds = [bound for _, bound, _ in history]
    first = len(bounds) + 1
    while True:
        number = len(bounds) + 1
        shared = share_topics(topics)
        inferred = infer(
            with_logits(corpus.rows, logits, size),
            topics,
            Prior.of(sigma),
            params.aspects,
            shared=shared,
            gamma=gamma,
        )
        result = space.bucketed(
            inferred, f"inferred_{number}", "doc_id", corpus.buckets, split_by="kind"
        )
        if shared is not None:
            shared.destroy()
        logits = document_logits(result)
        sums = iteration_sums(result, size, width)
        bounds.append(sums.bound)
        unsettled.append(sums.unsettled)
        if sparse:
            moments = sparse_moments(cells, crossed(result, corpus.covariates, size), sums.moment, corpus.documents)
            gamma = sparse_ridge_coefficients(moments)
        else:
            moments = Moments.of(sums.moment, corpus.covariates, corpus.documents)
            gamma = ridge_coefficients(moments)
        sigma = prior_covariance(
            scatter_from_moments(moments, gamma), sums.nu, corpus.documents, params.sigma_shrink
        )
        phi = phi_by_aspect(result, params.topics)
        updated = space.table(topic_update(phi, params.topics, sums.weight.tolist()), f"topics_{number}")
        topics = Topics(updated, params.topics, corpus.terms)
        state = verdict(bounds, params.threshold, params.max_iterations)
        history.append((number, bounds[-1], state.gain))
        model = Model(
            topics=topics,
            gamma=gamma,
            sigma=sigma,
            logits=logits,
            prior_means=corpus.prior_means(gamma),
            history=list(history),
            converged=state.converged,
            vocab=corpus.vocab.table.select("term_id", "term") if corpus.vocab else None,
            unsettled=list(unsettled),
        )
        journal.commit(number, space.path(f"topics_{number}"), space.path(f"inferred_{number}"), model)
        if number > first:
            space.drop(f"inferred_{number - 1}")
            space.drop(f"topics_{number - 1}")
        if state.stop:
            return model


def document_logits(result: DataFrame) -> DataFrame:
    """(doc_id, eta, bound) of a stored result of inference."""
    return result.where(F.col("kind") == "doc").select("doc_id", F.col("vec").alias("eta"), "bound")


def with_state(rows: DataFrame, logits: DataFrame | None, gamma: np.ndarray, size: int) -> DataFrame:
    """Corpus rows with start logits and prior mean."""
    return with_logits(rows.withColumn("mu", linear_map(F.col("x"), gamma.T.tolist())), logits, size)


def with_logits(rows: DataFrame, logits: DataFrame | None, size: int) -> DataFrame:
    """Rows with start logits, 0 where there are none."""
    zeros = number_array([0.0] * size)
    if logits is None:
        return rows.withColumn("eta", zeros)
    # Hash join per bucket: the wide corpus side is streamed, not sorted.
    joined = rows.join(logits.select("doc_id", "eta").hint("shuffle_hash"), "doc_id", "left")
    return joined.withColumn("eta", F.coalesce("eta", zeros))
