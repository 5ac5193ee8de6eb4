"""One query per operator. Every query takes (spark, folder) and reads whole tables.

Fractions are rounded for comparison, small ones after scaling.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from themeloom.checks.given import ANCHORS, Given, given, precision
from themeloom.constants import TIE_DIGITS
from themeloom.functions import dot, softmax_with_reference
from themeloom.operators import aggregate, anchors, control, corpus, estep, gram, mstep, recover
from themeloom.params import FitParams
from themeloom.plans.em import fit_corpus
from themeloom.plans.initialise import initialise
from themeloom.plans.model import Model, load
from themeloom.plans.score import score_texts
from themeloom.sources import nested_documents, read_lines, read_matrix_rows, read_triplets, save_tables, write_matrix_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable[[Given], DataFrame]) -> Callable[[Given], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(given(spark, folder))
    return function


def whole(name: str, source: str | None = None) -> Column:
    return F.col(source or name).cast("bigint").alias(name)


def rounded(name: str, digits: int = 6, scale: float = 1.0, source: str | None = None) -> Column:
    return F.round(F.col(source or name) * F.lit(scale), digits).alias(name)


def tiny(name: str, source: str | None = None) -> Column:
    """Probabilities and co-occurrences: in millionths."""
    return rounded(name, 4, 1e6, source)


def length(name: str) -> Column:
    """Squared lengths of rows are often short binary fractions, which lie on the border of decimal rounding:
    in units of 7e-6."""
    return rounded(name, 4, 1e6 / 7)


def long(df: DataFrame, vector: str, index: str, value: str) -> DataFrame:
    keep = [c for c in df.columns if c != vector]
    return df.select(*keep, F.posexplode(vector).alias(index, value))


# --- sources ---------------------------------------------------------------------


@query
def s1_triplets_nested(g: Given) -> DataFrame:
    path = g.space.path("triplets_csv")
    rows = g.all_triplets.select("doc_id", (F.col("term_id") + 1).alias("term"), "cnt")
    rows.write.mode("overwrite").option("header", True).csv(path)
    docs = nested_documents(read_triplets(g.spark, path))
    return docs.select(
        whole("doc_id"),
        F.size("terms").cast("bigint").alias("n_terms"),
        F.get("terms.term_id", F.lit(0)).cast("bigint").alias("first_term"),
        F.aggregate("terms.cnt", F.lit(0.0), lambda a, c: a + c).cast("bigint").alias("total"),
    )


@query
def s2_lines(g: Given) -> DataFrame:
    path = g.space.path("lines_text")
    g.documents.select("text").write.mode("overwrite").text(path)
    return read_lines(g.spark, path).select(F.col("value").alias("line"))


@query
def s3_matrix(g: Given) -> DataFrame:
    path = g.space.path("matrix_rows")
    cells = recover.long_topics(g.topics4.table)
    write_matrix_rows(cells.select(F.col("topic").alias("i"), F.col("term_id").alias("j"), F.col("prob").alias("value")), path)
    return read_matrix_rows(g.spark, path).select("i", "j", tiny("value"))


@query
def s4_saved_counts(g: Given) -> DataFrame:
    counts = corpus.word_counts(corpus.split_words(g.lines, "line"))
    path = save_tables({"word_counts": counts}, g.space.path("saved"), "parquet", "overwrite")
    return g.spark.read.parquet(path["word_counts"])


@query
def s5_distribute(g: Given) -> DataFrame:
    return g.corpus.rows.select(
        whole("doc_id"),
        whole("aspect"),
        whole("n"),
        F.size("term_ids").cast("bigint").alias("n_terms"),
        F.coalesce(F.get("term_ids", F.lit(0)), F.lit(-1)).cast("bigint").alias("first_term"),
    )


# --- corpus ----------------------------------------------------------------------


@query
def c1_tokens(g: Given) -> DataFrame:
    words = corpus.split_words(g.lines, "line", keep=("doc_id",))
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("cnt"))


@query
def c2_word_count(g: Given) -> DataFrame:
    return corpus.word_counts(corpus.split_words(g.lines, "line"))


@query
def c3_doc_term(g: Given) -> DataFrame:
    matrix = corpus.document_term_matrix(corpus.document_term(g.terms, g.words))
    return matrix.select("doc_id", whole("term_id"), whole("cnt"))


@query
def c4_terms_per_doc(g: Given) -> DataFrame:
    return corpus.terms_per_document(g.all_triplets)


@query
def c5_term_totals(g: Given) -> DataFrame:
    return corpus.term_totals(g.all_triplets).select(whole("term_id"), whole("total"))


@query
def c6_word_prob(g: Given) -> DataFrame:
    found = corpus.word_probability(corpus.term_totals(g.all_triplets))
    return found.select(whole("term_id"), tiny("prob"))


@query
def c7_doc_length(g: Given) -> DataFrame:
    return corpus.document_lengths(g.all_triplets).select("doc_id", whole("n"))


@query
def c8_min_length_docs(g: Given) -> DataFrame:
    lengths = corpus.document_lengths(g.all_triplets)
    return corpus.at_least(lengths, "n", 2).select("doc_id", whole("n"))


@query
def c9_zero_terms(g: Given) -> DataFrame:
    """Words without a co-occurrence in the documents that are not English."""
    return corpus.zero_terms(g.words.table, g.foreign_sums).select(whole("term_id"))


@query
def c10_kept_terms(g: Given) -> DataFrame:
    dropped = corpus.zero_terms(g.words.table, g.foreign_sums)
    return corpus.index_difference(g.words.table, dropped, "term_id").select(whole("term_id"))


@query
def c11_drop_terms(g: Given) -> DataFrame:
    dropped = corpus.zero_terms(g.words.table, g.foreign_sums)
    kept = corpus.drop_terms(corpus.term_totals(g.all_triplets), dropped, "term_id")
    return kept.select(whole("term_id"), whole("total"))


@query
def c11_drop_cells(g: Given) -> DataFrame:
    """The matrix without the terms of a single document and those of English alone: what is left of every row."""
    rows, terms = g.corpus.rows, g.corpus.terms  # first: the texts need not be split again for the words
    kept = g.words.table.where("df >= 2").join(g.foreign_sums.select("term_id"), "term_id", "left_semi")
    dropped = corpus.index_difference(g.words.table, kept, "term_id")
    # Cells are dropped where they are made: none of them reaches the joins, which hold for any matrix.
    cells = gram.gram(rows, terms, dropped=dropped)
    cells = corpus.drop_terms(cells, dropped, "i", "j", terms=g.words.terms)
    return gram.profile_of(cells).select(whole("i"), "cells", tiny("s"))


@query
def c12_dimensions(g: Given) -> DataFrame:
    corpus.check_dimensions(4, g.corpus.terms)
    return g.corpus.rows.agg(
        F.count(F.lit(1)).alias("documents"),
        F.lit(g.corpus.terms).cast("bigint").alias("terms"),
        F.sum("n").cast("bigint").alias("tokens"),
    )


# --- co-occurrences, anchors, recovery -------------------------------------------


@query
def g1_gram(g: Given) -> DataFrame:
    """Every row of the matrix over all words by number, sum and squared length of its cells."""
    found = gram.gram_profile(g.corpus.rows, g.corpus.terms)
    return found.select(whole("i"), "cells", tiny("s"), length("r"))


@query
def g2_gram_row_sums(g: Given) -> DataFrame:
    return gram.gram_row_sums(g.all_rows).select(whole("term_id"), rounded("s"))


@query
def g3_gram_normalised(g: Given) -> DataFrame:
    """The same of the normalised matrix, whose cells are divided by their row's sum."""
    sums = g.matrix.sums.select(F.col("term_id").alias("i"), F.col("s").alias("total"))
    rows = g.profile.join(sums, "i").withColumns({"s": F.col("s") / F.col("total"), "r": F.col("r") / F.col("total") / F.col("total")})
    return rows.select(whole("i"), "cells", tiny("s"), length("r"))


@query
def a1_row_norms(g: Given) -> DataFrame:
    return gram.normalised_norms(g.profile).select(whole("i"), length("r"))


@query
def a2_argmax_row(g: Given) -> DataFrame:
    return anchors.argmax_row(g.norms).select(whole("i"), length("r"))


@query
def a3_anchors(g: Given) -> DataFrame:
    found = anchors.find_corpus_anchors(g.space, g.matrix, g.norms, ANCHORS)
    return found.table().select(whole("rank"), whole("term_id"))


@query
def r1_anchor_cross(g: Given) -> DataFrame:
    cross = recover.anchor_cross(g.matrix.row_by_anchor(g.anchors.picks), g.anchors.picks)
    return cross.select(whole("k1"), whole("k2"), tiny("v"))


@query
def r2_row_by_anchor(g: Given) -> DataFrame:
    products = g.matrix.row_by_anchor(g.anchors.picks)
    return long(products, "products", "k", "v").select(whole("term_id"), whole("k"), tiny("v"))


@query
def r3_weights(g: Given) -> DataFrame:
    weights = recover.simplex_weights(g.anchors.products, g.anchors.picks)
    return long(weights, "weights", "topic", "weight").select(
        whole("term_id"), whole("topic"), rounded("weight")
    )


@query
def r4_anchor_one_hot(g: Given) -> DataFrame:
    even = F.array(*[F.lit(1.0 / ANCHORS)] * ANCHORS)
    weights = recover.anchor_one_hot(g.words.table.select("term_id", even.alias("weights")), g.anchors.picks)
    return long(weights, "weights", "topic", "weight").select(
        whole("term_id"), whole("topic"), rounded("weight")
    )


def _recovered(g: Given) -> DataFrame:
    probability = corpus.word_probability(corpus.term_totals(g.triplets))
    return recover.recover_topics(g.weights, probability, ANCHORS, g.corpus.terms)


@query
def r5_recover_topics(g: Given) -> DataFrame:
    cells = recover.long_topics(_recovered(g))
    return cells.select(whole("topic"), whole("term_id"), tiny("prob"))


@query
def r6_refill(g: Given) -> DataFrame:
    full = recover.refill(_recovered(g), g.words.table, ANCHORS, g.words.terms)
    cells = recover.long_topics(full)
    floor = ((F.col("prob") > 0) & (F.col("prob") < 1e-300)).alias("is_floor")
    return cells.select(whole("topic"), whole("term_id"), floor, tiny("prob"))


@query
def i1_initial_state(g: Given) -> DataFrame:
    state = recover.initial_logits(g.documents, 4)
    both = state.select("doc_id", F.posexplode(F.arrays_zip("eta", "mu")).alias("k", "v"))
    return both.select("doc_id", whole("k"), F.col("v.eta").alias("eta"), F.col("v.mu").alias("mu"))


@query
def i1_topics_per_aspect(g: Given) -> DataFrame:
    cells = recover.long_topics(recover.per_aspect(g.topics4.table, 3))
    return cells.select(whole("aspect"), whole("topic"), whole("term_id"), tiny("prob"))


@query
def i2_initialise(g: Given) -> DataFrame:
    start = initialise(g.space, g.corpus, ANCHORS)
    cells = recover.long_topics(start.topics.table)
    return cells.select(whole("topic"), whole("term_id"), tiny("prob"))


# --- inference -------------------------------------------------------------------


def _state(g: Given) -> DataFrame:
    return estep.parameter_lookup(g.aspects, g.eta, g.mu)


def _sliced(g: Given) -> DataFrame:
    return estep.topic_slice(g.triplets, g.topics4)


def _weighted(g: Given, theta: DataFrame, *tables: DataFrame) -> DataFrame:
    """The same with the proportions of the documents and the columns of ``tables``."""
    return estep.topic_slice(g.triplets_with(theta, *tables), g.topics4)


@query
def e1_param_lookup(g: Given) -> DataFrame:
    both = _state(g).select("doc_id", "aspect", F.posexplode(F.arrays_zip("eta", "mu")).alias("k", "v"))
    return both.select(
        "doc_id", whole("aspect"), whole("k"), rounded("eta", source="v.eta"), rounded("mu", source="v.mu")
    )


@query
def e2_topic_slice(g: Given) -> DataFrame:
    shared = estep.Topics(recover.per_aspect(g.topics4.table, 3), 4, g.corpus.terms, aspects=3)
    sliced = estep.topic_slice(g.triplets_with(g.aspects), shared)
    cells = sliced.select("doc_id", "term_id", "cnt", F.posexplode("b").alias("topic", "prob"))
    return cells.select("doc_id", whole("term_id"), whole("cnt"), whole("topic"), tiny("prob"))


@query
def e3_theta(g: Given) -> DataFrame:
    return long(estep.proportions(g.eta), "theta", "topic", "theta").select(
        "doc_id", whole("topic"), rounded("theta")
    )


@query
def e4_objective(g: Given) -> DataFrame:
    state = _state(g)
    found = estep.objective(_weighted(g, estep.proportions(state)), state, precision(3))
    return found.select("doc_id", rounded("likelihood", 4), rounded("prior"), rounded("value", 4))


@query
def e5_gradient(g: Given) -> DataFrame:
    state = _state(g)
    found = estep.gradient(_weighted(g, estep.proportions(state)), state, precision(3))
    return found.select("doc_id", whole("k"), rounded("value"))


@query
def e6_map_eta(g: Given) -> DataFrame:
    return _logits(g.inferred3)


@query
def e6_map_eta_blocks(g: Given) -> DataFrame:
    """With topics that are too large to send whole."""
    return _logits(g.inferred_blocks)


def _logits(result: DataFrame) -> DataFrame:
    docs = result.where(F.col("kind") == "doc").select("doc_id", "vec")
    return long(docs, "vec", "k", "eta").select("doc_id", whole("k"), rounded("eta", 5))


@query
def e7_phi(g: Given) -> DataFrame:
    theta = estep.proportions(g.eta)
    found = estep.expected_counts(_weighted(g, theta), theta, ["term_id"], 4)
    return long(found, "phi", "topic", "value").select(whole("topic"), whole("term_id"), rounded("value", 5))


@query
def e8_hessian(g: Given) -> DataFrame:
    found = estep.hessian(_sliced(g), g.eta, precision(3))
    return found.select("doc_id", whole("k1"), whole("k2"), rounded("value"))


@query
def e9_nu(g: Given) -> DataFrame:
    rows = g.inferred3.where(F.col("kind") == "doc_nu").select("doc_id", "idx", "vec")
    return long(rows, "vec", "k2", "value").select(
        "doc_id", whole("k1", "idx"), whole("k2"), rounded("value", 5)
    )


@query
def e10_bound(g: Given) -> DataFrame:
    docs = g.inferred3.where(F.col("kind") == "doc")
    return docs.select("doc_id", rounded("bound", 4))


@query
def e11_accumulate(g: Given) -> DataFrame:
    """What the tasks emit, summed: expected counts per aspect and posterior covariances."""
    return _accumulated(g.inferred3)


@query
def e11_accumulate_blocks(g: Given) -> DataFrame:
    """With topics that are too large to send whole."""
    return _accumulated(g.inferred_blocks)


def _accumulated(result: DataFrame) -> DataFrame:
    phi = aggregate.phi_by_aspect(result, 3).select(
        F.lit("phi").alias("kind"), "aspect", F.col("term_id").alias("idx"), F.col("phi").alias("vec")
    )
    nu = aggregate.nu_sum(result, 2).select(
        F.lit("nu").alias("kind"), F.lit(-1).alias("aspect"), F.col("i").alias("idx"), "vec"
    )
    cells = long(phi.unionByName(nu), "vec", "at", "value")
    return cells.select("kind", whole("aspect"), whole("idx"), whole("at"), rounded("value", 4))


# --- sums and updates ------------------------------------------------------------


@query
def b1_nu_sum(g: Given) -> DataFrame:
    cells = aggregate.long_matrix(aggregate.nu_sum(g.inferred3, 2))
    return cells.select(whole("i"), whole("j"), rounded("v", 4))


@query
def b2_stack_eta(g: Given) -> DataFrame:
    stacked = aggregate.stacked_logits(g.inferred3)
    return long(stacked, "eta", "k", "eta").select("doc_id", whole("k"), rounded("eta", 5))


@query
def b3_total_bound(g: Given) -> DataFrame:
    return aggregate.total_bound(g.inferred3).select("documents", rounded("bound", 2))


def _phi4(g: Given) -> DataFrame:
    theta = estep.proportions(g.eta)
    return estep.expected_counts(_weighted(g, theta, g.aspects), theta, ["aspect", "term_id"], 4)


@query
def b4_phi_by_aspect(g: Given) -> DataFrame:
    cells = long(_phi4(g), "phi", "topic", "value")
    return cells.select(whole("aspect"), whole("topic"), whole("term_id"), rounded("value", 5))


@query
def m1_suffstats(g: Given) -> DataFrame:
    table = mstep.moment_table(g.design.table, g.eta, 8)
    return aggregate.long_matrix(table).select(whole("i"), whole("j"), rounded("v", 4))


def _coefficients(g: Given) -> np.ndarray:
    return mstep.ridge_coefficients(mstep.moments(g.design.table, g.eta, 5, 4))


@query
def m1_vbreg(g: Given) -> DataFrame:
    rows = [(k, d, float(v)) for (d, k), v in np.ndenumerate(_coefficients(g))]
    table = g.spark.createDataFrame(rows, "topic BIGINT, covariate BIGINT, coef DOUBLE")
    return table.select("topic", "covariate", rounded("coef"))


@query
def m2_mu(g: Given) -> DataFrame:
    means = mstep.prior_mean(g.design.table, _coefficients(g))
    return long(means, "mu", "k", "mu").select("doc_id", whole("k"), rounded("mu"))


@query
def m3_sigma(g: Given) -> DataFrame:
    eta = aggregate.stacked_logits(g.inferred3)
    scatter = mstep.residual_scatter(eta, g.mu3, 2)
    nu = aggregate.nu_sum(g.inferred3, 2)
    cells = mstep.prior_covariance_table(scatter, nu, g.corpus.documents, 0.3)
    return cells.select(whole("i"), whole("j"), rounded("v"))


@query
def m4_beta(g: Given) -> DataFrame:
    cells = recover.long_topics(mstep.topic_update(_phi4(g), 4))
    return cells.select(whole("topic"), whole("term_id"), tiny("prob"))


# --- control, reports, whole jobs ------------------------------------------------


@query
def f1_convergence(g: Given) -> DataFrame:
    """Histories per aspect: the log likelihood of its documents at eight points on the way
    from even topic proportions to the given ones."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(8)))
    path = g.eta.join(g.aspects, "doc_id").select("doc_id", F.col("aspect").alias("run"), "eta", steps.alias("iteration"))
    part = F.transform("eta", lambda v: v * F.col("iteration") / 8)
    theta = path.select("doc_id", "run", "iteration", part.alias("eta")).select(
        "doc_id", "run", "iteration", softmax_with_reference(F.col("eta")).alias("theta")
    )
    fit = F.col("cnt") * F.log(dot(F.col("theta"), F.col("b")))
    history = _sliced(g).join(theta, "doc_id").groupBy("run", "iteration").agg(F.sum(fit).alias("bound"))
    found = control.verdict_table(history, 0.01, 7, "run")
    return found.select(
        whole("run"), whole("iteration"), rounded("bound", 2), rounded("gain"), "converged", "stop"
    )


@query
def p1_top_words(g: Given) -> DataFrame:
    best = control.top_words(recover.long_topics(g.topics4.table), g.vocab, 5)
    return best.select(whole("topic"), whole("rank"), whole("term_id"), "term", tiny("prob"))


@query
def p2_l1(g: Given) -> DataFrame:
    before = recover.long_topics(g.topics4.table)
    after = recover.long_topics(mstep.topic_update(_phi4(g), 4))
    found = control.l1_comparison(before, after, ["topic", "term_id"], "prob")
    return found.select(rounded("size_a"), rounded("size_b"), rounded("difference"))


@query
def p3_anchor_compare(g: Given) -> DataFrame:
    """Anchors beside the rows that are largest before any direction is removed."""
    largest = anchors.largest_rows(g.norms, ANCHORS)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("r", TIE_DIGITS)), "i")
    largest = largest.select(F.row_number().over(order).alias("rank"), F.col("i").alias("term_id"))
    pairs = control.pair_by_rank(g.anchors.table(), largest)
    return pairs.select(whole("rank"), whole("a"), whole("b"))


@query
def p4_score(g: Given) -> DataFrame:
    """New documents, the benchmark texts, under the three given topics: a model with these is saved, loaded, and
    scores the texts."""
    docs = g.inferred3.where(F.col("kind") == "doc").select("doc_id", F.col("vec").alias("eta"), "bound")
    vocab = g.vocab.select("term_id", "term")
    model = Model(g.topics3, np.zeros((1, 2)), np.linalg.inv(precision(2)), docs, g.mu3, vocab=vocab)
    folder = g.space.path("given_model")
    model.save(folder, mode="overwrite")
    new = g.read("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    found = score_texts(g.space, new, load(g.spark, folder))
    return found.select(
        "doc_id",
        F.round(F.get("eta", F.lit(0)), 5).alias("eta0"),
        F.round(F.get("eta", F.lit(1)), 5).alias("eta1"),
        F.round(F.get("theta", F.lit(2)), 6).alias("theta2"),
        rounded("bound", 4),
    )


def _fitted(g: Given, iterations: int = 4):
    start = initialise(g.space, g.corpus, 4)
    return fit_corpus(g.space, g.corpus, start.topics, FitParams(topics=4, aspects=3, max_iterations=iterations))


@query
def f2_two_iterations(g: Given) -> DataFrame:
    """Topics after two iterations from the three given ones, with an intercept only."""
    return recover.long_topics(g.two_iterations.topics.table).select(
        whole("topic"), whole("term_id"), tiny("prob")
    )


@query
def f2_bounds(g: Given) -> DataFrame:
    """Bounds of these iterations, and the prior they end with."""
    model = g.two_iterations
    rows = [("bound", i, 0, float(b)) for i, b, _ in model.history]
    rows += [("mean", 0, k, float(v)) for (_, k), v in np.ndenumerate(model.gamma)]
    rows += [("covariance", i, j, float(v)) for (i, j), v in np.ndenumerate(model.sigma)]
    table = g.spark.createDataFrame(rows, "what STRING, i BIGINT, j BIGINT, value DOUBLE")
    return table.select("what", "i", "j", rounded("value", 3))


@query
def f2_covariate_topics(g: Given) -> DataFrame:
    """Topics after two iterations with all covariates and three aspects."""
    return recover.long_topics(g.covariate_iterations.topics.table).select(
        whole("topic"), whole("term_id"), tiny("prob")
    )


@query
def f2_covariates(g: Given) -> DataFrame:
    """Bounds of these iterations, the prior they end with, and the documents that ran out of steps."""
    model = g.covariate_iterations
    rows = [("bound", i, 0, float(b)) for i, b, _ in model.history]
    rows += [("coefficient", d, k, float(v)) for (d, k), v in np.ndenumerate(model.gamma)]
    rows += [("covariance", i, j, float(v)) for (i, j), v in np.ndenumerate(model.sigma)]
    rows += [("unsettled", i, 0, float(n)) for i, n in enumerate(model.unsettled, 1)]
    table = g.spark.createDataFrame(rows, "what STRING, i BIGINT, j BIGINT, value DOUBLE")
    return table.select("what", "i", "j", rounded("value", 3))


@query
def f2_fit(g: Given) -> DataFrame:
    return _fitted(g).top_words(5).select(
        whole("topic"), whole("rank"), whole("term_id"), "term", rounded("prob")
    )


@query
def p5_output(g: Given) -> DataFrame:
    """A fitted model saved, loaded, and listed: rows per table."""
    folder = g.space.path("model")
    _fitted(g, 2).save(folder, mode="overwrite")
    tables = load(g.spark, folder).tables()
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in sorted(tables.items())
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result
