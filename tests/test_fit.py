from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom import FitParams, Workspace, continue_fit, design, fit, fit_corpus, initialise, load, resume, score_corpus, score_texts, store_corpus
from themeloom.functions import linear_map, number_array
from themeloom.operators import aggregate, control, mstep
from themeloom.operators.estep import RESULT, infer
from themeloom.plans.em import document_logits, with_state
from test_start import aligned


def direct_ridge(x, y):
    """The regression on the data themselves."""
    n, d = x.shape
    shape, penalty, rate, noise, w = (1 + n) / 2, float(d), 1.0, 1.0, np.zeros(d)
    while True:
        prior = np.diag([0.0] + [penalty] * (d - 1))
        spread = np.linalg.inv(prior + noise * x.T @ x)
        old, w = w, noise * spread @ x.T @ y
        noise = shape / (0.5 * (np.square(x @ w - y).sum() + np.trace(x.T @ x @ spread)) + rate)
        rate = 1 / (noise + 1)
        penalty = d / (4 / (penalty + 1) + w[1:] @ w[1:] + np.diag(spread)[1:].sum())
        if np.abs(w - old).sum() <= 1e-4:
            return w


def test_regression_from_sums_equals_regression_on_data(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    eta = x @ rng.normal(size=(4, 2)) + rng.normal(0, 0.3, (300, 2))
    covariates = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id BIGINT, x ARRAY<DOUBLE>")
    logits = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(eta)], "doc_id BIGINT, eta ARRAY<DOUBLE>")
    sums = mstep.moments(covariates, logits, 4, 3)
    gamma = mstep.ridge_coefficients(sums)
    np.testing.assert_allclose(gamma, np.column_stack([direct_ridge(x, eta[:, k]) for k in range(2)]), atol=1e-9)
    means = mstep.prior_mean(covariates, gamma)
    mu = {r["doc_id"]: r["mu"] for r in means.collect()}
    np.testing.assert_allclose([mu[i] for i in range(300)], x @ gamma, atol=1e-12)
    off = eta - x @ gamma
    scatter = aggregate.small_matrix(mstep.residual_scatter(logits, means, 2), 2)
    np.testing.assert_allclose(scatter, off.T @ off, atol=1e-9)
    np.testing.assert_allclose(mstep.scatter_from_moments(sums, gamma), off.T @ off, atol=1e-8)
    nu = np.array([[3.0, 0.5], [0.5, 2.0]])
    full = (off.T @ off + nu) / 300
    for shrink in (0.0, 0.4, 1.0):
        wanted = full.copy()
        wanted[0, 1] *= 1 - shrink
        wanted[1, 0] *= 1 - shrink
        np.testing.assert_allclose(mstep.prior_covariance(off.T @ off, nu, 300, shrink), wanted)


def test_one_covariate_gives_the_mean():
    y = np.array([[1.0, 4.0], [3.0, 8.0]])
    sums = mstep.Moments(np.array([[2.0]]), y.sum(axis=0)[None], y.T @ y, 2)
    np.testing.assert_allclose(mstep.ridge_coefficients(sums), [[2.0, 6.0]])


def test_coefficients_that_never_settle_end_with_a_warning(monkeypatch):
    monkeypatch.setattr(mstep, "RIDGE_TOLERANCE", -1.0)
    sums = mstep.Moments(np.eye(2) * 5, np.ones((2, 1)), np.ones((1, 1)) * 3, 5)
    with pytest.warns(UserWarning, match="still moved"):
        assert np.isfinite(mstep.ridge_coefficients(sums)).all()


def test_topics_are_shared_by_all_aspects(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [2.0, 1.0]), (1, 1, [1.0, 3.0])]
    phi = spark.createDataFrame(rows, "aspect INT, term_id INT, phi ARRAY<DOUBLE>")
    found = {r["term_id"]: r["b"] for r in mstep.topic_update(phi, 2).collect()}
    assert found == {0: [0.75, 0.25], 1: [0.25, 0.75]}


def test_sums_over_partitions(spark):
    """Nine results on any number of partitions: the same sums, every row kept."""
    vectors = [(3, 3), (4, 4), (5, 5), (17, 17), (19, 19), (21, 21), (99, 99), (13, 13), (11, 11)]
    rows = []
    for d, v in enumerate(vectors):
        rows.append(("doc", d, 0, None, [float(x) for x in v], float(d)))
        rows += [("nu", None, None, i, [25.0, 25.0], None) for i in range(2)]
    for parts in (1, 4, 9):
        result = spark.createDataFrame(rows, RESULT).repartition(parts)
        assert aggregate.small_matrix(aggregate.nu_sum(result, 2), 2).tolist() == [[225.0, 225.0], [225.0, 225.0]]
        stacked = aggregate.stacked_logits(result).collect()
        assert {r["doc_id"]: tuple(r["eta"]) for r in stacked} == dict(enumerate(vectors))
        total = aggregate.total_bound(result).first()
        assert (total["documents"], total["bound"]) == (9, 36.0)


@pytest.mark.parametrize(
    "bounds, limit, wanted",
    [
        ([-100.0], 1, (False, True)),
        ([-100.0], 5, (False, False)),
        ([-100.0, -50.0], 5, (False, False)),
        ([-100.0, -50.0], 2, (False, True)),
        ([-100.0, -99.9999], 5, (True, True)),
        ([-100.0, -120.0], 5, (True, True)),
    ],
)
def test_when_to_stop(spark, bounds, limit, wanted):
    state = control.verdict(bounds, 1e-3, limit)
    assert (state.converged, state.stop) == wanted
    history = spark.createDataFrame([(0, i, b) for i, b in enumerate(bounds, 1)], "run INT, iteration INT, bound DOUBLE")
    last = control.verdict_table(history, 1e-3, limit, "run").orderBy("iteration").collect()[-1]
    assert (last["converged"], last["stop"]) == wanted
    assert last["gain"] == state.gain


def test_reports(spark):
    topics = spark.createDataFrame(
        [(0, 0, 0.2), (0, 1, 0.5), (0, 2, 0.2), (1, 0, 1.0)], "topic INT, term_id INT, prob DOUBLE"
    )
    vocab = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "term_id INT, term STRING")
    best = control.top_words(topics, vocab, 2).orderBy("topic", "rank").collect()
    assert [(r["topic"], r["rank"], r["term"]) for r in best] == [(0, 1, "y"), (0, 2, "x"), (1, 1, "x")]
    other = spark.createDataFrame([(0, 0, 0.5), (2, 2, -1.0)], "topic INT, term_id INT, prob DOUBLE")
    found = control.l1_comparison(topics, other, ["topic", "term_id"], "prob").first()
    np.testing.assert_allclose(tuple(found), (1.9, 1.5, 0.3 + 0.5 + 0.2 + 1.0 + 1.0))
    a = spark.createDataFrame([(1, 7), (2, 8)], "rank INT, term_id INT")
    b = spark.createDataFrame([(2, 5), (1, 7), (3, 1)], "rank INT, term_id INT")
    assert sorted(tuple(r) for r in control.pair_by_rank(a, b).collect()) == [(1, 7, 7), (2, 8, 5)]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory, planted):
    space = Workspace(spark, str(tmp_path_factory.mktemp("fit")))
    built = store_corpus(
        space, planted.triplets(spark), planted.docs(spark), planted.terms, planted.covariates(spark), partitions=4
    )
    start = initialise(space, built, planted.topics)
    return built, start, fit_corpus(space, built, start.topics, FitParams(planted.topics, max_iterations=12))


def test_fit_finds_planted_topics(planted, fitted):
    built, start, model = fitted
    beta = model.topics.array()[0].T
    np.testing.assert_allclose(beta.sum(axis=1), 1.0)
    assert (aligned(beta, planted.beta) < 0.3).all()
    assert aligned(beta, planted.beta).sum() < aligned(start.topics.array()[0].T, planted.beta).sum()
    order = [int(np.abs(beta - true).sum(axis=1).argmin()) for true in planted.beta]
    theta = {r["doc_id"]: np.array(r["theta"]) for r in model.doc_topics().collect()}
    assert len(theta) == planted.documents
    found = np.array([theta[d][order] for d in range(planted.documents)])
    assert np.abs(found - planted.theta).mean() < 0.06
    bounds = [b for _, b, _ in model.history]
    assert all(b > a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:]))
    assert [i for i, _, _ in model.history] == list(range(1, len(bounds) + 1))
    # The means follow from the coefficients; sigma stays a covariance.
    mu = {r["doc_id"]: r["mu"] for r in model.prior_means.collect()}
    np.testing.assert_allclose([mu[d] for d in range(planted.documents)], planted.x @ model.gamma, atol=1e-10)
    assert (np.linalg.eigvalsh(model.sigma) > 0).all()


def test_model_survives_saving(spark, tmp_path, fitted):
    built, _, model = fitted
    model.save(str(tmp_path / "model"))
    back = load(spark, str(tmp_path / "model"))
    np.testing.assert_array_equal(back.topics.array(), model.topics.array())
    np.testing.assert_array_equal(back.gamma, model.gamma)
    np.testing.assert_array_equal(back.sigma, model.sigma)
    assert back.history == model.history and back.converged == model.converged and back.vocab is None
    a = {r["doc_id"]: r for r in score_corpus(built, model).collect()}
    b = {r["doc_id"]: r for r in score_corpus(built, back).collect()}
    assert all(np.allclose(a[d]["eta"], b[d]["eta"]) for d in a)


def test_fit_does_not_depend_on_partitions(spark, tmp_path, planted):
    models = []
    for parts in (1, 2, 8):
        space = Workspace(spark, str(tmp_path / str(parts)))
        shuffled = planted.triplets(spark).orderBy(F.rand(parts))
        built = store_corpus(space, shuffled, planted.docs(spark), planted.terms, planted.covariates(spark), partitions=parts)
        start = initialise(space, built, 3)
        models.append(fit_corpus(space, built, start.topics, FitParams(3, max_iterations=2)))
    for other in models[1:]:
        np.testing.assert_allclose(other.topics.array(), models[0].topics.array(), atol=1e-8)
        np.testing.assert_allclose(other.gamma, models[0].gamma, atol=1e-7)
        np.testing.assert_allclose(other.sigma, models[0].sigma, atol=1e-7)


def test_fit_goes_on_where_it_stopped(spark, space, tmp_path, planted):
    """Two single iterations, each started from the other's saved result, equal two in a row."""
    built = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, planted.covariates(spark), partitions=3)
    start = initialise(space, built, 3).topics
    two = fit_corpus(space, built, start, FitParams(3, max_iterations=2, threshold=-1.0))
    one = fit_corpus(Workspace(spark, space.folder), built, start, FitParams(3, max_iterations=1))
    assert len(one.history) == 1 and one.history[0][1] == pytest.approx(two.history[0][1])
    assert not np.allclose(one.sigma, two.sigma) and not np.allclose(one.gamma, two.gamma)
    one.save(str(tmp_path / "one"))
    more = resume(space, built, load(spark, str(tmp_path / "one")), FitParams(3, max_iterations=2, threshold=-1.0))
    assert [i for i, _, _ in more.history] == [1, 2]
    assert more.history[1][1] > more.history[0][1]
    assert [b for _, b, _ in more.history] == pytest.approx([b for _, b, _ in two.history])
    for name in ("gamma", "sigma"):
        np.testing.assert_allclose(getattr(more, name), getattr(two, name), atol=1e-8)
    np.testing.assert_allclose(more.topics.array(), two.topics.array(), atol=1e-9)
    a, b = ({r["doc_id"]: r["eta"] for r in m.logits.collect()} for m in (more, two))
    assert set(a) == set(b) and all(np.allclose(a[d], b[d], atol=1e-7) for d in a)
    # Documents without logits start at 0.
    some = one.logits.where("doc_id % 2 = 0")
    part = fit_corpus(space, built, start, FitParams(3, max_iterations=1), logits=some)
    assert part.logits.count() == planted.documents
    narrow = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, partitions=2)
    with pytest.raises(ValueError, match="covariates"):
        resume(space, narrow, one, FitParams(3))
    with pytest.raises(ValueError, match="start topics"):
        fit_corpus(space, built, start, FitParams(4))


def test_coefficients_take_one_constant_in_the_plan(spark):
    rng = np.random.default_rng(0)
    gamma = rng.normal(size=(200, 74))
    x = spark.createDataFrame([(rng.normal(size=200).tolist(),)], "x ARRAY<DOUBLE>")
    found = x.select("x", linear_map(F.col("x"), gamma.T.tolist()).alias("mu"))
    row = found.first()
    np.testing.assert_allclose(row["mu"], np.array(row["x"]) @ gamma, atol=1e-12)
    odd = [0.1, -1e-300, 1e17, float("inf"), 5e-324]
    assert spark.range(1).select(number_array(odd).alias("v")).first()["v"] == odd
    assert spark.range(1).select(number_array([]).alias("v")).first()["v"] == []


def test_iterations_join_without_a_shuffle(spark, space, fitted, planted):
    built, start, model = fitted
    size = planted.topics - 1
    first = infer(with_state(built.rows, None, model.gamma, size), start.topics, model.prior)
    stored = space.bucketed(first, "inferred", "doc_id", built.buckets, split_by="kind")
    second = infer(with_state(built.rows, document_logits(stored), model.gamma, size), start.topics, model.prior)
    assert "Exchange" not in second._jdf.queryExecution().executedPlan().toString()
    again = {r["doc_id"]: r["vec"] for r in second.where("kind = 'doc'").collect()}
    before = {r["doc_id"]: r["vec"] for r in stored.where("kind = 'doc'").collect()}
    assert set(again) == set(before) and len(again) == planted.documents
    for d in again:  # started from its own result, the search stays there
        np.testing.assert_allclose(again[d], before[d], atol=1e-8)


def test_settings_must_cover_the_aspects(spark, space, planted, fitted):
    _, start, _ = fitted
    aspects = planted.docs(spark).withColumn("aspect", (F.col("doc_id") % 2).cast("int"))
    built = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, aspects=aspects, partitions=2)
    assert built.aspects == 2
    with pytest.raises(ValueError, match="2 aspects"):
        fit_corpus(space, built, start.topics, FitParams(planted.topics))


def test_fits_that_share_a_workspace_keep_their_tables(spark, space, planted):
    built = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, partitions=2)
    start = initialise(space, built, 2)
    first = fit_corpus(space, built, start.topics, FitParams(2, max_iterations=1))
    wanted = first.topics.array()
    fit_corpus(space, built, initialise(space, built, 2).topics, FitParams(2, max_iterations=1, sigma_shrink=1.0))
    np.testing.assert_array_equal(first.topics.array(), wanted)
    assert start.anchors.products.count() == planted.terms
    assert first.doc_topics().count() == planted.documents


def test_fit_from_texts(spark, space):
    texts = [(d, " ".join(["sea ship sail"] * 3 if d % 2 else ["rock hill peak"] * 3) + (" the" * (d % 5 + 1))) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    model = fit(docs, FitParams(2, max_iterations=3, min_doc_share=0.1, partitions=3), space=space)
    words = model.top_words(3).collect()
    groups = [{w["term"] for w in words if w["topic"] == k} - {"the"} for k in range(2)]
    assert not groups[0] & groups[1]
    assert {"sea", "ship", "sail"} >= groups[0] or {"rock", "hill", "peak"} >= groups[0]
    with pytest.raises(ValueError, match="vocabulary"):
        fit(docs, FitParams(8, min_doc_share=0.1), space=Workspace(spark, space.folder))


def test_texts_scored_by_a_loaded_model(spark, space, tmp_path):
    """Terms are matched by their string, whatever the ids of the new texts' own vocabulary."""
    words = ["river boat water fish", "tax bank money loan"]
    docs = spark.createDataFrame([(i, " ".join([words[i % 2]] * (2 + i % 3)) + f" x{i % 5}") for i in range(40)], "doc_id BIGINT, text STRING")
    docs = spark.createDataFrame([(r["doc_id"], "".join(c for c in r["text"] if not c.isdigit())) for r in docs.collect()], docs.schema)
    model = fit(docs, FitParams(2, max_iterations=3), space=space)
    model.save(str(tmp_path / "model"))
    back = load(spark, str(tmp_path / "model"))
    own = {r["doc_id"]: r["bound"] for r in score_texts(Workspace(spark, space.folder), docs, back).collect()}
    fewer = docs.where("doc_id in (3, 8)").union(spark.createDataFrame([(99, "unseen words only")], docs.schema))
    found = {r["doc_id"]: r["bound"] for r in score_texts(Workspace(spark, space.folder), fewer, back).collect()}
    assert found[3] == pytest.approx(own[3]) and found[8] == pytest.approx(own[8]) and found[99] == pytest.approx(0.0, abs=1e-6)
    wide = docs.select("doc_id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    with pytest.raises(ValueError, match="covariates"):
        score_texts(Workspace(spark, space.folder), docs, back, wide)


def test_bounds_do_not_depend_on_partitions(spark, planted, tmp_path):
    """Bit for bit: the stop must not either."""
    found = []
    for parts in (1, 2, 8):
        space = Workspace(spark, str(tmp_path / f"b{parts}"))
        built = store_corpus(space, planted.triplets(spark).orderBy(F.rand(parts)), planted.docs(spark), planted.terms, planted.covariates(spark), partitions=parts)
        model = fit_corpus(space, built, initialise(space, built, 3).topics, FitParams(3, max_iterations=3, threshold=-1.0))
        found.append([b for _, b, _ in model.history])
    assert found[0] == found[1] == found[2]


def test_sums_in_one_job_equal_those_apart(spark, fitted, planted):
    built, start, model = fitted
    size = planted.topics - 1
    result = infer(with_state(built.rows, None, model.gamma, size), start.topics, model.prior).persist()
    width = 2 + size
    sums = aggregate.iteration_sums(result, size, width)
    total = aggregate.total_bound(result).first()
    assert (sums.documents, sums.unsettled, sums.bound) == (total["documents"], 0, total["bound"])
    np.testing.assert_allclose(sums.nu, aggregate.small_matrix(aggregate.nu_sum(result, size), size), rtol=1e-12)
    np.testing.assert_allclose(sums.moment, aggregate.small_matrix(aggregate.moment_sum(result, width), width), rtol=1e-12)
    phi = aggregate.phi_by_aspect(result, planted.topics)
    wanted = {r["term_id"]: r["b"] for r in mstep.topic_update(phi, planted.topics).collect()}
    found = {r["term_id"]: r["b"] for r in mstep.topic_update(phi, planted.topics, sums.weight.tolist()).collect()}
    assert set(found) == set(wanted)
    np.testing.assert_allclose([found[t] for t in sorted(found)], [wanted[t] for t in sorted(wanted)], rtol=1e-11)
    assert model.unsettled == [0] * len(model.history)
    result.unpersist()


DRIVER = """
import os, sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
from conftest import Planted
from themeloom import FitParams, Workspace, fit_corpus, initialise, store_corpus
from themeloom.plans.journal import Journal

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
planted, space = Planted(), Workspace(spark, {folder!r}, "fit")
built = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, planted.covariates(spark), partitions=3)
start = initialise(space, built, 3).topics
whole = Journal.commit

def commit(self, number, *rest):
    whole(self, number, *rest)
    if number == 2:
        os._exit(7)

Journal.commit = commit
fit_corpus(space, built, start, FitParams(3, max_iterations=4, threshold=-1.0))
"""


def test_fit_goes_on_after_its_driver_ended(spark, tmp_path, planted):
    """From the folder alone; the result is that of an uninterrupted fit."""
    tests = os.path.dirname(os.path.abspath(__file__))
    script = DRIVER.format(root=os.path.dirname(tests), tests=tests, folder=str(tmp_path))
    ended = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300, cwd=tmp_path)
    assert ended.returncode == 7, ended.stderr[-2000:]
    space = Workspace(spark, str(tmp_path / "other"))
    found = continue_fit(space, str(tmp_path / "fit"))
    plain = Workspace(spark, str(tmp_path / "plain"))
    built = store_corpus(plain, planted.triplets(spark), planted.docs(spark), planted.terms, planted.covariates(spark), partitions=3)
    wanted = fit_corpus(plain, built, initialise(plain, built, 3).topics, FitParams(3, max_iterations=4, threshold=-1.0))
    assert [i for i, _, _ in found.history] == [1, 2, 3, 4]
    assert [b for _, b, _ in found.history] == pytest.approx([b for _, b, _ in wanted.history], abs=1e-5)
    np.testing.assert_allclose(found.topics.array(), wanted.topics.array(), atol=1e-9)
    np.testing.assert_allclose(found.gamma, wanted.gamma, atol=1e-7)
    np.testing.assert_allclose(found.sigma, wanted.sigma, atol=1e-7)
    assert found.logits.count() == planted.documents
    # The fit that went on left records of its own: its end is found again as it is.
    again = continue_fit(Workspace(spark, str(tmp_path / "more")), space.folder)
    assert again.history == found.history
    np.testing.assert_array_equal(again.topics.array(), found.topics.array())
    with pytest.raises(FileNotFoundError):
        continue_fit(space, str(tmp_path / "nothing"))


def test_a_fit_of_its_own_workspace_is_closed(spark):
    docs = spark.createDataFrame([(d, "sea ship sail" if d % 2 else "rock hill peak") for d in range(20)], "doc_id BIGINT, text STRING")
    model = fit(docs, FitParams(2, max_iterations=1))
    folder = model.space.folder
    assert os.path.exists(folder)
    model.close()
    assert not os.path.exists(folder)


def test_sparse_regression_equals_the_dense_one(spark):
    """Two categorical columns, whose levels do occur together, and a number."""
    rng = np.random.default_rng(11)
    rows = [(i, f"a{rng.integers(0, 9)}", f"b{rng.integers(0, 6)}", float(rng.normal())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, a STRING, b STRING, v DOUBLE")
    docs = docs.withColumn("a", F.when(F.col("doc_id") % 17 > 0, F.col("a")))  # some levels miss
    dense = design(docs, ["a", "b"], {"v": F.col("v")})
    sparse = design(docs, ["a", "b"], {"v": F.col("v")}, sparse=True)
    assert dense.names == sparse.names
    width = len(dense.names)
    x = {r["doc_id"]: np.array(r["x"]) for r in dense.table.collect()}
    for r in sparse.table.collect():
        filled = np.zeros(width)
        filled[r["x"]["at"]] = r["x"]["v"]
        np.testing.assert_array_equal(filled, x[r["doc_id"]])
    x = np.array([x[i] for i in range(400)])
    y = x @ rng.normal(size=(width, 3)) + rng.normal(0, 0.5, (400, 3))
    sums = mstep.sparse_moments(mstep.sparse_products(sparse.table), x.T @ y, y.T @ y, 400)
    gamma = mstep.sparse_ridge_coefficients(sums)
    np.testing.assert_allclose(gamma, mstep.ridge_coefficients(mstep.Moments(x.T @ x, x.T @ y, y.T @ y, 400)), atol=1e-9)
    np.testing.assert_allclose(sums.xx_times(gamma), x.T @ x @ gamma, atol=1e-9)
    off = y - x @ gamma
    np.testing.assert_allclose(mstep.scatter_from_moments(sums, gamma), off.T @ off, atol=1e-8)
    mu = {r["doc_id"]: r["mu"] for r in mstep.prior_mean(sparse.table, gamma).collect()}
    np.testing.assert_allclose([mu[i] for i in range(400)], x @ gamma, atol=1e-12)


def test_ten_thousand_levels(spark):
    """One level in two documents each: the square of the covariates is never there as a matrix."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.format_string("g%05d", F.col("id") % 10_000).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    found = design(docs, ["g"], {"v": F.col("v")})
    assert len(found.names) == 10_001
    at = np.arange(20_000) % 10_000
    v = np.arange(20_000) % 7 - 3.0
    y = np.column_stack([np.sin(at) + 0.1 * v, 0.5 * v])
    xy = np.zeros((10_001, 2))
    np.add.at(xy, at[at < 9999] + 1, y[at < 9999])
    scaled = (v - v.mean()) / v.std()
    xy[0], xy[10_000] = y.sum(axis=0), scaled @ y
    sums = mstep.sparse_moments(mstep.sparse_products(found.table), xy, y.T @ y, 20_000)
    assert len(sums.v) < 4 * 10_001
    gamma = mstep.sparse_ridge_coefficients(sums)
    means = gamma[0] + scaled[:, None] * gamma[-1]
    means[at < 9999] += gamma[at[at < 9999] + 1]
    assert np.abs(means[:, 1] - y[:, 1]).max() < 0.02  # a number explains it all
    assert np.corrcoef(means[:, 0], y[:, 0])[0, 1] > 0.97


def test_fit_with_sparse_covariates_equals_the_dense_one(spark, space, planted):
    kinds = planted.docs(spark).select("doc_id", F.format_string("k%d", F.col("doc_id") % 7).alias("kind"))
    models = []
    for sparse in (False, True):
        x = design(kinds, ["kind"], {"n": (F.col("doc_id") % 5).cast("double")}, sparse=sparse).table
        built = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, x, partitions=3)
        assert built.covariates == 8
        start = initialise(space, built, 3)
        models.append((built, fit_corpus(space, built, start.topics, FitParams(3, max_iterations=3, threshold=-1.0))))
    (_, a), (built, b) = models
    np.testing.assert_allclose(b.gamma, a.gamma, atol=1e-6)
    np.testing.assert_allclose(b.sigma, a.sigma, atol=1e-6)
    np.testing.assert_allclose(b.topics.array(), a.topics.array(), atol=1e-8)
    left = {r["doc_id"]: r["mu"] for r in a.prior_means.collect()}
    right = {r["doc_id"]: r["mu"] for r in b.prior_means.collect()}
    np.testing.assert_allclose([right[i] for i in range(600)], [left[i] for i in range(600)], atol=1e-6)
    assert score_corpus(built, b).count() == planted.documents
