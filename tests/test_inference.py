from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom import score, scored_documents, store_corpus
from themeloom.operators import aggregate, estep, newton
from themeloom.operators.estep import Prior, Topics, infer
from themeloom.operators.recover import per_aspect


def one_document(rng, terms=12, topics=4):
    beta = rng.dirichlet(np.full(terms, 0.3), topics).T[None]
    counts = rng.integers(1, 9, (1, terms)).astype(float)
    eta, mu = rng.normal(size=(1, topics - 1)), rng.normal(size=(1, topics - 1))
    root = rng.normal(size=(topics - 1, topics - 1))
    return beta, counts, eta, mu, np.linalg.inv(root @ root.T + np.eye(topics - 1))


@pytest.mark.parametrize("seed", range(5))
def test_derivatives_equal_finite_differences(seed):
    beta, counts, eta, mu, precision = one_document(np.random.default_rng(seed))
    slope, curve, phi = newton.derivatives(beta, counts, eta, mu, precision)
    h = 1e-6
    for k in range(eta.shape[1]):
        up, down = eta.copy(), eta.copy()
        up[0, k] += h
        down[0, k] -= h
        rise = newton.objective(beta, counts, up, mu, precision) - newton.objective(beta, counts, down, mu, precision)
        assert slope[0, k] == pytest.approx(rise[0] / (2 * h), abs=1e-5)
        bend = newton.derivatives(beta, counts, up, mu, precision)[0] - newton.derivatives(beta, counts, down, mu, precision)[0]
        np.testing.assert_allclose(curve[0, k], bend[0] / (2 * h), atol=1e-5)
    np.testing.assert_allclose(phi.sum(axis=2), counts)


def test_objective_by_its_formula_and_without_overflow():
    beta, counts, eta, mu, precision = one_document(np.random.default_rng(9))
    e = np.exp(np.append(eta[0], 0.0))
    off = eta[0] - mu[0]
    plain = 0.5 * off @ precision @ off - (counts[0] @ np.log(beta[0] @ e) - counts.sum() * np.log(e.sum()))
    assert newton.objective(beta, counts, eta, mu, precision)[0] == pytest.approx(plain)
    far = np.array([[900.0, -900.0, 0.0]])
    assert np.isfinite(newton.objective(beta, counts, far, mu, precision)).all()
    assert np.isfinite(newton.map_logits(beta, counts, far, mu, precision)).all()


def test_search_ends_at_a_minimum():
    rng = np.random.default_rng(2)
    for topics in (2, 5, 12):
        beta = rng.dirichlet(np.full(60, 0.1), topics).T
        counts = rng.integers(0, 6, (80, 60)).astype(float)
        counts[3] = 0.0  # a document without terms
        padded = np.broadcast_to(beta, (80, 60, topics)).copy()
        mu = rng.normal(size=(80, topics - 1))
        precision = np.eye(topics - 1) / 20.0
        eta = newton.map_logits(padded, counts, np.zeros_like(mu), mu, precision)
        slope, curve, _ = newton.derivatives(padded, counts, eta, mu, precision)
        assert np.abs(slope).max() < 1e-7
        assert (np.linalg.eigvalsh(curve) > 0).all()
        np.testing.assert_allclose(eta[3], mu[3], atol=1e-9)


def test_repaired_curvature_is_dominant():
    bad = np.array([[1.0, 3.0, 0.0], [3.0, 2.0, 1.0], [0.0, 1.0, 5.0]])
    good = np.diag([2.0, 3.0, 4.0])
    nu, half = newton.inverse_curvature(np.stack([bad, good]))
    raised = bad.copy()
    np.fill_diagonal(raised, [3.0, 4.0, 5.0])
    np.testing.assert_allclose(np.linalg.inv(nu[0]), raised, atol=1e-6)
    np.testing.assert_allclose(nu[1], np.diag([1 / 2, 1 / 3, 1 / 4]))
    assert half[1] == pytest.approx(0.5 * np.log(24.0))


@pytest.fixture
def case(spark, space, planted):
    topics = planted.topics
    table = spark.createDataFrame(
        [(int(w), [float(v) for v in planted.beta[:, w]]) for w in range(planted.terms)],
        "term_id INT, b ARRAY<DOUBLE>",
    )
    aspects = planted.docs(spark).withColumn("aspect", (F.col("doc_id") % 3).cast("int"))
    built = store_corpus(
        space, planted.triplets(spark), planted.docs(spark), planted.terms,
        planted.covariates(spark), aspects, partitions=4,
    )
    rng = np.random.default_rng(11)
    root = rng.normal(size=(topics - 1, topics - 1))
    covariance = root @ root.T + np.eye(topics - 1)
    zeros = F.array(*[F.lit(0.0)] * (topics - 1))
    rows = built.rows.withColumn("eta", zeros).withColumn("mu", F.array(*[F.get("x", F.lit(1)) * 0.1] * (topics - 1)))
    return built, rows, Topics(table, topics, planted.terms), covariance


def by_hand(planted, covariance):
    """The same, document by document."""
    prior = Prior.of(covariance)
    found = []
    for d in range(planted.documents):
        used = np.flatnonzero(planted.counts[d])
        beta, counts = planted.beta[:, used].T[None], planted.counts[d, used][None].astype(float)
        mu = np.full((1, planted.topics - 1), 0.1 * planted.x[d, 1])
        eta = newton.map_logits(beta, counts, np.zeros_like(mu), mu, prior.precision)
        result = newton.evaluate(beta, counts, eta, mu, prior.precision, prior.entropy)
        theta = np.exp(np.append(eta[0], 0.0))
        theta /= theta.sum()
        curve = newton.derivatives(beta, counts, eta, mu, prior.precision)[1][0]
        off = eta[0] - mu[0]
        bound = (
            counts[0] @ np.log(beta[0] @ theta)
            - 0.5 * np.linalg.slogdet(curve)[1]
            - 0.5 * off @ prior.precision @ off
            - 0.5 * np.linalg.slogdet(covariance)[1]
        )
        assert result.bound[0] == pytest.approx(bound)
        np.testing.assert_allclose(result.nu[0], np.linalg.inv(curve), atol=1e-10)
        found.append((eta[0], bound, result.nu[0], used, result.phi[0]))
    return found


def test_job_equals_document_by_document(spark, case, planted):
    built, rows, topics, covariance = case
    result = infer(rows, topics, Prior.of(covariance), aspects=3, detail=True).persist()
    wanted = by_hand(planted, covariance)
    docs = {r["doc_id"]: r for r in result.where("kind = 'doc'").collect()}
    assert len(docs) == planted.documents
    for d, (eta, bound, *_rest) in enumerate(wanted):
        np.testing.assert_allclose(docs[d]["vec"], eta, atol=1e-8)
        assert docs[d]["bound"] == pytest.approx(bound)
    size = planted.topics - 1
    nu = aggregate.small_matrix(aggregate.nu_sum(result, size), size)
    np.testing.assert_allclose(nu, sum(w[2] for w in wanted), atol=1e-8)
    both = np.array([np.append(planted.x[d], wanted[d][0]) for d in range(planted.documents)])
    width = both.shape[1]
    moment = aggregate.small_matrix(aggregate.moment_sum(result, width), width)
    np.testing.assert_allclose(moment, both.T @ both, atol=1e-6)
    phi = np.zeros((3, planted.terms, planted.topics))
    for d, (_, _, _, used, counts) in enumerate(wanted):
        phi[d % 3, used] += counts
    found = np.zeros_like(phi)
    for r in aggregate.phi_by_aspect(result, planted.topics).collect():
        found[r["aspect"], r["term_id"]] = r["phi"]
    np.testing.assert_allclose(found, phi, atol=1e-7)
    assert found.sum() == pytest.approx(planted.counts.sum())
    total = aggregate.total_bound(result).first()
    assert total["documents"] == planted.documents
    assert total["bound"] == pytest.approx(sum(w[1] for w in wanted))
    one = {r["idx"]: r["vec"] for r in result.where("kind = 'doc_nu' and doc_id = 17").collect()}
    np.testing.assert_allclose([one[k] for k in range(size)], wanted[17][2], atol=1e-8)
    terms = {r["idx"]: r["vec"] for r in result.where("kind = 'doc_phi' and doc_id = 17").collect()}
    assert sorted(terms) == wanted[17][3].tolist()
    result.unpersist()


def summary(result, topics):
    docs = {r["doc_id"]: (r["vec"], r["bound"]) for r in result.where("kind = 'doc'").collect()}
    phi = {(r["aspect"], r["term_id"]): r["phi"] for r in aggregate.phi_by_aspect(result, topics).collect()}
    nu = {r["i"]: r["vec"] for r in aggregate.nu_sum(result, topics - 1).collect()}
    return docs, phi, nu


def assert_same(a, b):
    for left, right in zip(a, b):
        assert set(left) == set(right)
        for key in left:
            np.testing.assert_allclose(np.hstack(left[key]), np.hstack(right[key]), rtol=1e-7, atol=1e-7)


def test_results_do_not_depend_on_layout(spark, case, planted):
    _, rows, topics, covariance = case
    prior = Prior.of(covariance)
    wanted = summary(infer(rows, topics, prior, 3), planted.topics)
    for parts in (1, 2, 8):
        shuffled = rows.orderBy(F.rand(4)).repartition(parts)
        assert_same(summary(infer(shuffled, topics, prior, 3), planted.topics), wanted)
    joined = infer(rows, topics, prior, 3, topic_bytes=0)  # topics too large to send around
    assert_same(summary(joined, planted.topics), wanted)
    split = Topics(per_aspect(topics.table, 3), topics.topics, topics.terms, aspects=3)
    assert_same(summary(infer(rows, split, prior, 3), planted.topics), wanted)
    assert_same(summary(infer(rows, split, prior, 3, topic_bytes=0), planted.topics), wanted)


def test_terms_without_topics_count_the_same_either_way(spark, case, planted):
    _, rows, topics, covariance = case
    fewer = Topics(topics.table.where("term_id <> 3"), topics.topics, topics.terms)
    wanted = summary(infer(rows, fewer, Prior.of(covariance), 3), planted.topics)
    joined = summary(infer(rows, fewer, Prior.of(covariance), 3, topic_bytes=0), planted.topics)
    assert_same(joined, wanted)


def test_score_of_new_documents(spark, space, case, planted):
    _, _, topics, covariance = case
    triplets = spark.createDataFrame([(5, 3, 2.0), (5, 40, 1.0)], "doc_id BIGINT, term_id INT, cnt DOUBLE")
    new = spark.createDataFrame([(5,), (6,)], "doc_id BIGINT")
    rows = store_corpus(space, triplets, new, planted.terms, partitions=2).rows
    means = spark.createDataFrame([(6, [0.5, 0.0, -0.5, 1.0])], "doc_id BIGINT, mu ARRAY<DOUBLE>")
    found = {r["doc_id"]: r for r in scored_documents(score(rows, topics, Prior.of(covariance), means)).collect()}
    np.testing.assert_allclose(found[6]["eta"], [0.5, 0.0, -0.5, 1.0], atol=1e-9)  # nothing but its prior mean
    theta = np.exp([0.5, 0.0, -0.5, 1.0, 0.0])
    np.testing.assert_allclose(found[6]["theta"], theta / theta.sum(), atol=1e-9)
    assert found[6]["bound"] == pytest.approx(0.0, abs=1e-9)
    assert np.sum(found[5]["theta"]) == pytest.approx(1.0)


def test_underflowing_topics_stay_finite():
    beta = np.full((1, 2, 3), 5e-324)
    counts = np.ones((1, 2))
    zeros, precision = np.zeros((1, 2)), np.eye(2) / 20
    eta = newton.map_logits(beta, counts, zeros, zeros, precision)
    result = newton.evaluate(beta, counts, eta, zeros, precision, 0.0)
    assert np.isfinite(eta).all() and np.isfinite(result.bound).all() and np.isfinite(result.nu).all()


@pytest.mark.parametrize("limit", [1 << 28, 5000, 100])
def test_expected_counts_within_a_limit(limit):
    """Whole arrays, some of them, or sorted terms that are handed on as they grow."""
    rng = np.random.default_rng(8)
    terms, topics = 50, 4
    wanted = np.zeros((3, terms, topics))
    held, rows = estep._Counts(terms, topics, limit), []
    for _ in range(20):
        aspect, term = rng.integers(0, 3, 60), rng.integers(0, terms - 1, 60)
        counts = rng.random((60, topics))
        np.add.at(wanted, (aspect, term), counts)
        rows += held.add(aspect, term, counts)
        assert 8 * topics * (len(held.keys) + held.waiting) <= max(limit, 8 * topics * 60)
    rows += held.rows()
    found = np.zeros_like(wanted)
    for batch in rows:
        for r in batch.to_pylist():
            found[r["aspect"], r["idx"]] += r["vec"]
    np.testing.assert_allclose(found, wanted)
    assert (len(rows) > 3) == (limit == 100)


def test_topics_go_once_per_block_and_term(spark, case, planted, monkeypatch):
    """Large topics: what is shuffled has no factor of topics per entry, and many blocks give the same."""
    _, rows, topics, covariance = case
    prior = Prior.of(covariance)
    wanted = summary(infer(rows, topics, prior, 3), planted.topics)
    monkeypatch.setattr(estep._blocks, "__defaults__", (40_000,))
    placed, dictionary = estep._blocks(rows, topics)
    blocks = placed.select("block").distinct().count()
    entries = rows.agg(F.sum(F.size("term_ids"))).first()[0]
    assert blocks > 10
    assert dictionary.count() == dictionary.select("block", "term_id").distinct().count() < entries
    assert_same(summary(infer(rows, topics, prior, 3, topic_bytes=0), planted.topics), wanted)


def test_bounds_without_sums(case, planted):
    _, rows, topics, covariance = case
    full = {r["doc_id"]: r for r in infer(rows, topics, Prior.of(covariance), 3).where("kind = 'doc'").collect()}
    found = infer(rows, topics, Prior.of(covariance), 3, sums=False).collect()
    assert {r["kind"] for r in found} == {"doc"} and len(found) == planted.documents
    for r in found:
        np.testing.assert_array_equal(r["vec"], full[r["doc_id"]]["vec"])
        assert r["bound"] == full[r["doc_id"]]["bound"]


def large_case(topics, documents=40, terms=80):
    rng = np.random.default_rng(topics)
    beta = rng.dirichlet(np.full(400, 0.05), topics).T
    ids = np.array([rng.choice(400, terms, replace=False) for _ in range(documents)])
    counts = rng.integers(1, 9, (documents, terms)).astype(float)
    counts[3] = 0.0
    root = rng.normal(size=(topics - 1, topics - 1)) / np.sqrt(topics)
    precision = np.linalg.inv(root @ root.T + np.eye(topics - 1))
    return beta[ids], counts, np.zeros((documents, topics - 1)), rng.normal(size=(documents, topics - 1)), precision


def test_slope_alone_is_the_same():
    values, counts, eta, mu, precision = large_case(7)
    np.testing.assert_allclose(
        newton.gradient(values, counts, mu, eta, precision), newton.derivatives(values, counts, mu, eta, precision)[0], atol=1e-9
    )


@pytest.mark.parametrize("topics", [3, 10, 30])
def test_limited_memory_finds_the_newton_optimum(topics):
    given = large_case(topics)
    wanted, all_settled = newton.newton_steps(*given)
    found, settled = newton.limited_memory(*given)
    assert all_settled.all() and settled.all()
    np.testing.assert_allclose(found, wanted, atol=1e-5)
    best, value = newton.objective(*given[:2], wanted, *given[3:]), newton.objective(*given[:2], found, *given[3:])
    np.testing.assert_allclose(value, best, rtol=1e-12, atol=1e-12)


def test_many_topics_settle():
    given = large_case(200)
    found, settled = newton.search(*given)
    assert settled.all()
    assert np.abs(newton.gradient(*given[:2], found, *given[3:])).max() < 1e-4
    np.testing.assert_allclose(found[3], given[3][3], atol=1e-6)  # without terms: the prior mean
    again, _ = newton.newton_steps(*given[:2], found, *given[3:])
    np.testing.assert_allclose(found, again, atol=1e-5)


def test_documents_that_run_out_of_steps_are_told(spark, case, planted, monkeypatch):
    values, counts, eta, mu, precision = large_case(10)
    for name, steps in (("NEWTON_ROUNDS", newton.newton_steps), ("LIMITED_ROUNDS", newton.limited_memory)):
        monkeypatch.setattr(newton, name, 2)
        assert not steps(values, counts, eta, mu, precision)[1].all()
    _, rows, topics, covariance = case
    monkeypatch.setattr(newton, "NEWTON_ROUNDS", 1)
    task = estep._Task(None, topics.topics, topics.terms, 1, Prior.of(covariance), False, True)
    batch = rows.drop("x").limit(5).toArrow().combine_chunks().to_batches()[0]
    cells = topics.array()[0]
    found = [r for b in task._solved([batch], lambda _, terms: cells[terms]) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in found if r["kind"] == "unsettled") == sorted(batch.column("doc_id").to_pylist())


def test_curvature_with_many_topics(spark):
    """75 topics: half of the matrix is added up, and the plan stays small."""
    values, counts, _, eta, precision = large_case(75, 6, 30)
    rows = [(d, t, float(counts[d, t]), values[d, t].tolist()) for d in range(6) for t in range(30) if counts[d, t]]
    sliced = spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE, b ARRAY<DOUBLE>")
    logits = spark.createDataFrame([(d, eta[d].tolist()) for d in range(6)], "doc_id BIGINT, eta ARRAY<DOUBLE>")
    start = time.perf_counter()
    found = estep.hessian(sliced, logits, precision)
    found._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 1.0
    _, curve, _ = newton.derivatives(values, counts, eta, eta, precision)
    got = np.full(curve.shape, np.nan)
    for r in found.collect():
        got[r["doc_id"], r["k1"], r["k2"]] = r["value"]
    used = counts.any(axis=1)
    np.testing.assert_allclose(got[used], curve[used], atol=1e-8)
    assert np.isnan(got[~used]).all()


def test_large_topics_are_not_repeated(spark):
    """Topics of frequent terms are sent to the entries, the others' are shuffled once; no entry is lost."""
    known = {0: [0.1, 0.2], 1: [0.3, 0.4], 9_000_000: [0.5, 0.6]}
    table = spark.createDataFrame(list(known.items()), "term_id INT, b ARRAY<DOUBLE>")
    entries = [(1, 0, 2.0), (1, 0, 2.0), (1, 9_000_000, 1.0), (2, 1, 3.0), (2, 9_000_001, 1.0), (3, 2, 1.0), (3, None, 4.0), (None, 1, 5.0)]
    triplets = spark.createDataFrame(entries, "doc_id BIGINT, term_id INT, cnt DOUBLE")
    sliced = estep.topic_slice(triplets, Topics(table, 2, 10_000_000))
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    wanted = [(d, t, c, known.get(t, [0.0, 0.0])) for d, t, c in entries]
    found = [(r["doc_id"], r["term_id"], r["cnt"], r["b"]) for r in sliced.collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_large_topics_by_aspect(spark):
    table = spark.createDataFrame([(a, t, [0.1 * a, float(t)]) for a in range(2) for t in (0, 6_000_000)], "aspect INT, term_id INT, b ARRAY<DOUBLE>")
    triplets = spark.createDataFrame([(1, 0, 0, 1.0), (2, 1, 6_000_000, 2.0), (3, 1, 5, 1.0)], "doc_id BIGINT, aspect INT, term_id INT, cnt DOUBLE")
    found = estep.topic_slice(triplets, Topics(table, 2, 7_000_000, aspects=2)).orderBy("doc_id").collect()
    assert [r["b"] for r in found] == [[0.0, 0.0], [0.1, 6_000_000.0], [0.0, 0.0]]
