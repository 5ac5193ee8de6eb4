"""Co-occurrences, anchors and recovery against numpy."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from helpers import gram_of, matrix_of
from pyspark.sql import functions as F

from themeloom import initialise, store_corpus
from themeloom.constants import SMALLEST_DOUBLE
from themeloom.operators import anchors, recover
from themeloom.operators.gram import (
    SIDE_ENTRIES, TILE_ENTRIES, _each_tile, _joined_planes, _planes, _Profile, _tiles, _UpperCells,
    gram, gram_profile, gram_row_sums, gram_upper, mirrored, normalised_norms, profile_of, term_sums,
)
from themeloom.operators.products import NormalisedGram


@pytest.fixture
def built(spark, space, planted):
    return store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, partitions=4)


def test_gram_by_definition_in_every_layout(built, planted):
    wanted = gram_of(planted.counts)
    np.testing.assert_allclose(matrix_of(gram(built.rows, planted.terms), planted.terms), wanted, atol=1e-13)
    for cells in (50, 5000, 1 << 22):
        sparse = mirrored(gram_upper(built.rows, planted.terms, sparse_cells=cells))
        np.testing.assert_allclose(matrix_of(sparse, planted.terms), wanted, atol=1e-13)
    assert gram(built.rows, planted.terms).where("q = 0").count() == 0


@pytest.mark.parametrize("stripe, hot", [(None, None), (1 << 23, 1 << 28), (1 << 19, 1 << 28), (1 << 19, 40000), (1 << 19, 1)])
def test_profile_needs_no_gram(built, planted, stripe, hot):
    wanted = gram_of(planted.counts)
    profile = gram_profile(built.rows, planted.terms, stripe, hot, 0) if stripe else gram_profile(built.rows, planted.terms)
    found = {r["i"]: r for r in profile.collect()}
    assert len(found) == planted.terms
    rows = [found[i] for i in range(planted.terms)]
    np.testing.assert_array_equal([r["cells"] for r in rows], (wanted != 0).sum(axis=1))
    np.testing.assert_allclose([r["s"] for r in rows], wanted.sum(axis=1), atol=1e-12)
    np.testing.assert_allclose([r["r"] for r in rows], np.square(wanted).sum(axis=1), atol=1e-12)
    same = {r["i"]: r for r in profile_of(gram(built.rows, planted.terms)).collect()}
    np.testing.assert_allclose([same[i]["r"] for i in range(planted.terms)], [r["r"] for r in rows], atol=1e-12)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_products_need_no_gram(built, planted, limit):
    """By a broadcast vector and by joins."""
    q = gram_of(planted.counts)
    q /= q.sum(axis=1, keepdims=True)
    matrix = NormalisedGram(built.rows, gram_row_sums(built.rows), planted.terms, limit)
    picks = [3, 50, 7]
    np.testing.assert_allclose(matrix.dense_rows(picks), q[picks].T, atol=1e-13)
    found = {r["term_id"]: r["products"] for r in matrix.row_by_anchor(picks).collect()}
    np.testing.assert_allclose([found[i] for i in range(planted.terms)], q @ q[picks].T, atol=1e-13)


@pytest.mark.parametrize("ahead", [1, 3, 32])
def test_anchors_without_the_matrix(spark, space, built, planted, ahead):
    sums = gram_row_sums(built.rows)
    norms = normalised_norms(gram_profile(built.rows, planted.terms))
    found = anchors.find_corpus_anchors(space, NormalisedGram(built.rows, sums, planted.terms), norms, 8, ahead)
    q = gram_of(planted.counts)
    q /= q.sum(axis=1, keepdims=True)
    assert found.picks == deflated_picks(q, 8)
    got = {r["term_id"]: r["products"] for r in found.products.collect()}
    np.testing.assert_allclose([got[i] for i in range(planted.terms)], q @ q[found.picks].T, atol=1e-13)


def test_gram_row_sums_need_no_gram(built, planted):
    wanted = gram_of(planted.counts).sum(axis=1)
    found = np.zeros(planted.terms)
    for r in gram_row_sums(built.rows).collect():
        found[r["term_id"]] = r["s"]
    np.testing.assert_allclose(found, wanted, atol=1e-12)


def test_hot_document_and_hot_term(spark, space):
    """One document holds a third of all tokens, one term is in every document."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, (200, 60))
    counts[:, 0] = 5
    counts[17] = rng.integers(100, 300, 60)
    d, w = np.nonzero(counts)
    rows = [(int(a), int(b), float(counts[a, b])) for a, b in zip(d, w)]
    triplets = spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE")
    built = store_corpus(space, triplets, spark.range(200).toDF("doc_id"), 60, partitions=4)
    np.testing.assert_allclose(matrix_of(gram(built.rows, 60), 60), gram_of(counts), atol=1e-12)
    sums = {r["term_id"]: (r["s"], r["total"]) for r in term_sums(built.rows).collect()}
    np.testing.assert_allclose([sums[t][0] for t in range(60)], gram_of(counts).sum(axis=1), atol=1e-12)
    np.testing.assert_allclose([sums[t][1] for t in range(60)], counts.sum(axis=0))


def test_short_documents_add_nothing(spark, space):
    rows = [(0, 0, 1.0), (1, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]
    triplets = spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE")
    built = store_corpus(space, triplets, spark.range(3).toDF("doc_id"), 3, partitions=2)
    cells = {(r["i"], r["j"]): r["q"] for r in gram(built.rows, 3).collect()}
    assert cells == {(0, 1): 0.5, (1, 0): 0.5}
    assert {r["term_id"] for r in gram_row_sums(built.rows).collect()} == {0, 1}


def deflated_picks(q: np.ndarray, topics: int) -> list[int]:
    """Anchor search that changes the matrix itself."""
    rest, picks = q.copy(), []
    for _ in range(topics):
        norms = np.square(rest).sum(axis=1)
        norms[picks] = 0.0
        picks.append(int(norms.argmax()))
        direction = rest[picks[-1]] / np.linalg.norm(rest[picks[-1]])
        others = np.setdiff1d(np.arange(len(q)), picks)
        rest[others] -= np.outer(rest[others] @ direction, direction)
    return picks


def frame_of(spark, q: np.ndarray):
    i, j = np.nonzero(q)
    return spark.createDataFrame(
        [(int(a), int(b), float(q[a, b])) for a, b in zip(i, j)], "i INT, j INT, q DOUBLE"
    )


def test_anchors_equal_deflation(spark, space):
    rng = np.random.default_rng(3)
    q = rng.dirichlet(np.full(40, 0.2), 40) * (rng.random((40, 40)) < 0.6)
    found = anchors.find_anchors(space, frame_of(spark, q), 12, 40)
    assert found.picks == deflated_picks(q, 12)
    got = {r["term_id"]: r["products"] for r in found.products.collect()}
    np.testing.assert_allclose([got[i] for i in range(40)], q @ q[found.picks].T, atol=1e-13)
    same = recover.row_by_anchor(frame_of(spark, q), found.picks, 40)
    np.testing.assert_allclose(
        [r["products"] for r in same.orderBy("term_id").collect()], q @ q[found.picks].T, atol=1e-13
    )
    assert [tuple(r) for r in found.table().orderBy("rank").collect()] == list(enumerate(found.picks, 1))


def test_equal_rows_tie_to_the_smallest_index(spark):
    norms = spark.createDataFrame([(4, 0.3), (2, 0.1 + 0.2), (7, 0.1)], "i INT, r DOUBLE")
    assert anchors.argmax_row(norms).first()["i"] == 2


def test_too_few_independent_rows(spark, space):
    q = np.array([[1.0, 0, 0], [0, 1.0, 0], [0.5, 0.5, 0]])
    with pytest.raises(ValueError, match="independent"):
        anchors.find_anchors(space, frame_of(spark, q), 3, 3)


def best_mixture(target: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares on the simplex by trying every set of non-zero weights."""
    size, best, best_error = len(target), None, np.inf
    for count in range(1, size + 1):
        for used in map(list, itertools.combinations(range(size), count)):
            system = np.block([[cross[np.ix_(used, used)], np.ones((count, 1))], [np.ones((1, count)), np.zeros((1, 1))]])
            solution = np.linalg.solve(system, np.append(target[used], 1.0))[:-1]
            if (solution >= -1e-12).all():
                weights = np.zeros(size)
                weights[used] = solution
                error = 0.5 * weights @ cross @ weights - weights @ target
                if error < best_error:
                    best, best_error = weights, error
    return best


def test_weights_approach_the_best_mixture():
    rng = np.random.default_rng(5)
    rows = rng.dirichlet(np.full(30, 0.1), 4)
    mixtures = rng.dirichlet(np.ones(4), 50)
    points = mixtures @ rows + rng.normal(0, 0.002, (50, 30))
    cross = rows @ rows.T
    found = recover._simplex(points @ rows.T, cross)
    assert cross.max() > 0.1  # long rows: the plain step would overshoot
    wanted = np.array([best_mixture(t, cross) for t in points @ rows.T])
    np.testing.assert_allclose(found, wanted, atol=5e-3)


def plain_updates(target: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The fixed step for one term, without safeguard."""
    weights, before = np.full(len(target), 1 / len(target)), np.inf
    for _ in range(499):
        slope = target - weights @ cross
        size = np.sqrt(slope @ slope)
        weights = weights * np.exp(200 * (slope - slope.max()))
        weights /= weights.sum()
        if abs(before - size) < 1e-27:
            break
        before = size
    return weights


def test_weights_equal_the_fixed_step_where_it_does_not_overshoot():
    rng = np.random.default_rng(6)
    rows = rng.dirichlet(np.full(400, 1.0), 4)
    points = rng.dirichlet(np.ones(4), 50) @ rows
    cross = rows @ rows.T
    assert cross.max() < 0.01
    found = recover._simplex(points @ rows.T, cross)
    np.testing.assert_allclose(found, [plain_updates(t, cross) for t in points @ rows.T], atol=1e-10)


def test_dropped_terms_get_the_smallest_probability(spark):
    topics = spark.createDataFrame([(0, [0.25, 1.0]), (2, [0.75, 0.0])], "term_id INT, b ARRAY<DOUBLE>")
    vocab = spark.range(4).select(F.col("id").cast("int").alias("term_id"))
    full = {r["term_id"]: r["b"] for r in recover.refill(topics, vocab, 2, 4).collect()}
    assert full[0] == [0.25, 1.0] and full[2] == [0.75, 0.0]
    assert full[1] == [SMALLEST_DOUBLE] * 2 and full[3] == [SMALLEST_DOUBLE] * 2


def aligned(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Total distance of each wanted topic to its nearest found one."""
    return np.abs(found[:, None, :] - wanted[None, :, :]).sum(axis=2).min(axis=0)


def test_start_recovers_planted_topics(spark, space, built, planted):
    start = initialise(space, built, planted.topics)
    beta = start.topics.array()[0].T
    np.testing.assert_allclose(beta.sum(axis=1), 1.0)
    assert (aligned(beta, planted.beta) < 0.6).all()
    own = planted.terms // 20
    assert sorted(a // own for a in start.anchors.picks) == list(range(planted.topics))


def test_start_keeps_term_ids_when_terms_drop_out(spark, space):
    # Term 1 occurs only in a document of one token; the others keep their ids.
    rows = [(0, 1, 1.0)]
    for d in range(1, 13):
        base = 0 if d % 2 else 3
        rows += [(d, base, 3.0), (d, base + 2, 2.0), (d, 4 if d % 3 else 6, 1.0)]
    triplets = spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE").groupBy("doc_id", "term_id").agg(F.sum("cnt").alias("cnt"))
    built = store_corpus(space, triplets, spark.range(13).toDF("doc_id"), 7, partitions=2)
    start = initialise(space, built, 2)
    beta = start.topics.array()[0]
    assert 1 not in start.anchors.picks
    assert (beta[1] == SMALLEST_DOUBLE).all()
    np.testing.assert_allclose(beta.sum(axis=0), 1.0)
    counts = np.zeros((13, 7))
    for d, w, c in rows:
        counts[d, w] += c
    q = gram_of(counts)
    kept = [t for t in range(7) if t != 1]
    q = q[np.ix_(kept, kept)]
    q /= q.sum(axis=1, keepdims=True)
    assert start.anchors.picks == [kept[i] for i in deflated_picks(q, 2)]


@pytest.mark.parametrize("entries, stripe", [(1 << 22, 1 << 20), (5000, 300), (900, 1 << 20)])
def test_an_entry_is_sent_once_per_block(spark, space, entries, stripe):
    """Not once for every other term of its document; counts are whole, large or parts of one."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.4, (90, 300)) * np.where(rng.random((90, 1)) < 0.2, 700.0, 1.0)
    counts[80:] *= 2.5
    rows = [(int(d), int(t), float(counts[d, t])) for d, t in zip(*np.nonzero(counts))]
    built = store_corpus(
        space, spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE"), spark.range(90).withColumnRenamed("id", "doc_id"), 300
    )
    dealt, blocks = _tiles(built.rows, 3, entries)
    sent = dealt.agg(F.sum(F.octet_length("left_ids") + F.octet_length("right_ids")) / 4).first()[0]
    assert blocks == max(2, -(-len(rows) // entries)) and sent == blocks * len(rows)
    wanted = gram_of(counts)
    found = {r["i"]: r for r in gram_profile(built.rows, 300, stripe, 1, 0, entries).collect()}
    assert set(found) == set(np.flatnonzero(wanted.any(axis=1)))
    np.testing.assert_array_equal([found[i]["cells"] for i in sorted(found)], (wanted != 0).sum(axis=1)[sorted(found)])
    np.testing.assert_allclose([found[i]["r"] for i in sorted(found)], np.square(wanted).sum(axis=1)[sorted(found)], rtol=1e-10)
    np.testing.assert_allclose(matrix_of(gram(built.rows, 300, dense_cells=0), 300), wanted, atol=1e-12)


def test_dealt_entries_compress_well(spark):
    """Documents of 300 of 100,000 terms, most of them frequent ones."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(2000):
        ids = np.unique((100_000 * rng.random(300) ** 4).astype(int)).tolist()
        counts = np.minimum(rng.geometric(0.7, len(ids)), 200).astype(float).tolist()
        rows.append((sum(counts), ids, counts))
    corpus = spark.createDataFrame(rows, "n DOUBLE, term_ids ARRAY<INT>, counts ARRAY<DOUBLE>").coalesce(1)
    dealt, blocks = _tiles(corpus, tasks=6)
    sent = sum(len(pa.compress(b"".join(bytes(v) for v in row[1:]), "lz4", asbytes=True)) for row in dealt.collect())
    copies = blocks * sum(len(ids) for _, ids, _ in rows)
    assert sent < 3.0 * copies


def test_steps_come_back():
    for values in (np.empty(0, np.int32), np.random.default_rng(5).integers(-(1 << 31), 1 << 31, 1000).astype(np.int32)):
        np.testing.assert_array_equal(_joined_planes(_planes(values)), values)


def test_tiles_take_entries_in_any_order(spark):
    """Ids that fall within a document, and counts that are not whole."""
    corpus = spark.createDataFrame(
        [(4.5, [7, 2, 5], [1.5, 2.0, 1.0]), (3.0, [5, 0], [1.0, 2.0]), (1.0, [3], [1.0])], "n DOUBLE, term_ids ARRAY<INT>, counts ARRAY<DOUBLE>"
    )
    wanted = {r["i"]: r for r in gram_profile(corpus, 8).collect()}
    found = {r["i"]: r for r in gram_profile(corpus, 8, dense_cells=0).collect()}
    assert found.keys() == wanted.keys()
    for i, row in wanted.items():
        assert found[i]["cells"] == row["cells"]
        np.testing.assert_allclose([found[i]["s"], found[i]["r"]], [row["s"], row["r"]], atol=1e-14)


@pytest.mark.parametrize("most", [1 << 21, 400, 60])
def test_a_tile_is_added_up_by_finer_blocks(spark, space, most):
    """Whatever is unpacked at once: sums and cells agree, and a task sends the sums of a term once."""
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.3, (70, 200)) * np.where(rng.random((70, 1)) < 0.2, 900.0, 1.0)
    rows = [(int(d), int(t), float(counts[d, t])) for d, t in zip(*np.nonzero(counts))]
    built = store_corpus(
        space, spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE"), spark.range(70).withColumnRenamed("id", "doc_id"), 200
    )
    dealt, blocks = _tiles(built.rows, 6)
    assert blocks == 3
    partial = dealt.mapInArrow(_each_tile(blocks, 500, 50, _Profile, most), "i INT, cells BIGINT, s DOUBLE, r DOUBLE")
    wanted = gram_of(counts)
    found = {}
    for row in partial.collect():
        found.setdefault(row["i"], []).append(row[1:])
    assert set(found) == set(np.flatnonzero(wanted.any(axis=1))) and max(map(len, found.values())) == blocks
    total = np.array([np.sum(found[i], axis=0) for i in sorted(found)])
    some = sorted(found)
    np.testing.assert_array_equal(total[:, 0], (wanted != 0).sum(axis=1)[some])
    np.testing.assert_allclose(total[:, 1:], np.column_stack([wanted.sum(axis=1), np.square(wanted).sum(axis=1)])[some], rtol=1e-10)
    upper = dealt.mapInArrow(_each_tile(blocks, 500, 50, _UpperCells, most), "i INT, j INT, q DOUBLE")
    np.testing.assert_allclose(matrix_of(upper, 200), np.triu(wanted), atol=1e-12)


def test_entries_of_small_clusters_are_sent_few_times(spark):
    """16 M entries on 6 cores: 3 blocks, so entries and the sums of terms are sent 3 times, not 8."""
    assert TILE_ENTRIES >= 16_000_000 / 3 and SIDE_ENTRIES < TILE_ENTRIES
