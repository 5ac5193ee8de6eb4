from __future__ import annotations

import os

import numpy as np
import pytest
from helpers import gram_of, matrix_of
from pyspark.sql import functions as F

from themeloom.checks.given import Given
from themeloom.operators.gram import _each_tile, _Part, _Profile, _tiles, _Unit, gram, gram_profile


def sparse_corpus(spark, documents=80, terms=240, seed=8, scale=1.0):
    """Terms from frequent to rare, some of one document."""
    rng = np.random.default_rng(seed)
    share = 0.6 / (1.0 + np.arange(terms) / 4.0)
    counts = (rng.random((documents, terms)) < share) * rng.integers(1, 5, (documents, terms)) * scale
    counts[:, -20:] = 0.0
    counts[rng.integers(0, documents, 20), np.arange(terms - 20, terms)] = rng.integers(1, 4, 20) * scale
    rows = [(float(c.sum()), np.flatnonzero(c).tolist(), c[c > 0].tolist()) for c in counts]
    return spark.createDataFrame(rows, "n DOUBLE, term_ids ARRAY<INT>, counts ARRAY<DOUBLE>"), counts


def profile_rows(matrix):
    return np.column_stack([(matrix != 0).sum(axis=1), matrix.sum(axis=1), np.square(matrix).sum(axis=1)])


def test_entries_are_shuffled_once(spark):
    """However many tiles read them."""
    corpus, counts = sparse_corpus(spark)
    dealt, blocks = _tiles(corpus, 6, 150)
    assert blocks > 5 and dealt.select("tile").distinct().count() == blocks * (blocks + 1) // 2
    dealt.collect()
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" in plan and plan.count("ReusedExchange") == 1 and plan.count(" Exchange shufflepartitionid") == 2
    assert plan.count("ShuffleQueryStage") == 2


@pytest.mark.parametrize("scale", [1.0, 0.5, 300.0])
@pytest.mark.parametrize("stripe, hot, entries", [(1 << 18, 1, 1 << 23), (200, 1, 400), (50, 1 << 30, 200)])
def test_profile_of_frequent_and_rare_terms(spark, scale, stripe, hot, entries):
    corpus, counts = sparse_corpus(spark, scale=scale)
    wanted = gram_of(counts)
    found = {r["i"]: r for r in gram_profile(corpus, counts.shape[1], stripe, hot, 0, entries).collect()}
    some = sorted(found)
    assert some == np.flatnonzero(wanted.any(axis=1)).tolist()
    rows = np.array([[found[i]["cells"], found[i]["s"], found[i]["r"]] for i in some])
    np.testing.assert_allclose(rows, profile_rows(wanted)[some], rtol=1e-10)


def test_rows_of_single_documents_are_sent_once(spark):
    """Not once per block: the document has the whole row."""
    corpus, counts = sparse_corpus(spark)
    dealt, blocks = _tiles(corpus, 6, 120)
    sent = dealt.mapInArrow(_each_tile(blocks, 500, 1, _Profile), "i INT, cells BIGINT, s DOUBLE, r DOUBLE").collect()
    held = (counts > 0).sum(axis=0)
    times = np.bincount([r["i"] for r in sent], minlength=counts.shape[1])
    assert blocks > 5 and (times[held == 1] == 1).all() and times[held > 30].min() == blocks
    wanted = profile_rows(gram_of(counts))
    for r in sent:
        if held[r["i"]] == 1:
            np.testing.assert_allclose(r[1:], wanted[r["i"]], rtol=1e-12)


def test_units_are_neighbours_with_few_entries():
    rng = np.random.default_rng(9)
    sizes = rng.integers(0, 30, 50).astype(np.int32)
    ids = np.concatenate([np.sort(rng.choice(100, n, False)) for n in sizes]).astype(np.int32)
    parts = [_Part(sizes[:20], ids[: sizes[:20].sum()], np.ones(sizes[:20].sum())), _Part(sizes[20:], ids[sizes[:20].sum() :], np.ones(sizes[20:].sum()))]
    units, single = _Unit.split(3, parts, 100)
    assert not len(single.ids) and not parts and len(units) > 7
    assert sum(len(u.ids) for u in units) == len(ids) and max(len(u.ids) for u in units) <= 100
    doc = np.repeat(np.arange(50), sizes)
    for u in units:
        ours = (ids >= u.first) & (ids < u.first + u.places)
        np.testing.assert_array_equal(u.ids + u.first, ids[ours])
        np.testing.assert_array_equal(u.sizes, np.bincount(doc[ours], minlength=50))


@pytest.mark.parametrize("dense", [0, 1 << 24])
def test_dropped_cells_do_not_leave_their_task(spark, dense):
    corpus, counts = sparse_corpus(spark, 60, 90)
    dropped = spark.createDataFrame([(t,) for t in range(0, 90, 4)], "term_id INT")
    cells = gram(corpus, 90, dense_cells=dense, dropped=dropped)
    wanted = gram_of(counts)
    wanted[::4] = wanted[:, ::4] = 0.0
    assert cells.count() == np.count_nonzero(wanted)
    np.testing.assert_allclose(matrix_of(cells, 90), wanted, atol=1e-13)


def test_foreign_sums_of_a_built_corpus(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    built, plain = Given(spark, folder), Given(spark, folder)
    assert built.corpus.terms and "terms" not in built.__dict__
    tables = [g.foreign_sums.join(g.words.table, "term_id").select("term", F.round("s", 9).alias("s")) for g in (built, plain)]
    assert "terms" not in built.__dict__  # texts are not split again
    assert tables[0].count() == tables[1].count() and not tables[0].exceptAll(tables[1]).count()


def test_small_batches_are_dealt_together(spark, monkeypatch):
    """The session's batches do not set the number of chunks, which tiles compare with each other."""
    from themeloom.operators import gram as module

    corpus, counts = sparse_corpus(spark, 70, 100)
    batches = corpus.coalesce(1).toArrow().to_batches(max_chunksize=5)
    assert [b.num_rows for b in module._gathered(iter(batches))] == [70]
    monkeypatch.setattr(module, "CHUNK_ROWS", 30)
    parts = list(module._gathered(iter(batches)))
    assert [b.num_rows for b in parts] == [30, 30, 10]
    assert [n for b in parts for n in b.column("n").to_pylist()] == counts.sum(axis=1).tolist()
    monkeypatch.setattr(module, "CHUNK_ENTRIES", 1)
    assert len(list(module._gathered(iter(batches)))) == 14
