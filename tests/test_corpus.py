from __future__ import annotations

import collections
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom import FitParams, Workspace, build_corpus, design, store_corpus
from themeloom.lookup import lookup_join
from themeloom.operators import corpus
from themeloom.workspace import shared_folder


def test_split_words_like_a_line_split(spark):
    lines = ["a b", " a", "a  b", "a b   ", "", "   ", "a\tb c"]
    wanted = [["a", "b"], ["", "a"], ["a", "", "b"], ["a", "b"], [""], [], ["a\tb", "c"]]
    frame = spark.createDataFrame(list(enumerate(lines)), "n INT, value STRING")
    got = collections.defaultdict(list)
    for row in corpus.split_words(frame, keep=("n",)).collect():
        got[row["n"]].append(row["word"])
    assert [got[n] for n in range(len(lines))] == wanted
    counts = {r["word"]: r["cnt"] for r in corpus.word_counts(corpus.split_words(frame)).collect()}
    assert counts == collections.Counter(w for words in wanted for w in words)


def test_doc_terms_count_whole_texts(spark):
    texts = ["One two two", "", "Éa éA 1x", None, " ".join(["z"] * 5000) + " end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["term"]): r["cnt"] for r in corpus.doc_terms(frame).collect()}
    wanted = collections.Counter(
        (i, w) for i, t in enumerate(texts) if t for w in re.findall(r"[^\W\d_]+", t.lower())
    )
    assert got == wanted


def test_vocabulary_share_and_order(spark, space):
    rows = [(d, t, 1 + d) for d in range(10) for t in ("all", "b", "a") if t == "all" or d < 5]
    rows += [(0, "rare", 9)]
    terms = spark.createDataFrame(rows, "doc_id BIGINT, term STRING, cnt BIGINT")
    kept = corpus.vocabulary(space, terms, 10, 0.5)
    found = [(r["term_id"], r["term"], r["df"], r["total"]) for r in kept.table.orderBy("term_id").collect()]
    assert found == [(0, "all", 10, 55), (1, "a", 5, 15), (2, "b", 5, 15)]
    assert kept.terms == 3
    assert corpus.vocabulary(space, terms, 10, 0.0, "full").terms == 4


def test_ranks_are_dense_over_many_partitions(spark, space):
    values = np.random.default_rng(1).permutation(5000)
    frame = spark.createDataFrame([(int(v),) for v in values], "v INT").repartition(13)
    ranked = corpus.with_ranks(space, frame, [F.desc("v")], "rank", "ranks").collect()
    assert all(r["rank"] == 4999 - r["v"] for r in ranked)


def test_lookup_beyond_the_limit_equals_broadcast(spark):
    big = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") * F.col("id") % 7).alias("k"))
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        near = lookup_join(big, lookup, "k", 100, "doc_id", how)
        far = lookup_join(big, lookup, "k", 100, "doc_id", how, limit=10)
        assert sorted(near.collect(), key=str) == sorted(far.select(near.columns).collect(), key=str)
        plan = far._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plan


def test_index_sets_and_probability(spark):
    totals = spark.createDataFrame([(0, 3.0), (1, 0.0), (2, 1.0)], "term_id INT, total DOUBLE")
    prob = {r["term_id"]: r["prob"] for r in corpus.word_probability(totals).collect()}
    assert prob == {0: 0.75, 1: 0.0, 2: 0.25}
    dropped = totals.where("total = 0")
    assert [r[0] for r in corpus.index_difference(totals, dropped, "term_id").orderBy("term_id").collect()] == [0, 2]
    cells = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (0, 2, 5.0)], "i INT, j INT, q DOUBLE")
    assert [tuple(r) for r in corpus.drop_terms(cells, dropped, "i", "j").select("i", "j", "q").collect()] == [(0, 2, 5.0)]
    assert corpus.at_least(totals, "total", 1).count() == 2


def test_documents_without_terms_keep_a_row(spark, space):
    texts = [(5, "a b"), (9, "only strange words"), (70, ""), (71, "a a")]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    built = build_corpus(space, docs, 0.5, partitions=3)
    rows = {r["doc_id"]: r for r in built.rows.collect()}
    assert set(rows) == {5, 9, 70, 71}
    assert (rows[9]["n"], rows[9]["term_ids"], rows[9]["x"], rows[9]["aspect"]) == (0.0, [], [1.0], 0)
    assert (rows[71]["n"], rows[71]["counts"]) == (2.0, [2.0])
    assert (built.documents, built.terms, built.covariates) == (4, 1, 1)


def test_corpus_entries_invert_corpus_rows(spark, space, planted):
    built = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, partitions=4)
    back = sorted(tuple(r) for r in corpus.corpus_entries(built.rows).collect())
    assert back == sorted(planted.triplet_rows())


def test_repeated_triplets_add_up_and_documents_need_covariates(spark, space):
    rows = [(1, 4, 1.0), (1, 4, 2.0), (1, 2, 1.0), (2, 0, 1.0)]
    triplets = spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id BIGINT")
    found = {r["doc_id"]: r for r in store_corpus(space, triplets, docs, 5, partitions=2).rows.collect()}
    assert (found[1]["term_ids"], found[1]["counts"], found[1]["n"]) == ([2, 4], [1.0, 3.0], 4.0)
    some = spark.createDataFrame([(1, [1.0])], "doc_id BIGINT, x ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="1 documents have no covariates"):
        store_corpus(space, triplets, docs, 5, some, partitions=2)
    with pytest.raises(ValueError, match="not named"):
        store_corpus(space, triplets, docs.where("doc_id = 1"), 5, partitions=2)


def test_corpus_rows_take_one_shuffle(spark, planted):
    described = planted.covariates(spark).withColumn("aspect", F.lit(0))
    rows = corpus.corpus_rows(planted.triplets(spark), described, 4)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_corpus_join_by_document_needs_no_shuffle(spark, space, planted):
    a = store_corpus(space, planted.triplets(spark), planted.docs(spark), planted.terms, partitions=4)
    other = space.bucketed(planted.covariates(spark), "other", "doc_id", 4)
    joined = a.rows.drop("x").join(other.hint("shuffle_hash"), "doc_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_design(spark):
    rows = [(0, "a", 1.0), (1, "b", 3.0), (2, None, None), (3, "c", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, g STRING, v DOUBLE")
    found = design(docs, ["g"], {"v": F.col("v")})
    assert found.names == ["intercept", "g=a", "g=b", "v"]
    x = {r["doc_id"]: r["x"] for r in found.table.collect()}
    scale = np.std([1, 3, 5])
    np.testing.assert_allclose(x[0], [1, 1, 0, -2 / scale])
    np.testing.assert_allclose(x[2], [1, 0, 0, 0])
    np.testing.assert_allclose(x[3], [1, 0, 0, 2 / scale])


def test_bad_settings_are_refused(spark, space, planted):
    for bad in (dict(topics=1), dict(topics=3, aspects=0), dict(topics=3, max_iterations=0), dict(topics=3, sigma_shrink=2.0)):
        with pytest.raises(ValueError):
            FitParams(**bad)
    with pytest.raises(ValueError, match="vocabulary"):
        corpus.check_dimensions(5, 5)
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "doc_id BIGINT, x ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="same length"):
        store_corpus(space, planted.triplets(spark).where("doc_id < 2"), uneven.select("doc_id"), planted.terms, uneven)


def session(named=None, context_folder=None, master="local[2]"):
    """What ``shared_folder`` asks of a session."""
    context = SimpleNamespace(getCheckpointDir=lambda: context_folder, master=master, applicationId="app")
    return SimpleNamespace(conf={"spark.checkpoint.dir": named} if named else {}, sparkContext=context)


def test_shared_folder_comes_from_the_session():
    assert shared_folder(session("hdfs://n/ck/", "hdfs://n/other")) == "hdfs://n/ck"
    assert shared_folder(session(None, "hdfs://n/other", "yarn")) == "hdfs://n/other"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(master="spark://host:7077"))
    assert shared_folder(session()) == shared_folder(session())


def test_workspace_removes_what_it_wrote(spark, tmp_path):
    run = Workspace(spark, str(tmp_path))
    run.table(spark.range(3), "a")
    run.bucketed(spark.range(3), "b", "id", 2)
    run.drop("b")
    assert (tmp_path / run.run / "a").exists() and not (tmp_path / run.run / "b").exists()
    run.bucketed(spark.range(3), "c", "id", 2)
    run.close()
    assert not (tmp_path / run.run).exists()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(run.run)]


def test_tokens_are_counted_in_parts():
    """However many rows a batch has; rows with one id stay together, as do null ids."""
    ids = [3, 1, None, 2, 3, None, 4]
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(ids, pa.int64()), "tokens": pa.array([["a"] * (corpus.PART_TOKENS // 2)] * 6 + [[]], pa.list_(pa.string()))}
    )
    parts = [p.column("doc_id").to_pylist() for p in corpus._parts(batch)]
    assert parts == [[1, 2], [3, 3, 4], [None, None]]
    assert not list(corpus._parts(batch.slice(0, 0)))
    unique = batch.slice(1, 3)
    assert [p.num_rows for p in corpus._parts(unique)] == [2, 1]


def test_frequent_terms_are_not_shuffled(spark, space):
    rows = [(d, f"w{t:03d}", 1) for t in range(60) for d in range(60 - t)]
    terms = spark.createDataFrame(rows, "doc_id BIGINT, term STRING, cnt BIGINT")
    vocab = corpus.vocabulary(space, terms, 60, 0.0)
    near, far = corpus.document_term(terms, vocab), corpus.document_term(terms, vocab, limit=vocab.bytes // 2)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))
    plan = far._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "_salt" not in plan and plan.count("SortMergeJoin") >= 1


def test_cells_stay_where_they_are_when_terms_are_dropped(spark):
    cells = spark.range(1000).select((F.col("id") % 10).alias("i"), (F.col("id") % 7).alias("j"), F.lit(1.0).alias("q"))
    dropped = spark.range(3).select(F.col("id").alias("term_id")).distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, sent = corpus.drop_terms(cells, dropped, "i", "j"), corpus.drop_terms(cells, dropped, "i", "j", terms=3)
        assert sorted(map(tuple, sent.select("i", "j", "q").collect())) == sorted(map(tuple, plain.select("i", "j", "q").collect()))
        assert "SortMergeJoin" not in sent._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
