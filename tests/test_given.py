"""Inputs of the registered queries: what is stored and shuffled for them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from themeloom import lookup
from themeloom.checks import queries
from themeloom.checks.given import Given
from themeloom.lookup import lookup_join
from themeloom.operators.estep import TOPIC_BYTES, _blocks

TEXTS = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chat noir"), ("es", "el gato y el perro"), ("en", "a dog")]


@pytest.fixture
def inputs(spark, tmp_path):
    rows = [(i, lang, len(text), text) for i, (lang, text) in enumerate(TEXTS * 4)] + [(99, "en", 0, None)]
    spark.createDataFrame(rows, "doc_id BIGINT, lang STRING, n_chars BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 20, 3)], "doc_id BIGINT, quality INT").write.parquet(f"{tmp_path}/labels.parquet")
    return Given(spark, str(tmp_path))


def test_counts_of_every_entry_are_not_stored(inputs):
    kinds = {r["kind"] for r in inputs.inferred3.select("kind").distinct().collect()}
    assert kinds == {"doc", "nu", "doc_nu", "phi", "weight"}
    # Texts are split once: neither their counts nor the triplets lie beside the corpus.
    stored = os.listdir(inputs.space.folder.removeprefix("file://").removeprefix("file:"))
    assert "terms" not in stored and "triplets" not in stored


def test_topics_of_groups_are_shares_of_their_tokens(inputs):
    found = {r["term_id"]: r["b"] for r in inputs.topics4.table.collect()}
    names = {r["term"]: r["term_id"] for r in inputs.vocab.collect()}
    terms = len(names)
    # English: 4 x (5 + 2) tokens, "dog" in 8 of them and "the" in 8.
    assert found[names["dog"]][1] == pytest.approx((8 + 0.01) / (28 + 0.01 * terms))
    assert found[names["the"]][1] == pytest.approx((8 + 0.01) / (28 + 0.01 * terms))
    assert found[names["dog"]][0] == pytest.approx(0.01 / (20 + 0.01 * terms))
    assert [sum(b[k] for b in found.values()) for k in range(4)] == pytest.approx([1.0] * 4)


def test_entries_are_not_shuffled_for_expected_counts(inputs):
    found = queries._phi4(inputs)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    # The corpus is read by its buckets, and what is dealt by document comes from the small tables alone.
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(doc_id" in line]
    assert len(dealt) == 2 and not any("term_ids" in line for k in dealt for line in plan[k : k + 4])
    assert sum("Bucketed: true" in line for line in plan) == 1
    tokens = inputs.triplets_with(inputs.aspects).groupBy("aspect").agg(F.sum("cnt")).collect()
    sums = found.groupBy("aspect").agg(F.sum(F.aggregate("phi", F.lit(0.0), lambda a, v: a + v))).collect()
    assert dict(map(tuple, sums)) == pytest.approx(dict(map(tuple, tokens)))


def test_lookups_are_repeated_only_where_that_spreads_a_key(spark):
    big = spark.range(40).select((F.col("id") % 7).alias("k"), F.col("id").alias("d"))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for spread, repeated in (("k", False), ("d", True)):
        joined = lookup_join(big, small, "k", 1 << 20, spread, "left", limit=0)
        assert ("Generate" in joined._jdf.queryExecution().executedPlan().toString()) is repeated
        assert sorted(map(tuple, joined.fillna(-1).collect())) == sorted((d % 7, d, 2 * (d % 7) if d % 7 < 5 else -1) for d in range(40))


def test_topics_of_blocks_are_shuffled_once(inputs, monkeypatch):
    """Topics beyond what is broadcast reach the blocks by one join, without copies."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    _, dictionary = _blocks(inputs.corpus.rows, inputs.topics3, 400)
    assert "_salt" not in dictionary._jdf.queryExecution().optimizedPlan().toString()
    found = dictionary.groupBy("block").agg(F.count("b").alias("n")).collect()
    assert len(found) > 1 and all(r["n"] <= inputs.corpus.terms for r in found)


def test_topics_sent_by_the_driver_are_bounded():
    """Two iterations, a broadcast and what else is collected stay well below a thousand MB."""
    assert TOPIC_BYTES <= 64 << 20
