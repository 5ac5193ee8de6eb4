from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from themeloom.operators import corpus


def test_neighbouring_entries_travel_together(spark, monkeypatch):
    """Documents in runs, in pieces, without terms, without entries, not named, repeated and without a name."""
    rng = np.random.default_rng(4)
    rows = [(d, int(t), float(c)) for d in range(40) for t, c in zip(rng.permutation(90)[:30], rng.integers(1, 9, 30))]
    rows += [(int(d), int(t), 0.5) for d, t in rng.integers(0, 40, (300, 2))]
    rows += [(None, 3, 2.0), (None, 1, 1.0), (50, None, 4.0), (0, None, 1.0), (60, 7, 1.5), (None, 3, 1.0)]
    triplets = spark.createDataFrame(rows, "doc_id BIGINT, term_id INT, cnt DOUBLE").repartition(3)
    named = [(d, None if d == 7 else (d or 0) % 3, [1.0, float(d or 0)]) for d in [*range(45), None, 12]]
    documents = spark.createDataFrame(named, "doc_id BIGINT, aspect INT, x ARRAY<DOUBLE>")
    entry = F.when(F.col("term_id").isNotNull(), F.struct("term_id", "cnt"))
    together = triplets.unionByName(documents, allowMissingColumns=True)
    added = together.groupBy("doc_id", "term_id").agg(F.sum("cnt").alias("cnt"))
    wanted = {r["doc_id"]: [tuple(e) for e in r["e"]] for r in added.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e")).collect()}
    aspects = {d: (a or 0, x) for d, a, x in named}
    for size in (1 << 11, 7):
        monkeypatch.setattr(corpus, "ADDED_ROWS", size)
        found = corpus.corpus_rows(triplets, documents, 5).collect()
        assert len(found) == len(wanted) == 48
        for r in found:
            assert list(zip(r["term_ids"], r["counts"])) == wanted[r["doc_id"]]
            assert r["n"] == sum(r["counts"]) and (r["aspect"], r["x"]) == aspects.get(r["doc_id"], (0, None))


def test_a_run_is_one_row(spark):
    triplets = spark.range(6000).select((F.col("id") / 300).cast("bigint").alias("doc_id"), (F.col("id") % 300).cast("int").alias("term_id"), F.lit(1.0).alias("cnt"))
    documents = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(0).alias("aspect"), F.array(F.lit(1.0)).alias("x"))
    rows = corpus.corpus_rows(triplets.coalesce(1), documents, 2)
    assert rows.where(F.size("term_ids") == 300).count() == 20
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()  # entries are not sorted one by one
    sent = triplets.coalesce(1).mapInArrow(corpus._runs, "doc_id BIGINT, part STRUCT<term_ids: ARRAY<INT>, counts: ARRAY<DOUBLE>>")
    assert sent.count() <= 20 + 6000 // 500  # batches of 500 rows at least
