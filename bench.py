"""Times the headline queries on the tables of $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import SparkSession, functions as F  # noqa: E402

from themeloom import FitParams, Workspace, build_corpus, design, fit_corpus, initialise, score_corpus, store_corpus  # noqa: E402
from themeloom.operators import corpus  # noqa: E402
from themeloom.operators.anchors import find_corpus_anchors  # noqa: E402
from themeloom.operators.estep import Prior, infer  # noqa: E402
from themeloom.operators.gram import gram, gram_profile, gram_row_sums, normalised_gram, normalised_norms  # noqa: E402
from themeloom.operators.products import NormalisedGram  # noqa: E402
from themeloom.operators.recover import initial_covariance, recover_topics, simplex_weights  # noqa: E402
from themeloom.plans.em import with_logits  # noqa: E402

TOPICS = 10
ITERATIONS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("themeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    space = Workspace(spark)
    seconds: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    # The file is one row group, so one task reads it all: spread its rows over the cores.
    texts = documents.select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    run(documents.limit(1))  # start the session's threads outside of the first query
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    timed("word_count", lambda: run(corpus.word_counts(corpus.split_words(lines, "line"))))
    timed("doc_terms", lambda: run(corpus.doc_terms(texts)))
    covariates = timed("design", lambda: design(documents, ["lang"], {"length": F.log1p("n_chars")})).table
    params = FitParams(TOPICS, min_doc_share=0.02, max_iterations=ITERATIONS, threshold=-1.0)
    built = timed("build_corpus", lambda: build_corpus(space, texts, params.min_doc_share, covariates))
    timed("term_totals", lambda: run(corpus.term_totals(corpus.corpus_entries(built.rows))))
    sums = timed("gram_row_sums", lambda: space.table(gram_row_sums(built.rows), "bench_sums"))
    cells = timed("gram", lambda: space.table(gram(built.rows, built.terms), "bench_gram"))
    timed("gram_normalised", lambda: space.table(normalised_gram(cells, sums, built.terms), "bench_normal"))
    profile = timed("gram_profile", lambda: space.table(gram_profile(built.rows, built.terms), "bench_profile"))
    matrix = NormalisedGram(built.rows, sums, built.terms)
    anchors = timed("anchors", lambda: find_corpus_anchors(space, matrix, normalised_norms(profile), TOPICS))
    weights = timed("simplex_weights", lambda: space.table(simplex_weights(anchors.products, anchors.picks), "bench_weights"))
    prob = corpus.word_probability(corpus.term_totals(corpus.corpus_entries(built.rows)))
    timed("recover_topics", lambda: run(recover_topics(weights, prob, TOPICS, built.terms)))
    start = timed("initialise", lambda: initialise(space, built, TOPICS))
    prior, gamma = Prior.of(initial_covariance(TOPICS)), np.zeros((built.covariates, TOPICS - 1))
    state = with_logits(built.rows, None, TOPICS - 1)
    timed("infer", lambda: run(infer(state, start.topics, prior, gamma=gamma)))
    model = timed(f"fit_{ITERATIONS}_iterations", lambda: fit_corpus(space, built, start.topics, params))
    timed("score", lambda: run(score_corpus(built, model)))
    timed("top_words", lambda: run(model.top_words(5)))

    # The size that the survey names: 75 topics, 2,632 terms, 5,000 documents.
    some = documents.select("doc_id", "text").orderBy("doc_id").limit(5000).repartition(spark.sparkContext.defaultParallelism)
    counts = corpus.doc_terms(some)
    every = corpus.vocabulary(space, counts, 5000, 0.0, "bench_words")
    triplets = corpus.document_term(counts, every).where(F.col("term_id") < 2632)
    named = store_corpus(space, triplets, some, 2632)
    many = timed("initialise_75_topics", lambda: initialise(space, named, 75))
    flat = np.zeros((1, 74))
    wide = Prior.of(initial_covariance(75))
    timed("infer_75_topics", lambda: run(infer(with_logits(named.rows, None, 74), many.topics, wide, gamma=flat)))
    timed("iteration_75_topics", lambda: fit_corpus(space, named, many.topics, FitParams(75, max_iterations=1)))

    # All words.
    whole = timed("build_all_words", lambda: build_corpus(space, texts, 0.0))
    timed("initialise_all_words", lambda: initialise(space, whole, TOPICS))
    space.close()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "documents": built.documents,
                "terms": built.terms,
                "all_terms": whole.terms,
                "topics": TOPICS,
                "cpus": cpus,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
