from __future__ import annotations

import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from themeloom import Workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("themeloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def space(spark, tmp_path):
    return Workspace(spark, str(tmp_path))


class Planted:
    """Documents drawn from known topics. Every topic has terms of its own, so anchors exist, and
    no term is so rare that noise makes it one."""

    def __init__(self, topics: int = 5, terms: int = 200, documents: int = 600, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.topics, self.terms, self.documents = topics, terms, documents
        beta = rng.dirichlet(np.full(terms, 1.0), topics)
        own = terms // 20
        for k in range(topics):
            beta[:, k * own : (k + 1) * own] = 0.0
            beta[k, k * own : (k + 1) * own] = 0.03
        self.beta = beta / beta.sum(axis=1, keepdims=True)
        self.x = np.column_stack([np.ones(documents), rng.normal(size=documents)])
        logits = self.x @ rng.normal(0, 0.8, (2, topics - 1)) + rng.normal(0, 2.0, (documents, topics - 1))
        full = np.exp(np.column_stack([logits, np.zeros(documents)]))
        self.theta = full / full.sum(axis=1, keepdims=True)
        lengths = rng.integers(100, 300, documents)
        self.counts = np.array([rng.multinomial(n, t @ self.beta) for n, t in zip(lengths, self.theta)])

    def triplet_rows(self) -> list[tuple[int, int, float]]:
        d, w = np.nonzero(self.counts)
        return [(int(a), int(b), float(self.counts[a, b])) for a, b in zip(d, w)]

    def triplets(self, spark):
        return spark.createDataFrame(self.triplet_rows(), "doc_id BIGINT, term_id INT, cnt DOUBLE")

    def docs(self, spark):
        return spark.range(self.documents).withColumnRenamed("id", "doc_id")

    def covariates(self, spark):
        rows = [(i, [float(v) for v in x]) for i, x in enumerate(self.x)]
        return spark.createDataFrame(rows, "doc_id BIGINT, x ARRAY<DOUBLE>")


@pytest.fixture(scope="session")
def planted():
    return Planted()
