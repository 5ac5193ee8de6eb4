"""The state of a fit after each iteration, from which another driver can go on.

A record names the tables of the iteration and holds the small results. It is written when all its tables are there, and
tables of the iteration before go after that: whenever a driver ends, the last record is whole.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import SparkSession

from themeloom.operators.corpus import Vocabulary
from themeloom.operators.estep import Topics
from themeloom.params import FitParams
from themeloom.plans.corpus import Corpus
from themeloom.plans.model import Model
from themeloom.workspace import Workspace, newest, read_text, write_text


@dataclass(frozen=True)
class Journal:
    """The records of one fit, beside its tables."""

    space: Workspace
    corpus: Corpus
    params: FitParams

    def commit(self, number: int, topics: str, result: str, model: Model) -> None:
        """``topics`` and ``result`` are the folders of the iteration's tables."""
        if self.corpus.path is None:
            return  # rows that are stored nowhere can't be found again
        vocab = self.corpus.vocab
        record = {
            "params": asdict(self.params),
            "corpus": {
                "path": self.corpus.path,
                "buckets": self.corpus.buckets,
                "documents": self.corpus.documents,
                "terms": self.corpus.terms,
                "covariates": self.corpus.covariates,
                "aspects": self.corpus.aspects,
            },
            "vocabulary": vocab and {"files": vocab.table.inputFiles(), "bytes": vocab.bytes, "entries": vocab.entries},
            "topics": topics,
            "result": result,
            "gamma": model.gamma.tolist(),
            "sigma": model.sigma.tolist(),
            "history": model.history,
            "unsettled": model.unsettled,
            "converged": model.converged,
        }
        write_text(self.space.spark, self.space.path(f"journal/{number:06d}.json"), json.dumps(record))


@dataclass(frozen=True)
class Saved:
    """What a record holds, with its tables opened."""

    corpus: Corpus
    params: FitParams
    model: Model


def last_saved(spark: SparkSession, space: Workspace, folder: str) -> Saved:
    """The latest record of the fits in a workspace's folder."""
    path = newest(spark, f"{folder.rstrip('/')}/*/journal/*.json") or newest(spark, f"{folder.rstrip('/')}/journal/*.json")
    if path is None:
        raise FileNotFoundError(f"no iteration of a fit has ended in {folder}")
    record = json.loads(read_text(spark, path))
    facts, known = record["corpus"], record["vocabulary"]
    vocab = known and Vocabulary(spark.read.parquet(*known["files"]), facts["terms"], known["bytes"], known["entries"])
    rows = space.reopened(facts["path"], "corpus", "doc_id", facts["buckets"])
    corpus = Corpus(rows=rows, vocab=vocab, **facts)
    params = FitParams(**record["params"])
    result = spark.read.parquet(record["result"]).where("kind = 'doc'")
    gamma = np.array(record["gamma"])
    model = Model(
        topics=Topics(spark.read.parquet(record["topics"]), params.topics, corpus.terms),
        gamma=gamma,
        sigma=np.array(record["sigma"]),
        logits=result.selectExpr("doc_id", "vec as eta", "bound"),
        prior_means=corpus.prior_means(gamma),
        history=[tuple(row) for row in record["history"]],
        converged=record["converged"],
        vocab=vocab and vocab.table.select("term_id", "term"),
        unsettled=record["unsettled"],
    )
    return Saved(corpus, params, model)
