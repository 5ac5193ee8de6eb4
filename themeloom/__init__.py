"""Topic models with document covariates, fitted on Spark."""

import sys

from pyspark import cloudpickle

from themeloom.operators.covariates import Design, design
from themeloom.params import FitParams
from themeloom.plans.corpus import Corpus, build_corpus, store_corpus
from themeloom.plans.em import continue_fit, fit, fit_corpus, resume
from themeloom.plans.initialise import initialise
from themeloom.plans.model import Model, load
from themeloom.plans.score import score, score_corpus, score_texts, scored_documents
from themeloom.workspace import Workspace

# Functions that run in tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Corpus",
    "Design",
    "FitParams",
    "Model",
    "Workspace",
    "build_corpus",
    "continue_fit",
    "design",
    "fit",
    "fit_corpus",
    "initialise",
    "load",
    "resume",
    "score",
    "score_corpus",
    "score_texts",
    "scored_documents",
    "store_corpus",
]
