"""Settings of a fit."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FitParams:
    """Settings of a topic model fit.

    topics          number of topics, K
    aspects         number of content groups, A; ``aspect`` columns hold 0..A-1
    max_iterations  EM iterations after which the fit stops
    threshold       relative gain of the bound below which the fit has converged
    sigma_shrink    0 keeps the full prior covariance, 1 only its diagonal
    min_doc_share   a term enters the vocabulary when at least this share of the
                    documents has it; 0 keeps all. With L distinct terms in the average
                    document at most L / min_doc_share terms pass, whatever the corpus size.
    partitions      partitions of the corpus; None takes the shuffle setting
    """

    topics: int
    aspects: int = 1
    max_iterations: int = 50
    threshold: float = 1e-5
    sigma_shrink: float = 0.0
    min_doc_share: float = 0.0
    partitions: int | None = None

    def __post_init__(self) -> None:
        if self.topics < 2:
            raise ValueError(f"at least 2 topics are needed, got {self.topics}")
        if self.aspects < 1:
            raise ValueError(f"at least 1 aspect is needed, got {self.aspects}")
        if self.max_iterations < 1:
            raise ValueError(f"at least 1 iteration is needed, got {self.max_iterations}")
        if not 0.0 <= self.sigma_shrink <= 1.0:
            raise ValueError(f"sigma_shrink must lie in [0, 1], got {self.sigma_shrink}")
        if not 0.0 <= self.min_doc_share <= 1.0:
            raise ValueError(f"min_doc_share must lie in [0, 1], got {self.min_doc_share}")
