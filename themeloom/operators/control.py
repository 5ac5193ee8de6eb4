"""When to stop, and reports that compare results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class Verdict:
    gain: float | None
    converged: bool
    stop: bool


def verdict(bounds: list[float], threshold: float, max_iterations: int) -> Verdict:
    """State after the latest bound (the list is oldest first). From the second iteration
    on a relative gain below the threshold, or a fall, counts as convergence."""
    gain = None
    if len(bounds) > 1:
        gain = (bounds[-1] - bounds[-2]) / abs(bounds[-2])
    converged = gain is not None and gain < threshold
    return Verdict(gain, converged, converged or len(bounds) >= max_iterations)


def verdict_table(history: DataFrame, threshold: float, max_iterations: int, run: str) -> DataFrame:
    """The same for stored histories (run, iteration, bound), one row per iteration."""
    before = F.lag("bound").over(Window.partitionBy(run).orderBy("iteration"))
    checked = history.withColumn("gain", (F.col("bound") - before) / F.abs(before))
    converged = F.coalesce(F.col("gain") < threshold, F.lit(False))
    return checked.select(
        run,
        "iteration",
        "bound",
        "gain",
        converged.alias("converged"),
        (converged | (F.col("iteration") >= max_iterations)).alias("stop"),
    )


def top_words(topics: DataFrame, vocab: DataFrame | None = None, words: int = 5) -> DataFrame:
    """(topic, rank, term_id[, term], prob): the most probable terms of each topic.

    ``topics`` is long: (topic, term_id, prob). Spark keeps at most ``words`` rows per topic
    and task before the shuffle.
    """
    order = Window.partitionBy("topic").orderBy(F.desc("prob"), F.asc("term_id"))
    best = topics.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= words)
    if vocab is None:
        return best.select("topic", "rank", "term_id", "prob")
    named = best.join(vocab.select("term_id", "term"), "term_id")
    return named.select("topic", "rank", "term_id", "term", "prob")


def l1_comparison(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(size_a, size_b, difference): sums of absolute values of two matrices stored as cells
    and of their difference; absent cells are 0."""
    left = a.select(*keys, F.col(value).alias("_a"))
    right = b.select(*keys, F.col(value).alias("_b"))
    va, vb = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return left.join(right, keys, "full").agg(
        F.sum(F.abs(va)).alias("size_a"),
        F.sum(F.abs(vb)).alias("size_b"),
        F.sum(F.abs(va - vb)).alias("difference"),
    )


def pair_by_rank(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rank, a, b): two ranked lists of terms side by side, as far as both go."""
    left = a.select("rank", F.col("term_id").alias("a"))
    return left.join(b.select("rank", F.col("term_id").alias("b")), "rank")
