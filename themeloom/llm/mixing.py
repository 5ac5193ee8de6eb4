"""Mix sources to target weights by Pareto order sampling.

The copies expected of a document are in proportion to the square root of its size, up to the most that
is allowed, and a source's sum up to its target: a longer text is worth more copies than a short one, but not in
proportion. Their whole part is certain; the rest is the inclusion probability of one more copy.
Documents are ranked by the odds of a random number divided by the odds of inclusion, and the
lowest ranks are taken until the source's target is reached. The random number is a hash of
the document's id, so a rerun takes the same documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom.operators.corpus import with_ranks
from themeloom.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
_CELLS = 1024


@dataclass(frozen=True)
class MixParams:
    """Sources in code point order, null last, take the weights in turn. The mix has
    ``share_percent`` of all words; no source gives more than ``most`` times its own."""

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    most: int = 2
    seed: str = "mix"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of the MD5 of seed and key."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(space: Workspace, sized: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, target). What a capped source can't give is shared by the others by
    weight until none is above its cap: every other gets one and the same amount per weight."""
    sums = space.table(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    # Spark orders strings by bytes, which for UTF-8 is code point order.
    ranked = with_ranks(space, sums, [F.asc_nulls_last("source")], "place", "ranks")
    weight = F.get(F.array(*[F.lit(w) for w in params.weights]), F.pmod("place", F.lit(len(params.weights))).cast("int"))
    table = space.table(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * params.most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    capped, given, shares = -1, 0, 1
    full = F.lit(False)
    while True:
        figures = table.agg(
            F.count_if(full).alias("capped"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("shares"),
        ).first()
        if figures["capped"] == capped or not figures["shares"]:
            break
        capped, given, shares = figures
        share = (F.lit(total * params.share_percent / 100.0) - F.lit(float(given))) * F.col("weight") / F.lit(float(shares))
        full = full | (share > cap)
    target = F.when(full, cap.cast("double")).otherwise(
        (F.lit(total * params.share_percent / 100.0) - F.lit(float(given))) * F.col("weight") / F.lit(float(shares))
    )
    return space.table(table.select("source", "source_size", target.alias("target")), "targets")


def expected_copies(sized: DataFrame, targets: DataFrame, params: MixParams) -> DataFrame:
    """(source, size, whole, rest, open, even): what every size of a source is expected to give, as certain copies and a
    probability of one more; the words left ``open`` by the certain ones, and their share of all that may give them.

    With the largest k sizes at the most copies, the others' factor c follows from what is left of the target. The
    right k is the first at which the next size stays below the most. One row per size, not per document."""
    mass = F.col("size") * F.col("n") * F.sqrt("size")
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("source").eqNullSafe(F.col("s"))
    known = sizes.join(targets.select(F.col("source").alias("s"), "target"), same).drop("s")
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(mass).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    factor = (F.col("target") - params.most * above) / below
    trial = known.withColumn("factor", factor).where(F.col("factor") * F.sqrt("size") <= params.most * (1 + 1e-9))
    chosen = trial.groupBy(F.col("source").alias("s")).agg(F.max_by("factor", "size").alias("factor"))
    copies = F.col("factor") * F.sqrt("size")
    full = copies >= params.most * (1 - 1e-9)
    each = known.join(chosen, same).drop("s").withColumn("copies", F.when(full, F.lit(float(params.most))).otherwise(copies))
    each = each.withColumn("whole", F.floor("copies")).withColumn("rest", F.col("copies") - F.col("whole"))
    every = Window.partitionBy("source")
    words = F.col("size") * F.col("n")
    open_ = F.col("target") - F.sum(words * F.col("whole")).over(every)
    even = F.try_divide(open_, F.sum(F.when(F.col("rest") > 0, words)).over(every))
    return each.select("source", "size", "whole", "rest", open_.alias("open"), even.alias("even"))


def mix(
    space: Workspace,
    docs: DataFrame,
    keep: list[str],
    params: MixParams = MixParams(),
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the kept columns), size, source_size,
    target, ``copies`` and ``taken`` (words).

    The words that a source's ranked documents still need are found by sums over ranges of the
    rank, refined twice; only the documents of the last range are put in order. Null texts have
    size 0 and are never copied; a null source is a source of its own and the last; rows with equal
    ids and sizes have equal ranks and follow each other, by their text; an empty table gives no rows.
    """
    space = space.part()
    docs = docs.select(
        F.struct(*keep).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
        word_count(text).alias("size"), F.xxhash64(text).alias("digest"),
    )
    sized = space.table(docs.withColumn("rid", F.monotonically_increasing_id()), "sized")
    targets = source_targets(space, sized, params)
    expected = space.table(expected_copies(sized, targets, params), "expected")
    own = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sizes = expected.withColumnsRenamed({"source": "s", "size": "z"})
    joined = own.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    # The odds' ratio q as q / (1 + q), which lies between 0 and 1.
    u, rest = uniform(F.col("key"), params.seed), F.col("rest")
    rank = u * (1 - rest) / (u * (1 - rest) + (1 - u) * rest)
    ranked = joined.select(
        "row", "key", "rid", "digest", "source", "size", "source_size", "target", "open", "even",
        F.coalesce("whole", F.lit(0)).alias("whole"),
        F.when(rest > 0, rank).alias("rank"),
    )
    # Ranges are cut on a number that rises with the rank and is spread evenly where all odds are alike.
    odds = F.col("rank") * F.col("even")
    spread = odds / (odds + (1 - F.col("rank")) * F.greatest(1 - F.col("even"), F.lit(1e-9)))
    place = F.least(F.floor(spread * _CELLS * _CELLS), F.lit(_CELLS * _CELLS - 1))
    ranked = space.table(
        ranked.withColumn("place", place)
        .withColumn("cell", F.floor(F.col("place") / _CELLS))
        .withColumn("part", F.col("place") % _CELLS)
        .drop("place", "even"),
        "ranked",
    )
    before = space.table(_last_cell(ranked.where("rank is not null"), ["source"], "cell", F.lit(0)), "cells")
    inside = _matching(ranked, before, ["source", "cell"])
    finer = space.table(_last_cell(inside, ["source", "cell"], "part", F.col("taken_before")), "parts")
    last = _matching(inside.drop("taken_before"), finer, ["source", "cell", "part"])
    # Only the documents of the last range are ordered; one is in when at least half of it fits.
    so_far = F.sum("size").over(
        Window.partitionBy("source").orderBy("rank", "key", "size", "digest", "rid").rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.col("taken_before") + F.coalesce(so_far, F.lit(0)) + F.col("size") / 2 <= F.col("open")
    chosen = space.table(last.select("rid", reached.alias("in")).where("in").select("rid"), "chosen")
    edge = finer.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.col("part").alias("p"))
    extra = (
        F.when(F.col("rank").isNull() | F.col("c").isNull(), F.lit(False))
        .when(F.col("cell") != F.col("c"), F.col("cell") < F.col("c"))
        .when(F.col("part") != F.col("p"), F.col("part") < F.col("p"))
        .otherwise(F.col("taken_last").isNotNull())
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + extra.cast("int")).otherwise(F.lit(0)).cast("int")
    return (
        ranked.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        .join(chosen.withColumn("taken_last", F.lit(1)), "rid", "left")
        .withColumn("copies", copies)
        .select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def _last_cell(rows: DataFrame, group: list[str], cell: str, start: Column) -> DataFrame:
    """Per source the range in which the running sum of sizes passes what is open, and the sum
    before it (``taken_before``). A source has at most ``_CELLS`` ranges."""
    sums = rows.withColumn("start", start.cast("bigint")).groupBy(*group, cell).agg(
        F.sum("size").alias("size"), F.max("open").alias("open"), F.max("start").alias("start")
    )
    window = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("taken_before", F.col("start") + F.coalesce(F.sum("size").over(window), F.lit(0)))
    reached = running.where(F.col("taken_before") <= F.col("open"))
    return reached.groupBy("source").agg(
        F.max_by(F.struct(*[c for c in group if c != "source"], cell, "taken_before"), cell).alias("last")
    ).select("source", "last.*")


def _matching(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    other = found.select(*[F.col(c).alias(f"_{c}") for c in on], "taken_before")
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same).drop(*[f"_{c}" for c in on])
