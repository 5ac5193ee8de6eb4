"""What five document filters do in every order in which they can be applied.

A document fails some of the filters: one of 32 sets. Per part, the documents of each set are counted,
and that is all the audit needs. A coalition of filters removes the documents that fail any of its
members; with that as the worth of a coalition, the potential of Hart and Mas-Colell follows by

    potential(S) = (worth(S) + sum over i in S of potential(S without i)) / |S|,   potential of none = 0,

a filter's Shapley value is the potential of all filters minus that without it, and what a filter
does at its place in an order is the difference of two coalitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom.llm.words import text_batches

FILTERS = "ABCDE"
ORDERS = math.factorial(len(FILTERS))
_ALL = (1 << len(FILTERS)) - 1
_COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: What is counted: all documents, those of good quality, toxic ones.
_COUNTS = ("n", "good", "toxic")


@dataclass(frozen=True)
class AuditParams:
    """A: fewer than ``min_words`` words. B: less than ``distinct_percent`` of them are different.
    C: more than ``upper_percent`` of the code points are A to Z. D: holds one of ``symbols``.
    E: a copy of a document with a smaller id."""

    min_words: int = 50
    distinct_percent: int = 65
    upper_percent: int = 5
    symbols: str = "#$%&*|"


def text_failures(text: str, params: AuditParams = AuditParams()) -> int:
    """The set of filters A to D that a text fails, as bits."""
    raw = text.encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    plain = raw.translate(None, params.symbols.encode())
    fails = (
        len(words) < params.min_words,
        100 * len(set(words)) < params.distinct_percent * len(words),
        100 * upper > params.upper_percent * len(text),
        len(plain) < len(raw),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def judge_texts(docs: DataFrame, params: AuditParams, text: str, part: str, order: str) -> DataFrame:
    """(doc_id, part, digest, fails) of every row; the digest tells texts apart."""
    given = text_batches(docs).select(
        F.col(order).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fails = np.fromiter((text_failures(t, params) for t in texts), np.int32, len(texts))
            digests = pa.array([blake2b(t.encode(), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), digests, pa.array(fails)],
                ["doc_id", "part", "digest", "fails"],
            )

    return given.mapInArrow(run, "doc_id BIGINT, part STRING, digest BINARY, fails INT")


def failure_counts(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents per part and set of failed filters.

    Copies are counted, not looked up: rows of one text, part and label are summed first, with
    their smallest id and how many rows have it. Of a text's sums only those with the smallest id
    of all hold rows that are no copies. So neither a text that a third of all rows hold nor its
    ids come together anywhere."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Rows without id find no label: they are dealt by their text.
    named = F.col("doc_id").isNotNull()
    keyed = judged.withColumn("named", named).withColumn("at", F.coalesce("doc_id", F.xxhash64("digest")))
    marks = marks.where(named).select(F.col("doc_id").alias("at"), F.lit(True).alias("named"), "good", "toxic")
    marked = keyed.join(marks, ["at", "named"], "left").fillna(0, ["good", "toxic"])
    key = ["digest", "part", "fails", "good", "toxic"]
    # The smallest id and the rows that have it, in one aggregation with partial sums.
    per_id = marked.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    sums = per_id.groupBy(*key).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("first"),
    )
    # A text has one row per part and label here, however many documents hold it.
    both = sums.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    own = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.rows")).otherwise(0)
    cases = F.array(
        F.struct(F.col("fails").alias("fails"), own.alias("n")),
        F.struct(F.col("fails").bitwiseOR(F.lit(_COPY)).alias("fails"), (F.col("rows") - own).alias("n")),
    )
    split = both.select("part", "good", "toxic", F.explode(cases).alias("c")).select("part", "good", "toxic", "c.*")
    return split.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def coalition_worths(counts: DataFrame) -> DataFrame:
    """One row per part: the columns n, good and toxic as arrays over the 32 coalitions, entry S the
    documents that fail a member of S; ``total``, and ``only``, the documents that fail one filter alone."""

    def worth(column: str) -> Column:
        fails = [F.col("fails").bitwiseAND(F.lit(s)) != 0 for s in range(_ALL + 1)]
        return F.array(*[F.sum(F.when(f, F.col(column)).otherwise(0)) for f in fails]).alias(column)

    only = [F.sum(F.when(F.col("fails") == (1 << k), F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*only).alias("only"), *map(worth, _COUNTS))


def with_potentials(worths: DataFrame) -> DataFrame:
    """Adds ``potential``, an array over the coalitions, in 120ths: these are whole numbers, since a
    potential sums shares of at most five members. Coalitions of one size follow from those below."""
    table = worths.withColumn("p_0", F.lit(0).cast("bigint"))
    for size in range(1, len(FILTERS) + 1):
        table = table.withColumns(
            {
                f"p_{s}": F.expr(
                    f"({ORDERS} * n[{s}] + " + " + ".join(f"p_{s & ~(1 << i)}" for i in _members(s)) + f") div {size}"
                )
                for s in range(_ALL + 1)
                if s.bit_count() == size
            }
        )
    names = [f"p_{s}" for s in range(_ALL + 1)]
    return table.withColumn("potential", F.array(*names)).drop(*names)


def _members(coalition: int) -> list[int]:
    return [i for i in range(len(FILTERS)) if coalition >> i & 1]


def _steps() -> Column:
    """Every step of every order: the filter, the coalitions before and after it, and it alone. Bounded by the filters."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            values = {"step": step, "i": i, "before": before, "after": before | 1 << i, "alone": 1 << i}
            fields = ", ".join(f"'{field}', {value}" for field, value in values.items())
            steps.append(f"named_struct('filter_order', '{name}', {fields})")
            before |= 1 << i
    return F.expr(f"array({', '.join(steps)})")


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    params: AuditParams = AuditParams(),
    text: str = "text",
    part: str = "source",
    order: str = "doc_id",
) -> DataFrame:
    """One row per part, order of the filters and step: documents ``kept`` after it and ``removed`` by
    it, ``redundant`` (failing the filter, but removed before), ``unique_fails`` (failing it alone),
    ``good_lost`` and ``toxic_lost`` (labelled so and removed by it), and ``shapley``, the filter's
    removals summed over all orders.

    A null text is empty, a null part is the part ''; texts are copies when they are equal code point
    by code point, in any part. Rows with equal ids (repeated rows) are not copies of each other, and a
    row without id neither is a copy nor makes others copies. Of repeated labels the larger value
    counts, a missing one is 0. An empty table gives no rows."""
    counts = failure_counts(judge_texts(docs, params, text, part, order), labels)
    audited = with_potentials(coalition_worths(counts))
    at = audited.select("*", F.explode(_steps()).alias("s")).select("*", "s.*")

    def gain(column: str) -> Column:
        return F.get(column, F.col("after")) - F.get(column, F.col("before"))

    return at.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.get("n", F.col("after"))).alias("kept"),
        gain("n").alias("removed"),
        (F.get("n", F.col("alone")) - gain("n")).alias("redundant"),
        F.get("only", F.col("i")).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(_ALL)) - F.get("potential", F.lit(_ALL) - F.col("alone"))).alias("shapley"),
    )
