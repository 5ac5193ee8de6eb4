"""How the words of a source differ from those of other sources and of its language.

Counts of a term become levels: a term has, for each group (language and source) that holds it, one
indicator column (group, count). The indicator matrix of a block of terms times its transpose says how
many of its terms have count x in group a and count y in group b; blocks add up, exactly, to the joint
tables of all pairs of groups. A difference of two groups depends on the two counts of a term alone, so it is
priced per cell of their joint table and not per term.

Count 0 has no column. What its cells hold follows from the tables' margins (the diagonal of the product:
how many terms of a group have a count) and the number of terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom.llm.words import text_batches
from themeloom.workspace import Workspace

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NAMES = (pa.string(), pa.string(), pa.int64())
_TABLE = "lang STRING, a STRING, x BIGINT, b STRING, y BIGINT, n BIGINT"


@dataclass(frozen=True)
class DivergenceParams:
    """A language keeps the terms in at least ``min_docs`` of its documents. A share is counted in
    1 / ``scale``, with ``add`` to every count; ``top`` terms of a group are listed. A task counts up to
    ``held`` different words before it hands them on, multiplies ``block`` terms at once, in stripes of
    ``columns`` indicator columns, and holds up to ``cells`` cells. The last four change no result."""

    min_docs: int = 3
    add: int = 1
    scale: int = 1_000_000_000
    top: int = 200
    held: int = 1 << 19
    block: int = 512
    columns: int = 2048
    cells: int = 1 << 20


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, with A-Z in lower case."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame, params: DivergenceParams, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, cnt, docs): occurrences and documents of every term in every group. Counted
    in the task first, so a frequent word sends one row per task and group."""
    given = text_batches(docs).select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for batch in batches:
            for body, *group in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
                terms = Counter(terms_of(body))
                counts[*group].update(terms)
                found[*group].update(terms.keys())
            if sum(map(len, counts.values())) >= params.held:
                yield from _counted(counts, found)
                counts.clear(), found.clear()
        yield from _counted(counts, found)

    partial = given.mapInArrow(run, "lang STRING, source STRING, term STRING, cnt BIGINT, docs BIGINT")
    # Dealt by term: what is grouped by term later needs no other shuffle.
    dealt = partial.repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))


def _counted(counts: dict, found: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), terms in counts.items():
        if terms:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(list(terms), pa.binary()).cast(pa.string()),
                    pa.array(list(terms.values()), pa.int64()),
                    pa.array([found[lang, source][t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "cnt", "docs"],
            )


def kept_terms(counts: DataFrame, params: DivergenceParams) -> DataFrame:
    """(lang, term, total, groups): a language's terms that enough of its documents hold, with the count
    in each source that has the term, by source."""
    entry = F.struct("source", "cnt")
    per_term = counts.groupBy("lang", "term").agg(
        F.sum("cnt").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(entry)).alias("groups")
    )
    return per_term.where(F.col("docs") >= params.min_docs).drop("docs")


def joint_tables(terms: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """(lang, a, x, b, y, n): n terms have count x > 0 in source a and y > 0 in source b, for a < b, and
    for a = b on the diagonal (x = y): the margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells()
        for batch in batches:
            for at in range(0, batch.num_rows, params.block):
                cells.multiply(batch.slice(at, params.block), params.columns)
                if cells.waiting >= params.cells:
                    cells.merge()
                    if cells.waiting >= params.cells // 2:
                        yield cells.table()
                        cells = _Cells()
        yield cells.table()

    # Terms of a language and of like frequency lie together, so that a block has few columns.
    near = terms.repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total")
    partial = near.select("lang", "groups").mapInArrow(run, _TABLE)
    return partial.groupBy("lang", "a", "x", "b", "y").agg(F.sum("n").alias("n"))


class _Cells:
    """Cells of the joint tables that a task has summed so far."""

    def __init__(self):
        self.index: dict[tuple[str, str, int], int] = {}
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.waiting = 0

    def multiply(self, block: pa.RecordBatch, stripe: int) -> None:
        """Adds the product of a block's indicator matrix with its transpose, stripe by stripe."""
        rows, columns = [], []
        for row, (lang, groups) in enumerate(zip(block.column("lang").to_pylist(), block.column("groups").to_pylist())):
            for group in groups:
                rows.append(row)
                columns.append(self.index.setdefault((lang, group["source"], group["cnt"]), len(self.index)))
        ids, columns = np.unique(np.array(columns, np.int64), return_inverse=True)
        rows = np.array(rows, np.int64)

        def part(start: int) -> np.ndarray:
            ours = (columns >= start) & (columns < start + stripe)
            ones = np.zeros((block.num_rows, min(stripe, len(ids) - start)), np.float32)
            ones[rows[ours], columns[ours] - start] = 1.0  # sums of a block stay far below 2^24: exact
            return ones

        for first in range(0, len(ids), stripe):
            left = part(first)
            for second in range(first, len(ids), stripe):
                product = left.T @ left if second == first else left.T @ part(second)
                i, j = np.nonzero(np.triu(product) if second == first else product)
                self.keys.append(ids[first + i] << 32 | ids[second + j])
                self.sums.append(product[i, j].astype(np.int64))
                self.waiting += len(i)

    def merge(self) -> None:
        if self.keys:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.concatenate(self.sums))
            self.keys, self.sums, self.waiting = [keys], [sums], len(keys)

    def table(self) -> pa.RecordBatch:
        self.merge()
        keys, sums = (self.keys[0], self.sums[0]) if self.keys else (np.empty(0, np.int64),) * 2
        lang, source, level = (pa.array(c, t) for c, t in zip(zip(*self.index) if self.index else ((),) * 3, _NAMES))
        i, j = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
        # The source that comes first in UTF-8 is a; both are of one language, since a row is.
        order = np.argsort(np.array([s.encode() for s in source.to_pylist()], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        swap = pa.array(place[keys >> 32] > place[keys & 0xFFFFFFFF])
        i, j = pc.if_else(swap, j, i), pc.if_else(swap, i, j)
        return pa.RecordBatch.from_arrays(
            [lang.take(i), source.take(i), level.take(i), source.take(j), level.take(j), pa.array(sums)],
            ["lang", "a", "x", "b", "y", "n"],
        )


def share(count: Column, total: Column, terms: Column, params: DivergenceParams) -> Column:
    """1 + floor(scale (count + add) / (total + add terms)), exactly."""
    wide = F.lit(params.scale).cast("decimal(20,0)") * (count + params.add).cast("decimal(18,0)")
    every = F.greatest(total + params.add * terms, F.lit(1))  # without terms nothing is priced
    return 1 + F.call_function("div", wide, every.cast("decimal(18,0)"))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q). Shares stay below 2^31, so that the square is a BIGINT."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, terms: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, size, lang_size, terms): tokens of kept terms in every group and its language, and
    the language's kept terms. Groups without any are there too."""
    named = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))
    of_group = terms.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("cnt").alias("size"))
    of_lang = terms.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count(F.lit(1)).alias("terms"))
    all_groups = docs.select(*named).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return all_groups.fillna(0, ["size", "lang_size", "terms"])


def priced_pairs(tables: DataFrame, groups: DataFrame, params: DivergenceParams) -> DataFrame:
    """(lang, source, item, value): the price of every source against every other one of its language.

    With f(x, y) the price of counts x and y, a table's cells with a count of 0 are put in terms of the
    others: the sum over all terms is

        terms f(0, 0) + sum n(x) (f(x, 0) - f(0, 0)) + sum n(y) (f(0, y) - f(0, 0))
            + sum n(x, y) (f(x, y) - f(x, 0) - f(0, y) + f(0, 0)),

    with n(x) and n(y) the margins and n(x, y) the cells of counts above 0."""
    zero = share(F.lit(0).cast("bigint"), F.col("size"), F.col("terms"), params)
    one = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("a_size"), "terms", zero.alias("p0"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("b_size"), zero.alias("q0"))
    pairs = one.join(two, "lang").where(F.col("a") != F.col("b")).withColumn("f00", price(F.col("p0"), F.col("q0")))
    p = share(F.col("x"), F.col("a_size"), F.col("terms"), params)
    q = share(F.col("y"), F.col("b_size"), F.col("terms"), params)
    margins = tables.where("a = b")
    cells = tables.where("a <> b")
    back = cells.select("lang", F.col("b").alias("a"), F.col("y").alias("x"), F.col("a").alias("b"), F.col("x").alias("y"), "n")
    left = margins.select("lang", "a", "x", "n").join(pairs, ["lang", "a"]).withColumn("p", p)
    right = margins.select("lang", "b", "y", "n").join(pairs, ["lang", "b"]).withColumn("q", q)
    inner = cells.unionByName(back).join(pairs, ["lang", "a", "b"]).withColumns({"p": p, "q": q})
    parts = (
        pairs.withColumn("part", F.when(F.col("terms") > 0, F.col("terms") * F.col("f00")).otherwise(0)),
        left.withColumn("part", F.col("n") * (price(F.col("p"), F.col("q0")) - F.col("f00"))),
        right.withColumn("part", F.col("n") * (price(F.col("p0"), F.col("q")) - F.col("f00"))),
        inner.withColumn(
            "part",
            F.col("n")
            * (price(F.col("p"), F.col("q")) - price(F.col("p"), F.col("q0")) - price(F.col("p0"), F.col("q")) + F.col("f00")),
        ),
    )
    union = None
    for table in parts:
        table = table.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("part").cast("decimal(38,0)"))
        union = table if union is None else union.unionByName(table)
    return union.groupBy("lang", "source", "item").agg(F.sum("part").cast("bigint").alias("value"))


def priced_terms(terms: DataFrame, groups: DataFrame, params: DivergenceParams) -> DataFrame:
    """(lang, source, item, value): terms that a group uses more than its language does."""
    uses = terms.select("lang", F.col("term").alias("item"), "total", F.inline("groups")).join(groups, ["lang", "source"])
    p = share(F.col("cnt"), F.col("size"), F.col("terms"), params)
    q = share(F.col("total"), F.col("lang_size"), F.col("terms"), params)
    more = uses.withColumns({"p": p, "q": q}).where("p > q")
    return more.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))


def audit_divergence(
    space: Workspace,
    docs: DataFrame,
    params: DivergenceParams = DivergenceParams(),
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language, by what
    it differs from this one over all terms. Part ``term``: the ``top`` terms that the source uses more
    than its language. Ranks count from 1 by falling value, then by item.

    Nulls are the empty string: a text without terms, a language or source of its own. Groups without kept
    terms have pairs, of value 0 where the language has no terms; an only source has none. Repeated rows
    are documents of their own; an empty table gives no rows."""
    space = space.part()
    terms = space.table(kept_terms(term_counts(docs, params, text, lang, source), params), "terms")
    groups = space.table(group_sizes(docs, terms, lang, source), "groups")
    tables = space.table(joint_tables(terms, params), "tables")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(found: DataFrame, part: str) -> DataFrame:
        listed = found.withColumn("rank", F.row_number().over(order))
        return listed.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    every = ranked(priced_pairs(tables, groups, params), "pair")
    top = ranked(priced_terms(terms, groups, params), "term").where(F.col("rank") <= params.top)
    return every.unionByName(top)
