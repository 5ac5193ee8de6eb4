"""Self-join of documents on the Jaccard similarity of their n-gram sets, down to components.

1. Documents with equal sets fall into one class; from here on only classes count.
2. n-grams are ordered rarest first. Their document frequencies are counted over all documents
   in a table of fixed size, by hash; an n-gram's frequency is that of its cell, to three binary digits,
   so the order is the same everywhere and its memory does not grow.
3. Two sets as similar as asked share one of the first n - ceil(t n) + 1 n-grams in that order.
   Pairs meet there and pass the length, the positional and the suffix filter, then their texts
   are compared once.
4. Classes that share an n-gram few others have are compared in pairs. Those of an n-gram that
   many have are compared block by block inside tasks, which return who is joined with whom, not
   the pairs. So a large group of near copies emits its size, not its square, and no link is lost.
   A pair is open in one block only, that of the smallest such n-gram in both prefixes, and in none
   if it also shares a rarer one. A first round over prefixes alone finds the rows with open pairs;
   the whole sets follow for those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_128_digest

from themeloom.llm.blocks import into_blocks, per_block, smallest_linked
from themeloom.llm.components import components
from themeloom.llm.words import hash_words, lower_words, signed, text_batches, window_hashes
from themeloom.workspace import Workspace

_RANGES = 64          # hash ranges that the suffix filter compares
_SLICES = 64          # parts of the table of frequencies


@dataclass(frozen=True)
class JoinParams:
    """Sets of ``width`` words link at ``percent`` of Jaccard similarity. ``cells`` is the size of
    the frequency table: one byte each on every worker, whatever the corpus. An n-gram of more
    than ``few`` prefixes is compared in blocks of ``block`` classes, ``strip``
    n-grams at a time."""

    width: int = 3
    percent: int = 90
    cells: int = 1 << 23
    few: int = 32
    block: int = 256
    strip: int = 1 << 14


def ngram_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct n-grams of a text as sorted 64-bit hashes."""
    return np.unique(window_hashes(hash_words(lower_words(text)), width))


def prefix_of(grams: np.ndarray, frequencies: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n-grams of a set, rarest first: two linked sets share one of them."""
    often = frequencies[(grams % np.uint64(len(frequencies))).astype(np.int64)]
    return grams[np.lexsort((grams, often))[: len(grams) - (percent * len(grams) + 99) // 100 + 1]]


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection of two linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(float(100 + percent)) - F.lit(1e-9))


def _sets(docs: DataFrame, params: JoinParams) -> DataFrame:
    """Two kinds of rows: (doc_id, n, same, ranges) per document, and (slice, counts), the document
    frequencies a task has counted, as packed slices of the table of cells."""
    width, cells = params.width, params.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, one = np.zeros(cells, np.uint32), np.uint32(1)
        for batch in batches:
            sizes, same, ranges = [], [], []
            for value in batch.column("text").to_pylist():
                found = ngram_set(value, width)
                np.add.at(seen, (found % np.uint64(cells)).astype(np.intp), one)
                sizes.append(len(found))
                same.append(xxh3_128_digest(found.tobytes()))
                ranges.append(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=_RANGES).astype(np.int32))
            yield _batch(doc_id=batch.column("doc_id"), n=sizes, same=same, ranges=ranges)
        size = cells // _SLICES
        packed = [(k, part) for k in range(_SLICES) if (part := seen[k * size : (k + 1) * size]).any()]
        yield _batch(slice=[k for k, _ in packed], counts=[_packed(part) for _, part in packed])

    return docs.mapInArrow(run, "doc_id BIGINT, n INT, same BINARY, ranges ARRAY<INT>, slice INT, counts BINARY")


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a slice: as they are, or places and counts where few are not zero."""
    places = np.flatnonzero(counts).astype(np.uint32)
    if 4 * len(places) < len(counts):
        return b"s" + zlib.compress(places.tobytes() + counts[places].tobytes(), 1)
    return b"d" + zlib.compress(counts.tobytes(), 1)


def _add_packed(total: np.ndarray, packed: bytes) -> None:
    found = np.frombuffer(zlib.decompress(packed[1:]), np.uint32)
    if packed[:1] == b"d":
        total += found
    else:
        total[found[: len(found) // 2]] += found[len(found) // 2 :]


def _batch(doc_id=None, n=None, same=None, ranges=None, slice=None, counts=None) -> pa.RecordBatch:
    rows = len(n) if n is not None else len(slice)
    column = lambda values, kind: pa.nulls(rows, kind) if values is None else pa.array(values, kind)
    if ranges:
        ends = pa.array(np.arange(len(ranges) + 1, dtype=np.int32) * _RANGES)
        ranges = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ranges)))
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(rows, pa.int64()) if doc_id is None else doc_id,
            column(n, pa.int32()),
            column(same, pa.binary()),
            ranges if isinstance(ranges, pa.Array) else pa.nulls(rows, pa.list_(pa.int32())),
            column(slice, pa.int32()),
            column(counts, pa.binary()),
        ],
        ["doc_id", "n", "same", "ranges", "slice", "counts"],
    )


def _grades(counts: np.ndarray) -> np.ndarray:
    """A byte for each count that rises with it: up to 15 the count, beyond its first four binary digits and their place.
    Prefixes need one order of all n-grams, not their frequencies."""
    counts = np.minimum(counts, np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = np.maximum(np.frexp(counts.astype(float))[1] - 4, 0)
    return (8 * place + (counts >> place)).astype(np.uint8)


def _frequencies(sets: DataFrame, cells: int) -> np.ndarray:
    """The table of document frequencies, as grades: ``cells`` bytes, added up slice by slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slice = np.zeros(cells // _SLICES, np.uint64), None
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                slice = k
                _add_packed(total, packed)
        yield pa.RecordBatch.from_arrays([pa.array([slice], pa.int32()), pa.array([_grades(total).tobytes()])], ["slice", "total"])

    parts = sets.where("slice is not null").select("slice", "counts")
    added = parts.groupBy("slice").applyInArrow(add, "slice INT, total BINARY")
    found = np.zeros(cells, np.uint8)
    size = cells // _SLICES
    for row in added.collect():
        found[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["total"], np.uint8)
    return found


def _prefixes(docs: DataFrame, shared: Broadcast, params: JoinParams) -> DataFrame:
    """(doc_id, n, prefix): the rarest n-grams of each document, rarest first."""
    width, percent = params.width, params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sizes, found, ends = [], [], [0]
            for value in batch.column("text").to_pylist():
                grams = ngram_set(value, width)
                sizes.append(len(grams))
                found.append(prefix_of(grams, table, percent) if len(grams) else grams)
                ends.append(ends[-1] + len(found[-1]))
            values = signed(np.concatenate(found)) if found else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), prefix], ["doc_id", "n", "prefix"])

    return docs.mapInArrow(run, "doc_id BIGINT, n INT, prefix ARRAY<BIGINT>")


def _verified(pairs: DataFrame, docs: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (a, b) whose whole texts are as similar as asked."""
    width, percent = params.width, params.percent
    first = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    together = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                left, right = ngram_set(a, width), ngram_set(b, width)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(common > 0 and 100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return together.mapInArrow(run, "a BIGINT, b BIGINT")


def _similar_ranges(pairs: DataFrame, classes: DataFrame, params: JoinParams) -> DataFrame:
    """Suffix filter. The hash ranges cut both sets at the same pivots; what the numbers of
    n-grams in them differ by is not shared, and a linked pair can't differ by more than its
    sizes leave."""
    for side in ("a", "b"):
        facts = classes.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("ranges").alias(f"ranges_{side}"))
        pairs = pairs.join(facts, side)
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    both = F.col("n_a") + F.col("n_b")
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * params.percent
    return pairs.where(close & (apart <= both - 2 * _needed(F.col("n_a"), F.col("n_b"), params.percent))).select("a", "b").distinct()


def ngram_join(
    space: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: the size of its set and the
    smallest id reachable by links.

    A null or empty text, or one of white space only, has an empty set and links with nothing. Rows
    of one id are one node of the graph. Rows without id get no component. Repeated rows repeat in the
    result; an empty table gives none. Texts are never cut.
    """
    space = space.part()
    docs = text_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    sets = space.table(_sets(docs, params), "sets")
    facts = sets.where("slice is null").drop("slice", "counts")
    linked = facts.where("n > 0 and doc_id is not null")
    least = linked.groupBy("same", "n").agg(F.min("doc_id").alias("doc_id"), F.first("ranges").alias("ranges"))
    classes = space.table(least, "classes")

    frequencies = docs.sparkSession.sparkContext.broadcast(_frequencies(sets, params.cells))
    prefixes = _prefixes(docs, frequencies, params)
    ids = classes.select("doc_id").distinct()
    posted = prefixes.join(ids, "doc_id").select("doc_id", "n", F.posexplode("prefix").alias("place", "gram"))
    posted = space.table(posted.distinct(), "posted")
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    shared = space.table(posted.join(space.table(often, "often"), "gram"), "shared")
    space.drop("posted")

    held = space.table(_frequent_sets(space, shared.where(F.col("docs") > params.few), docs, frequencies, params), "frequent_sets")
    frequencies.destroy()  # the prefixes are written: nothing needs them again

    pairs = _close_pairs(shared.where(F.col("docs") <= params.few), params)
    pairs = space.table(_similar_ranges(pairs, classes, params), "pairs")
    space.drop("shared")  # all that is read from it is written
    found = space.table(_verified(pairs, docs, params), "found")
    every = found.unionByName(space.table(_block_edges(space, held, params), "edges"))

    # Classes that share an id are one node already; copies hang on their class.
    named = linked.join(classes.select("same", "n", F.col("doc_id").alias("class")), ["same", "n"])
    twice = named.where("doc_id != class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    several = linked.select("doc_id", "same").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    every = every.unionByName(twice.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi"))
    whole = space.table(components(space, every), "components")
    labels = named.join(whole.withColumnRenamed("id", "class"), "class", "left").select(
        "doc_id", "n", F.coalesce("component", "class").cast("bigint").alias("component_id")
    )
    alone = facts.where("n = 0 or doc_id is null").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    both = labels.unionByName(alone)
    return both.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def _close_pairs(shared: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs that share a prefix n-gram and pass the length and the positional filter: after a
    common n-gram at these places, not more than the shorter rest of the two sets can be common,
    besides what came before."""
    x, y = shared.alias("x"), shared.alias("y")
    longest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + F.least("x.place", "y.place")
    close = (
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.doc_id") < F.col("y.doc_id"))
        & (F.col("x.n") * 100 >= F.col("y.n") * params.percent)
        & (F.col("y.n") * 100 >= F.col("x.n") * params.percent)
        & (longest >= _needed(F.col("x.n"), F.col("y.n"), params.percent))
    )
    return x.join(y, close).select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct()


def _frequent_sets(space: Workspace, shared: DataFrame, docs: DataFrame, frequencies: Broadcast, params: JoinParams) -> DataFrame:
    """(id, doc_id, n, rare, often, places, grams): the different sets of all ids with a frequent n-gram in
    their prefix: its frequent n-grams with their places, the others of the prefix, and the whole set."""
    width, percent = params.width, params.percent
    # Stored, so their size is known: while they are few, the texts of all others stay where they are.
    listed = space.table(shared.groupBy("doc_id").agg(F.collect_set("gram").alias("listed")), "frequent")
    ids = space.table(listed.select("doc_id"), "frequent_ids")
    once = docs.join(ids, "doc_id", "left_semi").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequencies.value
        for batch in batches:
            rows = []
            for name, text, frequent in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("listed")):
                grams = ngram_set(text, width)
                if len(grams):
                    prefix = signed(prefix_of(grams, table, percent))
                    place = np.flatnonzero(np.isin(prefix, frequent.values.to_numpy()))
                    rows.append((name, len(grams), np.delete(prefix, place), prefix[place], place, signed(grams)))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            columns = zip(*rows) if rows else [()] * 6
            names = ["doc_id", "n", "rare", "often", "places", "grams"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    lists = ", ".join(f"{c} ARRAY<BIGINT>" for c in ("rare", "often", "places", "grams"))
    found = once.join(listed, "doc_id").mapInArrow(run, f"doc_id BIGINT, n BIGINT, {lists}")
    return found.withColumn("id", F.monotonically_increasing_id())


def _common(values: np.ndarray, row: np.ndarray, rows: int, strip: int) -> np.ndarray:
    """How many values each two rows share; ``row`` tells whose each value is. Columns go by
    strips: memory must not follow the length of the texts."""
    _, place, often = np.unique(values, return_inverse=True, return_counts=True)
    several = often[place] > 1  # what only one row has is in no intersection
    kept, column = np.unique(place[several], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[several][order], column[order]
    common = np.zeros((rows, rows))
    for at in range(0, len(kept), strip):
        part = slice(*np.searchsorted(column, [at, at + strip]))
        held = np.zeros((rows, min(strip, len(kept) - at)), np.float32)
        held[row[part], column[part] - at] = 1
        common += held @ held.T
    return common


def _ragged(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the row of each."""
    whole = lists.combine_chunks()
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return whole.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _needed_in(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * np.add.outer(n, n) // (100 + percent))


def open_pairs(rows: pa.Table, params: JoinParams) -> np.ndarray:
    """Which pairs of the rows of a block are to be verified there: those that pass the length and the
    positional filter and share no rare n-gram of their prefixes, nor a smaller frequent one."""
    gram, first, second = (rows.column(c)[0].as_py() for c in ("gram", "first", "second"))
    n, place = rows.column("n").to_numpy(), rows.column("place").to_numpy()
    found = 100 * np.minimum.outer(n, n) >= params.percent * np.maximum.outer(n, n)
    longest = np.minimum.outer(n - place, n - place) + np.minimum.outer(place, place)
    found &= longest >= _needed_in(n, params.percent)
    np.fill_diagonal(found, False)
    if first != second:
        part = rows.column("part").to_numpy()
        found &= part[:, None] != part[None, :]
    if found.any():
        rare, often = _ragged(rows.column("rare")), _ragged(rows.column("often"))
        smaller = often[0] < gram
        values = np.concatenate([rare[0], often[0][smaller]])
        found &= _common(values, np.concatenate([rare[1], often[1][smaller]]), len(n), params.strip) == 0
    return found


def _joined(rows: pa.Table, params: JoinParams) -> list[tuple[int, int]]:
    """(a, b): ids of a block, each with the smallest it is joined with there."""
    open_ = open_pairs(rows, params)
    n = rows.column("n").to_numpy()
    values, row = _ragged(rows.column("grams"))
    # The suffix filter, as in ``_similar_ranges``.
    ranges = np.zeros((len(n), _RANGES), np.int64)
    np.add.at(ranges, (row, (values.view(np.uint64) >> np.uint64(58)).astype(np.int64)), 1)
    apart = sum(np.abs(np.subtract.outer(c, c)) for c in ranges.T)
    open_ &= apart <= np.add.outer(n, n) - 2 * _needed_in(n, params.percent)
    if not open_.any():
        return []
    common = _common(values, row, len(n), params.strip)
    close = open_ & (100 * common >= params.percent * (np.add.outer(n, n) - common))
    names = rows.column("doc_id").to_numpy()
    return [(int(a), int(b)) for a, b in zip(names, smallest_linked(close, names)) if a != b]


def _block_edges(space: Workspace, held: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): each class of ``held`` with the smallest it is joined with in a block of a frequent n-gram."""
    listed = F.explode(F.arrays_zip("often", "places")).alias("x")
    entries = held.select("id", listed).select("id", F.col("x.often").alias("gram"), F.col("x.places").alias("place"))
    sizes = space.table(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")), "frequent_sizes")
    dealt = into_blocks(entries.join(sizes, "gram"), "id", "docs", params.block)
    columns = ["gram", "first", "second", "part", "id", "place"]

    def opened(rows: pa.Table) -> list[tuple]:
        kept = rows.filter(pa.array(open_pairs(rows, params).any(axis=1)))
        return list(zip(*(kept.column(c).to_pylist() for c in columns)))

    known = dealt.select(columns).join(held.select("id", "n", "rare", "often"), "id")
    found = per_block(known, "gram", opened, pa.schema([(c, pa.int64()) for c in columns]))
    whole = found.join(held.select("id", "doc_id", "n", "rare", "often", "grams"), "id")
    return per_block(whole, "gram", lambda rows: _joined(rows, params), pa.schema([("a", pa.int64()), ("b", pa.int64())])).distinct()
