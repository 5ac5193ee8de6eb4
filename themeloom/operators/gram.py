"""Term co-occurrence (Gram) matrix as cells (i, j, q); cells equal to 0 are absent.

``gram`` gives the cells. ``gram_profile`` gives number, sum and squared length of every row and keeps no
cell; with the products of ``operators.products`` that is all that the search for anchors needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from themeloom.constants import MIN_DOCUMENT_LENGTH
from themeloom.lookup import lookup_join
from themeloom.operators.corpus import corpus_entries
from themeloom.operators.ragged import ragged

DENSE_CELLS = 1 << 24   # cells of a task's dense sum: 128 MB
SPARSE_CELLS = 1 << 22  # cells a task holds at most when the matrix is larger
STRIP_CELLS = 1 << 18   # cells of a dense matrix that cross the network as one row
STRIPE_PAIRS = 1 << 18  # pairs of terms that a tile adds up at once
HOT_PAIRS = 1           # pairs of a row beyond which it may be added up densely
HOT_SHARE = 16          # columns to a pair up to which it is
HOT_CELLS = 1 << 18     # cells that are added up densely at once, or one row's
TILE_ENTRIES = 1 << 23  # entries of one side that a tile holds at most
SIDE_ENTRIES = 1 << 20  # entries of one side that are in a unit
LEAST_UNITS = 8         # units of a side, unless there are fewer entries
UNIT_PLACES = 1 << 16   # terms of a unit at most
TILES_PER_TASK = 4      # tiles for every core: those on the diagonal have half the work
DENSE_ROWS = 1024       # documents multiplied at once
CHUNK_ROWS = 1 << 13    # documents dealt at once
CHUNK_ENTRIES = 1 << 22  # entries from which on fewer are
BATCH_ROWS = 1 << 16


def usable(corpus: DataFrame) -> DataFrame:
    """Documents that add co-occurrences."""
    return corpus.where(F.col("n") >= MIN_DOCUMENT_LENGTH).select("n", "term_ids", "counts")


def gram(
    corpus: DataFrame, terms: int, tasks: int | None = None, dense_cells: int = DENSE_CELLS, dropped: DataFrame | None = None
) -> DataFrame:
    """All cells (i, j, q), but for those of the terms of ``dropped`` (term_id), which are removed in the tasks that add
    them up.

    Over documents of n >= 2 tokens: sum of c_i c_j / (n (n - 1)) off the diagonal and of
    c_i (c_i - 1) / (n (n - 1)) on it. Every task adds its documents into one partial
    matrix and emits that, so the shuffle never carries one row per pair and document.
    Tasks stream their documents, so they may be long: ``tasks`` caps their number and with it
    what crosses the network. By default there is one per core.
    """
    schema, lost = "i INT, j INT, q DOUBLE", None
    if dropped is not None:
        lost = np.zeros(terms, bool)
        lost[dropped.select("term_id").toArrow().column(0).to_numpy()] = True
        lost = corpus.sparkSession.sparkContext.broadcast(lost)
    if terms * terms > dense_cells:
        dealt, blocks = _tiles(corpus, tasks)
        out = lambda blocks: _AllCells(blocks, lost)
        return dealt.mapInArrow(_each_tile(blocks, STRIPE_PAIRS, HOT_PAIRS, out), schema)
    tasks = tasks or corpus.sparkSession.sparkContext.defaultParallelism

    def cells(first: int, total: np.ndarray, terms: int) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total)
        yield from _kept_cells(first + at // terms, at % terms, total[at], lost)

    return _strips(corpus, terms, tasks).mapInArrow(_added_strips(terms, cells), schema)


def _strips(corpus: DataFrame, terms: int, tasks: int) -> DataFrame:
    """Every task's dense matrix in strips of rows; strips of the same rows lie together."""
    strips = usable(corpus).coalesce(tasks).mapInArrow(_dense_partial(terms), "first INT, cells BINARY")
    return strips.repartition("first").sortWithinPartitions("first")


def gram_upper(corpus: DataFrame, terms: int, tasks: int | None = None, sparse_cells: int = SPARSE_CELLS) -> DataFrame:
    """Cells with i <= j, for vocabularies whose matrix does not fit a task: tiles of the matrix as in
    ``gram_profile``, so a cell is made once, is whole where it is made, and does not cross the network."""
    dealt, blocks = _tiles(corpus, tasks)
    return dealt.mapInArrow(_each_tile(blocks, min(sparse_cells, STRIPE_PAIRS), HOT_PAIRS, _UpperCells), "i INT, j INT, q DOUBLE")


def mirrored(upper: DataFrame) -> DataFrame:
    """All cells of the symmetric matrix."""
    cell = F.struct("i", "j", "q")
    twin = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "q")
    cells = F.when(F.col("i") < F.col("j"), F.array(cell, twin)).otherwise(F.array(cell))
    return upper.select(F.explode(cells).alias("c")).select("c.*")


def gram_profile(
    corpus: DataFrame,
    terms: int,
    stripe_pairs: int = STRIPE_PAIRS,
    hot_pairs: int = HOT_PAIRS,
    dense_cells: int = DENSE_CELLS,
    tile_entries: int = TILE_ENTRIES,
) -> DataFrame:
    """(i, cells, s, r): number, sum and squared length of the cells of every row that has any. A matrix of up
    to ``dense_cells`` is added up as in ``gram``. A larger one is never there as a whole:

    Terms are dealt to B blocks by their id, and the matrix falls into tiles of two blocks, of which
    symmetry leaves B (B + 1) / 2. A tile reads from every document the entries of its two blocks, so an
    entry is read B times, not once for every other term of its document, but shuffled once; the sums of a term are
    sent B times. The task of a tile splits either side to units of neighbouring terms, adds up the cells of two units
    some rows at a time and keeps three numbers per row and column: no cell
    crosses the network and none is stored. Blocks are as few as give every core some tiles and keep a block
    below ``tile_entries``.

    ``stripe_pairs`` are the pairs of terms that are added up at once; rows of a unit with more than
    ``hot_pairs``, and enough for the other unit's terms, are added up densely, the others as sorted cells.
    """
    schema = "i INT, cells BIGINT, s DOUBLE, r DOUBLE"
    if terms * terms <= dense_cells:
        tasks = corpus.sparkSession.sparkContext.defaultParallelism
        return _strips(corpus, terms, tasks).mapInArrow(_added_strips(terms, _strip_profile), schema)
    dealt, blocks = _tiles(corpus, tile_entries=tile_entries)
    partial = dealt.mapInArrow(_each_tile(blocks, stripe_pairs, hot_pairs, _Profile), schema)
    return partial.groupBy("i").agg(F.sum("cells").alias("cells"), F.sum("s").alias("s"), F.sum("r").alias("r"))


def _tiles(corpus: DataFrame, tasks: int | None = None, tile_entries: int = TILE_ENTRIES) -> tuple[DataFrame, int]:
    """The documents dealt to tiles of the matrix, one task each, and the number of blocks of terms. Entries are
    shuffled once, to their blocks; the tasks of all tiles of a block read it from there."""
    entries = usable(corpus).agg(F.sum(F.size("term_ids"))).first()[0] or 0
    if not tasks:
        tasks = corpus.sparkSession.sparkContext.defaultParallelism * min(TILES_PER_TASK, 1 + entries // SIDE_ENTRIES)
    # So many blocks that their tiles, with the diagonal, are as many as the tasks.
    blocks = max(math.ceil((math.sqrt(8 * tasks + 1) - 1) / 2), math.ceil(entries / tile_entries))
    packed = usable(corpus).mapInArrow(_pack(blocks), _PACKED).repartitionById(blocks, F.col("block"))
    sides = [packed.select(*[F.col(c).alias(f"{side}_{c}") for c in _PACKED_NAMES]) for side in ("left", "right")]
    # A product, partition by partition, of what was shuffled: as a join by chunks each tile would be shuffled again.
    # All columns are compared or used on both sides, so that there is one shuffle.
    same = (F.col("left_chunk") == F.col("right_chunk")) & (F.col("left_lengths") == F.col("right_lengths"))
    together = sides[0].hint("shuffle_replicate_nl").join(sides[1], same & (F.col("left_block") <= F.col("right_block")))
    other = F.col("left_block") < F.col("right_block")
    tile = (F.expr("right_block * (right_block + 1) div 2") + F.col("left_block")).cast("int")
    columns = [F.when(other, F.col(c)).otherwise(F.lit(b"")).alias(c) if c.startswith("right") else F.col(c) for c in _DEALT[2:]]
    # What else is known of whole documents is for the diagonal alone.
    lengths = F.when(other, F.expr("substring(left_lengths, 1, octet_length(left_lengths) div 4)")).otherwise(F.col("left_lengths"))
    return together.select(tile.alias("tile"), lengths.alias("lengths"), *columns), blocks


def gram_rows(corpus: DataFrame, terms: int, picks: list[int]) -> DataFrame:
    """The cells (i, j, q) of some rows: tasks add up their documents' first."""
    partial = usable(corpus).mapInArrow(_some_rows(terms, picks), "i INT, j INT, q DOUBLE")
    return partial.groupBy("i", "j").agg(F.sum("q").alias("q"))


def profile_of(cells: DataFrame) -> DataFrame:
    """The same from cells that are there already."""
    return cells.groupBy("i").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("r")
    )


def normalised_norms(profile: DataFrame) -> DataFrame:
    """(i, r): squared length of the rows divided by their sums."""
    return profile.select("i", (F.col("r") / (F.col("s") * F.col("s"))).alias("r"))


def gram_row_sums(corpus: DataFrame) -> DataFrame:
    """(term_id, s): row sums of the Gram matrix, which need no Gram matrix: sum of c / n
    over documents of n >= 2 tokens. A term without such a document is absent."""
    usable = corpus.where(F.col("n") >= MIN_DOCUMENT_LENGTH)
    share = F.zip_with("term_ids", "counts", lambda t, c: F.struct(t.alias("term_id"), (c / F.col("n")).alias("s")))
    return (
        usable.select(F.inline(share)).groupBy("term_id").agg(F.sum("s").alias("s"))
    )


def term_sums(corpus: DataFrame) -> DataFrame:
    """(term_id, s, total): row sums of the Gram matrix and tokens of each term, from one
    read of the corpus. ``s`` is null for a term without co-occurrences."""
    share = F.when(F.col("n") >= MIN_DOCUMENT_LENGTH, F.col("cnt") / F.col("n"))
    return (
        corpus_entries(corpus, "n")
        .groupBy("term_id")
        .agg(F.sum(share).alias("s"), F.sum("cnt").alias("total"))
    )


def normalised_gram(cells: DataFrame, row_sums: DataFrame, terms: int) -> DataFrame:
    """Rows of the matrix divided by their sums."""
    sums = row_sums.select(F.col("term_id").alias("i"), "s")
    joined = lookup_join(cells, sums, "i", 16 * terms, spread="j")
    return joined.select("i", "j", (F.col("q") / F.col("s")).alias("q"))


Partial = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Documents:
    """Documents of a batch, their entries one after the other: ``ids``, ``counts``, ``doc`` (row of
    each entry), ``starts`` and ``pairs`` = n (n - 1) per document."""

    def __init__(self, batch: pa.RecordBatch):
        ids, starts = ragged(batch.column("term_ids"))
        counts, _ = ragged(batch.column("counts"))
        n = batch.column("n").to_numpy()
        self.ids, self.counts = ids[starts[0] : starts[-1]].astype(np.int64), counts[starts[0] : starts[-1]]
        self.starts, self.pairs = (starts - starts[0]).astype(np.int64), n * (n - 1.0)
        self.doc = np.repeat(np.arange(len(n)), np.diff(self.starts))

    def cells(self, ours: np.ndarray, terms: int, upper: bool, most: int = SPARSE_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Key i terms + j and value of the pairs of the entries at the places ``ours`` with all entries of
        their documents (``upper``: with those from their own on), ``most`` at a time or one entry's."""
        first = ours if upper else self.starts[self.doc[ours]]
        size = self.starts[self.doc[ours] + 1] - first
        ends = np.cumsum(size)
        at = 0
        while at < len(ours):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            part = size[at:stop]
            left = np.repeat(ours[at:stop], part)
            right = np.arange(len(left)) - np.repeat(ends[at:stop] - part - done, part) + np.repeat(first[at:stop], part)
            value = self.counts[left] * (self.counts[right] - (left == right)) / self.pairs[self.doc[left]]
            yield self.ids[left] * terms + self.ids[right], value
            at = stop


class _Sums:
    """Cells summed so far, sorted by key; new ones wait until there are ``limit``."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.empty(0, np.int64), np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.new.append((keys, values))
        self.waiting += len(keys)
        if self.waiting >= self.limit:
            self.merge()

    def merge(self) -> None:
        keys, values = (np.concatenate(c) for c in zip((self.keys, self.values), *self.new))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(values, first) if len(first) else values
        kept = sums != 0.0
        self.keys, self.values = keys[first][kept], sums[kept]
        self.new, self.waiting = [], 0


def _cells(keys: np.ndarray, values: np.ndarray, terms: int) -> Iterator[pa.RecordBatch]:
    yield from _kept_cells(keys // terms, keys % terms, values, None)


def _kept_cells(i: np.ndarray, j: np.ndarray, values: np.ndarray, lost: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Cells whose terms are both not marked in ``lost``."""
    if lost is not None:
        kept = np.flatnonzero(~(lost.value[i] | lost.value[j]))
        i, j, values = i[kept], j[kept], values[kept]
    i, j = i.astype(np.int32), j.astype(np.int32)
    for at in range(0, len(values), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (i, j, values)], names=["i", "j", "q"])


def _dense_partial(terms: int) -> Partial:
    """The task's matrix, in strips of rows."""
    rows = max(1, STRIP_CELLS // terms)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, diagonal, seen = np.zeros((terms, terms)), np.zeros(terms), False
        for batch in batches:
            for at in range(0, batch.num_rows, DENSE_ROWS):
                docs, seen = Documents(batch.slice(at, DENSE_ROWS)), True
                dense = np.zeros((len(docs.pairs), terms))
                dense[docs.doc, docs.ids] = docs.counts
                total += dense.T @ (dense / docs.pairs[:, None])
                # Apart, so that what cancels is exactly 0.
                own = docs.counts * (docs.counts - 1.0) / docs.pairs[docs.doc]
                diagonal += np.bincount(docs.ids, own, minlength=terms)
        np.fill_diagonal(total, diagonal)
        for at in range(0, terms if seen else 0, rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([total[at : at + rows].tobytes()], pa.binary())], names=["first", "cells"]
            )

    return add


def _added_strips(terms: int, out: Callable[[int, np.ndarray, int], Iterator[pa.RecordBatch]]) -> Partial:
    """What ``out`` makes of each strip, added up over the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_strip, total = -1, np.empty(0)
        for batch in batches:
            for first, raw in zip(batch.column("first").to_pylist(), batch.column("cells")):
                values = np.frombuffer(raw.as_buffer())
                if first == open_strip:
                    total = total + values
                    continue
                yield from out(open_strip, total, terms)
                open_strip, total = first, values
        yield from out(open_strip, total, terms)

    return add


def _strip_profile(first: int, total: np.ndarray, terms: int) -> Iterator[pa.RecordBatch]:
    rows = total.reshape(-1, terms)
    cells = np.count_nonzero(rows, axis=1)
    some = np.flatnonzero(cells)
    columns = (first + some).astype(np.int32), cells[some], rows.sum(axis=1)[some], np.square(rows).sum(axis=1)[some]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "cells", "s", "r"])


def _some_rows(terms: int, picks: list[int]) -> Partial:
    """Partial cells of some rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(SPARSE_CELLS)
        for batch in batches:
            docs = Documents(batch)
            for keys, values in docs.cells(np.flatnonzero(np.isin(docs.ids, picks)), terms, False):
                sums.add(keys, values)
                if len(sums.keys) >= SPARSE_CELLS:
                    yield from _cells(sums.keys, sums.values, terms)
                    sums.clear()
        sums.merge()
        yield from _cells(sums.keys, sums.values, terms)

    return add


_PACKED = "chunk BIGINT, block INT, lengths BINARY, sizes BINARY, ids BINARY, counts BINARY"
_DEALT = "tile", "lengths", "left_sizes", "left_ids", "left_counts", "right_sizes", "right_ids", "right_counts"


def _pack(blocks: int) -> Partial:
    """A row per block and batch of documents, with the entries of the block. ``lengths`` are those of the documents, then
    number, sum and sum of squares of all their counts. Ids are places in their block, sent as steps
    from one entry to the next, the first bytes of all steps, then the second ones, and so on, which Spark compresses
    well. The rows of a batch have the same ``chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in enumerate(_gathered(batches), TaskContext.get().partitionId() << 32):
            docs = Documents(part)
            held = [np.bincount(docs.doc, v, minlength=len(docs.pairs)) for v in (None, docs.counts, docs.counts**2)]
            lengths = b"".join(_planes(v.astype(np.float64)) for v in (part.column("n").to_numpy(), *held))
            block = docs.ids % blocks
            for b in range(blocks):
                ours = np.flatnonzero(block == b)
                sizes = np.bincount(docs.doc[ours], minlength=len(docs.pairs)).astype(np.int32)
                steps = np.diff(docs.ids[ours] // blocks, prepend=0).astype(np.int32)
                row = [chunk, b, lengths, _planes(sizes), _planes(steps), _small(docs.counts[ours]).tobytes()]
                kinds = pa.int64(), pa.int32(), *[pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=_PACKED_NAMES)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same documents in batches of ``CHUNK_ROWS``, or fewer where they are long, whatever the session's batches have: tiles
    compare all chunks of two blocks."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            held.append(part)
            rows, entries = rows + part.num_rows, entries + len(part.column("term_ids").flatten())
            if rows >= CHUNK_ROWS or entries >= CHUNK_ENTRIES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows, entries = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _small(counts: np.ndarray) -> np.ndarray:
    """In one or two bytes each where all counts are whole and that small."""
    whole = bool((counts == np.floor(counts)).all())
    return counts.astype(next((k for k in _SMALL if whole and counts.max(initial=0.0) <= np.iinfo(k).max), np.float64))


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _joined_planes(planes: bytes, kind: type = np.int32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


_SMALL = np.uint8, np.uint16
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


@dataclass
class _Part:
    """Entries of a block in some documents, document after document: ``sizes`` of these, ``ids`` in the block, ``counts``."""

    sizes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(sizes: bytes, planes: bytes, packed: bytes) -> _Part:
        kinds = {np.dtype(k).itemsize: k for k in (*_SMALL, np.float64)}
        counts = np.frombuffer(packed, kinds[4 * len(packed) // max(1, len(planes)) or 1])
        return _Part(_joined_planes(sizes), np.cumsum(_joined_planes(planes), dtype=np.int32), counts)


@dataclass
class _Unit:
    """Entries of ``places`` neighbouring terms of a block from ``first`` on, document after document: ``sizes`` of the
    documents, ``ids`` from ``first`` on, ``counts``."""

    block: int
    first: int
    places: int
    sizes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    @staticmethod
    def split(block: int, parts: list[_Part], most: int, apart: bool = False) -> tuple[list[_Unit], _Single]:
        """Of up to ``most`` entries, or one term's; ``apart``: terms of one document are given apart. Neighbours are about as
        frequent as each other where ids go by frequency. Takes ``parts`` away."""
        held = np.zeros(1 + max((int(p.ids.max(initial=0)) for p in parts), default=0), np.int64)
        for p in parts:
            held[: int(p.ids.max(initial=0)) + 1] += np.bincount(p.ids, minlength=1)
        single = (held == 1) & apart
        held = np.trim_zeros(np.where(single, 0, held), "b")
        ends, cuts, alone, before = np.cumsum(held), [0], ([], [], []), 0
        most = min(most, max(1, held.sum() // LEAST_UNITS))
        while cuts[-1] < len(held):
            done = ends[cuts[-1] - 1] if cuts[-1] else 0
            stop = min(cuts[-1] + UNIT_PLACES, int(np.searchsorted(ends, done + most, "right")))
            cuts.append(min(len(held), max(cuts[-1] + 1, stop)))
        found = [([], [], []) for _ in cuts[1:]]
        parts.reverse()
        while parts:
            part = parts.pop()
            doc = np.repeat(np.arange(len(part.sizes)), part.sizes)
            if apart:
                ours = single[part.ids]
                for c, v in zip(alone, (part.ids, doc + before, part.counts)):
                    c.append(v[ours])
                doc, part.ids, part.counts = doc[~ours], part.ids[~ours], part.counts[~ours]
            before += len(part.sizes)
            for columns, first, end in zip(found, cuts, cuts[1:]):
                ours = np.flatnonzero((part.ids >= first) & (part.ids < end))
                columns[0].append(_narrow(np.bincount(doc[ours], minlength=len(part.sizes))))
                columns[1].append((part.ids[ours] - first).astype(np.uint16))
                columns[2].append(part.counts[ours])
        units = []
        for columns, first, end in zip(found, cuts, cuts[1:]):
            units.append(_Unit(block, first, end - first, *(np.concatenate(c) for c in columns)))
            for c in columns:
                c.clear()
        return units, _Single(block, *(np.concatenate(c) if c else np.empty(0, np.int64) for c in alone))


@dataclass
class _Single:
    """Entries of the terms of a block that one document has each: ``ids``, ``doc``, ``counts``."""

    block: int
    ids: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def _narrow(values: np.ndarray) -> np.ndarray:
    most = values.max(initial=0)
    return values.astype(next((k for k in _SMALL if most <= np.iinfo(k).max), np.int32))


def _each_tile(blocks: int, pairs: int, hot_pairs: int, out: Callable[[int], _Out], most: int = SIDE_ENTRIES) -> Partial:
    """A task has the documents of one tile; what ``out`` makes of its cells. Either side is split to units of some terms,
    which are taken in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, lengths, held, parts = -1, [], [], ([], [])
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tile = row["tile"]
                known = np.frombuffer(row["lengths"], np.uint8).reshape(-1, 2 * len(row["left_sizes"]))
                lengths.append(_joined_planes(known[0], np.float64))
                held.append(np.array([_joined_planes(k, np.float64) for k in known[1:]]))
                for side, name in zip(parts, ("left", "right")):
                    side.append(_Part.of(*(row[f"{name}_{c}"] for c in ("sizes", "ids", "counts"))))
        if tile < 0:
            return
        del batch, row
        right = (math.isqrt(8 * tile + 1) - 1) // 2
        left = tile - right * (right + 1) // 2
        lengths = np.concatenate(lengths)
        weight, kept = 1.0 / (lengths * (lengths - 1.0)), out(blocks)
        ours, single = _Unit.split(left, parts[0], most, kept.APART)
        theirs, other_single = (ours, single) if left == right else _Unit.split(right, parts[1], most, kept.APART)
        if kept.APART:
            kept.crossed(single, theirs, weight)
            if left != right:
                kept.crossed(other_single, ours, weight)
            else:
                kept.alone(single, weight, np.concatenate(held, axis=1))
        del held
        # Of two units the one with more terms, which are rarer, gives the rows: its documents have longer runs of the other's.
        for k, unit in enumerate(ours):
            rows = _Rows(unit, weight)
            for j, other in enumerate(theirs):
                if j <= k if left == right else other.places <= unit.places:
                    yield from rows.times(other, pairs, hot_pairs, kept)
        if left != right:
            for unit in theirs:
                rows = _Rows(unit, weight)
                for other in ours:
                    if other.places < unit.places:
                        yield from rows.times(other, pairs, hot_pairs, kept)
        yield from kept.close()

    return run


class _Rows:
    """Entries of a unit term by term: ``ids``, ``doc``, ``value`` = count times weight of the document, ``order`` = place
    of each in the unit."""

    def __init__(self, unit: _Unit, weight: np.ndarray):
        self.unit = unit
        self.order, self.ids = _sorted_keys(unit.ids.astype(np.int64), unit.places)
        self.doc = np.repeat(np.arange(len(unit.sizes), dtype=np.int32), unit.sizes)[self.order]
        self.value = unit.counts[self.order] * weight[self.doc]

    def times(self, other: _Unit, pairs: int, hot_pairs: int, out: _Out) -> Iterator[pa.RecordBatch]:
        """Cells of these terms with those of ``other``, ``pairs`` at a time or one row's."""
        unit, same = self.unit, other is self.unit
        size = other.sizes[self.doc]
        some = np.flatnonzero(size)
        size, ids, value = size[some].astype(np.int64), self.ids[some], self.value[some]
        ends = np.cumsum(other.sizes, dtype=np.int64)
        doc = self.doc[some]
        start = ends[doc] - size
        order = self.order[some] if same else None
        load = np.bincount(ids, size, minlength=unit.places).astype(np.int64)
        dense = (load > hot_pairs) & (HOT_SHARE * load > other.places)
        for hot, names in ((True, np.flatnonzero(dense)), (False, np.flatnonzero((load > 0) & ~dense))):
            if not len(names):
                continue
            ours = np.flatnonzero(dense[ids] == hot)
            entries = size[ours], start[ours], value[ours], order[ours] if same else None
            edge = np.append(np.searchsorted(ids[ours], names), len(ours))
            loads, at = np.cumsum(load[names]), 0
            while at < len(names):
                done = loads[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(loads, done + pairs, "right")))
                if hot:
                    stop = min(stop, at + max(1, HOT_CELLS // other.places))
                row = np.repeat(np.arange(stop - at) * other.places, np.diff(edge[at : stop + 1]))
                part = slice(edge[at], edge[stop])
                found = _pairs(other, row, *(None if e is None else e[part] for e in entries), pairs)
                place = Cells(unit.block, unit.first + names[at:stop], other.block, other.first, other.places, same)
                if hot:
                    total = np.zeros((stop - at) * other.places)
                    for key, part in found:
                        total += np.bincount(key, part, minlength=len(total))
                    yield from out.dense(place, total.reshape(stop - at, other.places))
                else:
                    key, part = (c[0] if len(c) == 1 else np.concatenate(c) for c in zip(*found))
                    yield from out.sorted(place, *_sorted_cells(key, part, (stop - at) * other.places))
                at = stop


def _pairs(other: _Unit, row, size, start, value, order, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries with all those of ``other`` in the same document, ``size`` from ``start`` on, about ``most`` at a time:
    key ``row`` plus column, and value. ``order`` is the entry's own place, if it is one of them."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        ours = slice(at, stop)
        which = np.repeat(np.arange(stop - at), size[ours])
        place = (start[ours] - (ends[ours] - size[ours] - done)).take(which)
        place += np.arange(len(place))
        counts = other.counts.take(place)
        if order is not None:
            # Apart, so that what cancels is exactly 0.
            counts = counts - (order[ours].take(which) == place)
        key, part = row[ours].take(which), value[ours].take(which)
        key += other.ids.take(place)
        part *= counts
        yield key, part
        at = stop


def _sorted_keys(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys below ``size``, and the keys in it."""
    bits = len(key).bit_length()
    if size << bits < 1 << 62:  # key and place as one number: sorted faster than by an order
        order = (key << bits) + np.arange(len(key))
        order.sort()
        key = order >> bits
        order &= (1 << bits) - 1
        return order, key
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _sorted_cells(key: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    order, key = _sorted_keys(key, size)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(value[order], first)
    some = np.flatnonzero(total)
    return key[first][some], total[some]


@dataclass
class Cells:
    """Where cells lie: the places ``rows`` of the block ``left`` times ``columns`` places from ``first`` on of the block
    ``right``. ``square``: both are the same terms, and all their cells are there; otherwise the mirrored cells are not."""

    left: int
    rows: np.ndarray
    right: int
    first: int
    columns: int
    square: bool


class _Out:
    """What becomes of the cells of a task. ``APART``: cells of terms of one document are not given."""

    APART = False

    def __init__(self, blocks: int):
        self.blocks = blocks

    def dense(self, place: Cells, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole rows."""
        raise NotImplementedError

    def sorted(self, place: Cells, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Cells that are not 0, in order: number of the row times columns plus column, and value."""
        raise NotImplementedError

    def close(self) -> Iterator[pa.RecordBatch]:
        """What is left to say after the last cells."""
        yield from ()


class _UpperCells(_Out):
    """The cells with i <= j."""

    def dense(self, place: Cells, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.flatnonzero(cells.ravel() != 0.0)
        yield from self.sorted(place, keys, cells.ravel()[keys])

    def sorted(self, place: Cells, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = keys // place.columns
        i = place.rows[row] * self.blocks + place.left
        j = (place.first + keys - row * place.columns) * self.blocks + place.right
        if place.square:
            upper = i <= j
            i, j, values = i[upper], j[upper], values[upper]
        yield from _kept_cells(np.minimum(i, j), np.maximum(i, j), values, None)


class _AllCells(_Out):
    """All cells but those of the terms that are marked in ``lost``."""

    def __init__(self, blocks: int, lost: Broadcast | None):
        super().__init__(blocks)
        self.lost = lost

    def _kept(self, place: Cells) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the rows and of the columns: terms, and which of them are kept."""
        columns = np.arange(place.first, place.first + place.columns)
        terms = place.rows * self.blocks + place.left, columns * self.blocks + place.right
        return [(t, np.ones(len(t), bool) if self.lost is None else ~self.lost.value[t]) for t in terms]

    def dense(self, place: Cells, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        (i, rows), (j, columns) = self._kept(place)
        cells = cells[rows][:, columns]
        row, column = np.nonzero(cells)
        yield from self._both(place, i[rows][row], j[columns][column], cells[row, column])

    def sorted(self, place: Cells, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        (i, rows), (j, columns) = self._kept(place)
        row = keys // place.columns
        column = keys - row * place.columns
        kept = np.flatnonzero(rows[row] & columns[column])
        yield from self._both(place, i[row[kept]], j[column[kept]], values[kept])

    def _both(self, place: Cells, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _kept_cells(i, j, values, None)
        if not place.square:
            yield from _kept_cells(j, i, values, None)


class _Profile(_Out):
    """Number, sum and squared length of the cells of every row and, but for squares, of every column.

    A term of one document has this document's entries as cells, so the row follows from the document, and what
    such terms add to another term's row follows from their number, sum and sum of squares in each document."""

    APART = True

    def __init__(self, blocks: int):
        super().__init__(blocks)
        self.sums: dict[int, np.ndarray] = {}

    def _of(self, block: int, places: int) -> np.ndarray:
        held = self.sums.get(block, np.zeros((3, 0)))
        if held.shape[1] < places:
            held = self.sums[block] = np.pad(held, ((0, 0), (0, places - held.shape[1])))
        return held

    def alone(self, single: _Single, weight: np.ndarray, held: np.ndarray) -> None:
        """The whole rows of terms of one document; ``held``: number, sum and sum of squares of its counts."""
        if len(single.ids):
            c, (cells, total, squares) = single.counts.astype(np.float64), held[:, single.doc]
            value = c * weight[single.doc]
            found = cells - (c == 1.0), value * (total - 1.0), value * value * (squares - c * c + (c - 1.0) * (c - 1.0))
            self._of(single.block, int(single.ids.max()) + 1)[:, single.ids] += found

    def crossed(self, single: _Single, units: list[_Unit], weight: np.ndarray) -> None:
        """What terms of one document add to the rows of others."""
        if not len(single.ids):
            return
        c = single.counts.astype(np.float64)
        held = [np.bincount(single.doc, v, minlength=len(weight)) for v in (None, c, c * c)]
        for unit in units:
            doc = np.repeat(np.arange(len(unit.sizes), dtype=np.int32), unit.sizes)
            ours = np.flatnonzero(held[0][doc])
            doc, ids = doc[ours], unit.ids[ours]
            value, end = unit.counts[ours] * weight[doc], unit.first + unit.places
            for k, v in enumerate((held[0][doc], value * held[1][doc], value * value * held[2][doc])):
                self._of(unit.block, end)[k, unit.first : end] += np.bincount(ids, v, minlength=unit.places)

    def dense(self, place: Cells, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Ones times a matrix: numbers below 2^24 are exact.
        for k, v in enumerate(((cells != 0.0).astype(np.float32), cells, cells * cells)):
            self._of(place.left, int(place.rows[-1]) + 1)[k, place.rows] += v @ np.ones(v.shape[1], v.dtype)
            if not place.square:
                end = place.first + place.columns
                self._of(place.right, end)[k, place.first : end] += np.ones(len(v), v.dtype) @ v
        yield from ()

    def sorted(self, place: Cells, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = keys // place.columns
        column, end = keys - row * place.columns, place.first + place.columns
        for k, v in enumerate((None, values, values * values)):
            self._of(place.left, int(place.rows[-1]) + 1)[k, place.rows] += np.bincount(row, v, minlength=len(place.rows))
            if not place.square:
                self._of(place.right, end)[k, place.first : end] += np.bincount(column, v, minlength=place.columns)
        yield from ()

    def close(self) -> Iterator[pa.RecordBatch]:
        for block, total in self.sums.items():
            some = np.flatnonzero(total[0])
            for start in range(0, len(some), BATCH_ROWS):
                part = some[start : start + BATCH_ROWS]
                cells, s, r = total[:, part]
                columns = (part * self.blocks + block).astype(np.int32), cells.astype(np.int64), s, r
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "cells", "s", "r"])
