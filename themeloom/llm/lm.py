"""Bigram scores from a log-frequency Bloom filter.

Counts of words and word pairs are taken over all training documents and quantised to levels, a
level for each doubling. The filter holds one entry per n-gram and level up to its own, so a
count is read by probing level after level until one misses. All n-grams are in it, down to
those seen once. It is built once, from training counts alone, in ranges of hashes: each has the
bits that its entries need, and more text makes more ranges, not larger ones.

While all ranges together are within ``broadcast_bytes``, by a bound on their size, they go to the
workers, and a document is scored where it is read. Beyond that texts are stored in packed chunks. A
chunk sends its distinct n-grams once, with their training counts: its range builds the filter from
them and tells each chunk their levels, with which it is scored. Both ways probe the same filter,
so the scores are the same.

A level stands for the mean count of its words, or its pairs, in training. So the words' own
probabilities sum to 1 over all words and the unseen one. A pair counts no more than either of
its words, which also keeps a false entry from raising the count of a pair with an unseen word.

The exact word counts that the base score needs stay in a table. The frequent ones are sent
along, all others are joined; chunks are told them with the levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.words import hash_words, lower_words, mixed, signed, text_batches
from themeloom.workspace import Workspace

_END = np.uint64(0xE2D0F4C7A5B39186)   # stands for the end of a document, also before its first word
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 64                           # above the level of any count
_SENT = 5                              # bytes of a hash that tell n-grams of a range apart
_KEPT = np.uint64((1 << 8 * _SENT) - 1)
_FLUSH = 1 << 21                       # n-grams that a counting task holds
_CHUNK = 1 << 22                       # bytes of rows that are packed together
_BUCKET = 1 << 27                      # bytes of rows in a bucket of chunks


@dataclass(frozen=True)
class LmParams:
    """``bits`` bounds one range of the filter, ``broadcast_bytes`` the filter that is sent to workers
    as a whole, ``frequent`` the exact counts sent to them.
    ``hashes`` bits are set per entry. ``prior`` is the weight of the word's own probability against
    its count after the word before. A range holds the n-grams of about ``group_bytes`` of text."""

    bits: int = 1 << 27
    hashes: int = 8
    frequent: int = 1 << 18
    prior: float = 20.0
    group_bytes: int = 1 << 24
    broadcast_bytes: int = 1 << 26


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by the end, and where each begins."""
    found = [np.append(hash_words(lower_words(t)), _END) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), starts


def pair_hashes(stream: np.ndarray) -> np.ndarray:
    """An even hash of every token with the one before it."""
    before = np.concatenate([[_END], stream[:-1]]) if len(stream) else stream
    return mixed(before * _ODD + mixed(stream)) & ~np.uint64(1)


def word_hashes(stream: np.ndarray) -> np.ndarray:
    """An odd hash of every token."""
    return mixed(stream + _ODD) | np.uint64(1)


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of a count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7 and so on; 0 for 0."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def _step(level: int) -> np.uint64:
    return np.uint64(level * int(_ODD) % (1 << 64))


@dataclass(frozen=True)
class Filter:
    """``bits`` as bytes; entries start at level ``lowest``. Of several ranges one after the other,
    range r has the bytes from ``starts[r]`` to ``starts[r + 1]``."""

    bits: np.ndarray
    hashes: int
    lowest: int = 1
    starts: np.ndarray | None = None

    @classmethod
    def of(cls, names: np.ndarray, level: np.ndarray, hashes: int) -> Filter:
        """The filter of all levels from 1, with as many bits as its entries need."""
        size = max(1, math.ceil(int(level.sum()) * hashes / math.log(2) / 8))
        whole = cls(np.zeros(size, np.uint8), hashes)
        whole.insert(names, level)
        return whole

    def insert(self, hashes: np.ndarray, level: np.ndarray) -> None:
        size = np.uint64(len(self.bits) * 8)
        flags = np.zeros(int(size), bool)
        for j in range(self.lowest, int(level.max(initial=0)) + 1):
            first = mixed(hashes[level >= j] + _step(j))
            second = mixed(first) | np.uint64(1)
            for _ in range(self.hashes):
                flags[first % size] = True
                first = first + second
        np.bitwise_or(self.bits, np.packbits(flags, bitorder="little"), out=self.bits)

    def level(self, hashes: np.ndarray, ranges: np.ndarray | None = None) -> np.ndarray:
        """The last of the unbroken run of levels that the filter holds; 0 if it holds none.
        ``ranges`` tells the range of each hash."""
        found = np.zeros(len(hashes), np.int64)
        if ranges is None:
            begin, size = np.zeros(len(hashes), np.uint64), np.full(len(hashes), len(self.bits) * 8, np.uint64)
        else:
            begin, size = (self.starts[ranges] * 8).astype(np.uint64), (np.diff(self.starts)[ranges] * 8).astype(np.uint64)
        alive, j = np.flatnonzero(size), self.lowest
        while len(alive) and j < _LEVELS:
            alive = self._holding(hashes, begin, size, alive, j)
            found[alive] = j
            j += 1
        return found

    def _holding(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, alive: np.ndarray, level: int) -> np.ndarray:
        """Those of ``alive`` whose entry of a level has all its bits set; a missing bit ends the search."""
        first = mixed(hashes[alive] + _step(level))
        second = mixed(first) | np.uint64(1)
        for _ in range(self.hashes):
            place = begin[alive] + first % size[alive]
            keep = ((self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            alive, first, second = alive[keep], first[keep] + second[keep], second[keep]
        return alive


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return names, np.bincount(place, np.concatenate(counts), len(names)).astype(np.uint64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): hash and number of every token, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            found, n = np.unique(tokens(batch.column("text").to_pylist())[0], return_counts=True)
            names, counts = _merged([names, found], [counts, n.astype(np.uint64)])
            if len(names) > 1_000_000:
                yield _counted(names, counts)
                names, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        yield _counted(names, counts)

    counted = docs.select("text").mapInArrow(run, "word BIGINT, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(counts.astype(np.int64))], ["word", "n"])


def ngrams(stream: np.ndarray) -> np.ndarray:
    """Hashes of a stream's words, then of its pairs, then of the end, which is before the first word."""
    return np.concatenate([word_hashes(stream), pair_hashes(stream), word_hashes(np.full(1, _END))])


def _shift(groups: int) -> np.uint64:
    return np.uint64(64 - groups.bit_length() + 1)


def _by_range(names: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """The ranges that sorted names fall in, and where each begins and ends."""
    ends = np.searchsorted(names >> _shift(groups), np.arange(groups + 1, dtype=np.uint64)).tolist()
    return [(r, a, b) for r, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]


def _short(names: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SENT])


def _long(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The names in all blobs, and where each blob's begin."""
    parts = [np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, _SENT) for b in blobs]
    ends = np.cumsum([0, *map(len, parts)])
    names = np.zeros((ends[-1], 8), np.uint8)
    names[:, :_SENT] = np.concatenate(parts) if parts else 0
    return names.view("<u8").ravel(), ends


def _built(names: np.ndarray, n: np.ndarray, hashes: int) -> tuple[Filter, tuple[np.ndarray, np.ndarray]]:
    """The filter of n-grams with their counts, and how many of them, with which sum of counts, are on each level."""
    level = levels(n)
    place = level + _LEVELS * (names & np.uint64(1) == 0)
    return Filter.of(names, level, hashes), (np.bincount(place, minlength=2 * _LEVELS), np.bincount(place, n.astype(float), 2 * _LEVELS))


def filter_ranges(docs: DataFrame, groups: int, hashes: int) -> DataFrame:
    """(bucket, bits, entries, total): the filter of the n-grams of all rows (binary ``text``) in a range
    of hashes, and how many of them, with which sum of counts, are on each level: words first, then pairs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            stream, _ = tokens(batch.column("text").to_pylist())
            held.append(np.unique(ngrams(stream)[:-1], return_counts=True))
            size += len(held[-1][0])
            if size > _FLUSH:
                yield cut(held)
                held, size = [], 0
        if size:
            yield cut(held)

    def cut(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names, counts = _merged([h[0] for h in held], [h[1].astype(np.uint64) for h in held])
        short, parts = _short(names), _by_range(names, groups)
        counts = np.ascontiguousarray(counts.astype("<u4"))
        blobs = [pa.array([values[a:b].tobytes() for _, a, b in parts], pa.binary()) for values in (short, counts)]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts], pa.int32()), *blobs], ["bucket", "names", "counts"])

    def build(table: pa.Table) -> pa.Table:
        names, _ = _long(table.column("names"))
        counts = np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for c in table.column("counts")])
        own, (entries, total) = _built(*_merged([names], [counts]), hashes)
        columns = [pa.array([own.bits.tobytes()], pa.binary()), pa.array([entries.tolist()], pa.list_(pa.int64()))]
        return pa.table([table.column("bucket")[:1], *columns, pa.array([total.tolist()], pa.list_(pa.float64()))], names=["bucket", "bits", "entries", "total"])

    sent = docs.select("text").mapInArrow(send, "bucket INT, names BINARY, counts BINARY")
    return sent.groupBy("bucket").applyInArrow(build, "bucket INT, bits BINARY, entries ARRAY<BIGINT>, total ARRAY<DOUBLE>")


def pack_chunks(numbered: DataFrame) -> DataFrame:
    """(chunk, rows): the rows of each task in chunks of about ``_CHUNK`` bytes, compressed, named by the first ``rid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= _CHUNK:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
            for batch in held:
                out.write_batch(batch)
        chunk = pa.array([held[0].column("rid")[0].as_py()], pa.int64())
        return pa.RecordBatch.from_arrays([chunk, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    return numbered.mapInArrow(run, "chunk BIGINT, rows BINARY")


def _unpacked(rows: pa.ChunkedArray) -> pa.Table:
    return pa.ipc.open_stream(rows[0].as_buffer()).read_all()


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers by their bytes: the first bytes of all, then the second ones, and so on, compressed."""
    width = values.dtype.itemsize
    return pa.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _released(blob: bytes, size: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(blob, size * width, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0)).astype("<u8")


def _in_range(names: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Range and the bits that tell n-grams apart there, as one number."""
    return ((names >> shift) << np.uint64(8 * _SENT)) | (names & _KEPT)


def _asked(names: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names, sorted, and how often each occurs in training."""
    order = np.argsort(names)
    names = names[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat(train[order].astype(np.int64), first).astype("<u4")


def find_levels(chunks: DataFrame, groups: int, hashes: int) -> DataFrame:
    """(chunk, bucket, words, pairs, counts, n_words, n_pairs, entries, total): the levels of a chunk's words, asked for by their whole
    hashes, and pairs, by ``_in_range``, and the exact training counts of the words, each in the order of the
    names; once per range also how many n-grams, with which sum of counts, are on each level, as in
    ``filter_ranges``. A range builds its filter from the training counts that the chunks send along."""
    shift = _shift(groups)

    def ask(table: pa.Table) -> pa.Table:
        texts = _unpacked(table.column("rows"))
        stream, starts = tokens(texts.column("text").to_pylist())
        train = np.repeat(np.array(texts.column("train").to_pylist(), bool), np.diff(starts))
        words = _asked(np.append(word_hashes(stream), word_hashes(np.full(1, _END))), np.append(train, False))
        pairs = _asked(_in_range(pair_hashes(stream), shift), train)
        columns = []
        for (names, counts), bits in ((words, shift), (pairs, np.uint64(8 * _SENT))):
            ends = np.searchsorted(names >> bits, np.arange(groups + 1, dtype=np.uint64)).tolist()
            cuts = list(zip(ends, ends[1:]))
            columns.append([b - a for a, b in cuts])
            columns.append([_squeezed(_steps(names[a:b])) for a, b in cuts])
            columns.append([_squeezed(counts[a:b]) for a, b in cuts])
        chunk = table.column("chunk")[0].as_py()
        kept = [r for r in range(groups) if columns[0][r] or columns[3][r]]
        types = [pa.int32(), pa.binary(), pa.binary()] * 2
        named = [pa.array([chunk] * len(kept), pa.int64()), pa.array(kept, pa.int32())]
        return pa.table([*named, *(pa.array([c[r] for r in kept], t) for c, t in zip(columns, types))], names=_ASKS)

    def look(asks: pa.Table) -> pa.Table:
        found = []
        for kind in ("words", "pairs"):
            sizes = asks.column(f"n_{kind}").to_pylist()
            names = [np.cumsum(_released(b, n, "<u8"), dtype=np.uint64) for b, n in zip(asks.column(kind).to_pylist(), sizes)]
            counts = [_released(b, n, "<u4") for b, n in zip(asks.column(f"c_{kind}").to_pylist(), sizes)]
            names, place = np.unique(np.concatenate(names), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts), len(names)).astype(np.uint64)
            found.append((names, place, n, np.cumsum([0, *sizes])))
        known = [(names[n > 0] & _KEPT, n[n > 0]) for names, _, n, _ in found]
        names, n = _merged(*(list(c) for c in zip(*known)))
        own, facts = _built(names, n, hashes)
        columns = [asks.column("chunk"), asks.column("bucket")]
        for names, place, _, ends in found:
            level = own.level(names & _KEPT).astype(np.uint8)[place]
            columns.append(pa.array([_squeezed(level[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()))
        _, place, n, ends = found[0]
        counts = n.astype("<u8")[place]
        columns.append(pa.array([_squeezed(counts[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()))
        rest = [None] * (len(asks) - 1)
        columns += [asks.column("n_words"), asks.column("n_pairs")]
        columns += [pa.array([fact.tolist(), *rest], pa.list_(kind)) for fact, kind in zip(facts, (pa.int64(), pa.float64()))]
        return pa.table(columns, names=_ANSWERS)

    asks = chunks.groupBy("chunk").applyInArrow(
        ask, "chunk BIGINT, bucket INT, n_words INT, words BINARY, c_words BINARY, n_pairs INT, pairs BINARY, c_pairs BINARY"
    )
    return asks.groupBy("bucket").applyInArrow(
        look, "chunk BIGINT, bucket INT, words BINARY, pairs BINARY, counts BINARY, n_words INT, n_pairs INT, entries ARRAY<BIGINT>, total ARRAY<DOUBLE>"
    )


_ASKS = ["chunk", "bucket", "n_words", "words", "c_words", "n_pairs", "pairs", "c_pairs"]
_ANSWERS = ["chunk", "bucket", "words", "pairs", "counts", "n_words", "n_pairs", "entries", "total"]


class Answers:
    """What the ranges have told a chunk."""

    def __init__(self, table: pa.Table, shift: np.uint64):
        table, self.shift = table.sort_by("bucket"), shift
        columns = ("words", "n_words", "u1"), ("pairs", "n_pairs", "u1"), ("counts", "n_words", "<u8")
        self.words, self.pairs, self.counts = (
            np.concatenate([_released(b, n, kind) for b, n in zip(table.column(c).to_pylist(), table.column(size).to_pylist())])
            for c, size, kind in columns
        )

    def levels(self, names: np.ndarray) -> np.ndarray:
        """Of all n-grams of the chunk, sorted."""
        level, word = np.zeros(len(names), np.int64), (names & np.uint64(1)).astype(bool)
        level[word], self.names = self.words, names[word]
        level[~word] = self.pairs[np.unique(_in_range(names[~word], self.shift), return_inverse=True)[1]]
        return level

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Training counts of some words of the chunk, once ``levels`` has seen its names."""
        return self.counts[np.searchsorted(self.names, word_hashes(words))].astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """The exact ``counts`` of the ``frequent`` words (sorted hashes), what all words sum to, and the
    mean count of each level: of words in ``means[0]``, of pairs in ``means[1]``."""

    frequent: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    prior: float
    means: np.ndarray

    def probabilities(self, stream: np.ndarray, read: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 probability of every token after the one before it: its count there and its own
        probability, weighed by how often the word before was seen. All counts come from the
        filter: ``read`` tells the levels of sorted names."""
        names, place = np.unique(ngrams(stream), return_inverse=True)
        level, size = read(names)[place], len(stream)
        seen = self.means[0][level[:size]]
        before = np.concatenate([self.means[0][level[-1:]], seen[:-1]])
        own = (seen + 1) / (self.tokens + self.types + 1)
        # As in the texts, a pair occurs no more often than its words.
        both = np.minimum(self.means[1][level[size : 2 * size]], np.minimum(before, seen))
        return np.log10((both + self.prior * own) / (before + self.prior))

    def scored(
        self,
        texts: pa.Table | pa.RecordBatch,
        read: Callable[[np.ndarray], np.ndarray],
        exact: Callable[[np.ndarray], np.ndarray] | None = None,
    ) -> list[pa.Array]:
        """doc_id, rid, n_tokens, n_known, base, score and tail (the words that are not frequent, with their
        counts where ``exact`` tells them) of each text."""
        stream, starts = tokens(texts.column("text").to_pylist())
        ends, score = starts[:-1], self.probabilities(stream, read)
        found = np.searchsorted(self.frequent, stream)
        found[found == len(self.frequent)] = 0
        known = self.frequent[found] == stream if len(self.frequent) else np.zeros(len(stream), bool)
        counts = self.counts[found[known]] if len(self.frequent) else np.zeros(0)
        base = np.zeros(len(stream))
        base[known] = np.log10((counts + 1) / (self.tokens + self.types + 1))
        doc = np.repeat(np.arange(len(ends)), np.diff(starts))[~known]
        order = np.lexsort((stream[~known], doc))
        doc, rest = doc[order], stream[~known][order]
        new = np.ones(len(rest), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(rest)))
        n = pa.nulls(len(first), pa.int64()) if exact is None else pa.array(exact(rest[first]))
        tail = pa.StructArray.from_arrays([pa.array(signed(rest[first])), pa.array(times.astype(np.int64)), n], fields=list(_TAIL))
        cuts = np.searchsorted(doc[first], np.arange(len(ends) + 1))
        add = lambda values: np.add.reduceat(values, ends) if len(ends) else np.zeros(0)
        return [
            texts.column("doc_id"),
            texts.column("rid"),
            pa.array(np.diff(starts)),
            pa.array(add(known.astype(np.int64)).astype(np.int64)),
            pa.array(add(base)),
            pa.array(add(score)),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), tail),
        ]


_TAIL = pa.struct([("word", pa.int64()), ("m", pa.int64()), ("n", pa.int64())])
_SCORED = ["doc_id", "rid", "n_tokens", "n_known", "base", "score", "tail"]


def level_means(table: DataFrame) -> np.ndarray:
    """The mean count of each level, of words and of pairs, from the ranges' ``entries`` and ``total``."""
    means = np.zeros(2 * _LEVELS)
    per_level = table.select(F.posexplode(F.arrays_zip("entries", "total")).alias("place", "x")).groupBy("place")
    for r in per_level.agg(F.sum("x.entries").alias("entries"), F.sum("x.total").alias("total")).where("entries > 0").collect():
        means[r["place"]] = r["total"] / r["entries"]
    return means.reshape(2, _LEVELS)


def frequent_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and exact counts from the lowest level that leaves no more than ``most`` words."""
    level = F.length(F.bin("n"))
    n_of = {r["level"]: r["n"] for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = next(j for j in range(1, 72) if sum(n for k, n in n_of.items() if k >= j) <= most)
    head = words.where(level >= least).toPandas()
    names = head["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], head["n"].to_numpy(np.int64)[order]


def whole_filter(ranges: DataFrame, groups: int, hashes: int) -> Filter:
    """All ranges in the driver: for a filter whose size was measured before."""
    parts = {r["bucket"]: r["bits"] for r in ranges.select("bucket", "bits").collect()}
    starts = np.cumsum([0, *(len(parts.get(r, b"")) for r in range(groups))])
    return Filter(np.frombuffer(b"".join(parts[r] for r in sorted(parts)), np.uint8), hashes, 1, starts)


def lm_scores(
    space: Workspace, docs: DataFrame, training, params: LmParams = LmParams(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is the condition that training rows meet. A null or empty text is its end alone.
    Repeated rows are scored, and counted, each. An empty table gives no rows; without training rows
    nothing is known and every count is 0.
    A probe of an n-gram that was not seen finds an entry with a chance of 2 to the power of minus ``hashes``.
    ``docs`` is read more than once: store it first if its rows change from one reading to the next.
    """
    space = space.part()
    docs = text_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), training.alias("train"))
    docs = docs.withColumn("train", F.coalesce("train", F.lit(False)))
    own, hashes = docs.where("train"), params.hashes
    words = space.table(count_words(own), "words")
    facts = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.length(F.bin("n")))).first()
    total, known_types = facts[0] or 0, facts[1]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # of all texts: they are looked up too
    # An n-gram has no more levels than its count, so a token makes two entries at most; those of the words are known.
    most = 2 * total * hashes / math.log(2)
    filter_bytes = (total + (facts[2] or 0)) * hashes / math.log(2) / 8
    groups = 1 << max(2, math.ceil(math.log2(max(1, size / params.group_bytes, most / params.bits))))
    frequent = frequent_words(words, params.frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "ARRAY<STRUCT<word: BIGINT, m: BIGINT, n: BIGINT>>"
    schema = f"doc_id {kind}, rid BIGINT, n_tokens BIGINT, n_known BIGINT, base DOUBLE, score DOUBLE, tail {tail}"
    numbered = docs.withColumn("rid", F.monotonically_increasing_id())
    # Plain data: workers need no copy of this package to read it.
    parts = *frequent, total, known_types, params.prior
    context, shift = docs.sparkSession.sparkContext, _shift(groups)
    if filter_bytes <= params.broadcast_bytes:
        ranges = space.table(filter_ranges(own, groups, hashes), "filter")
        whole = whole_filter(ranges, groups, hashes)
        shared = context.broadcast((*parts, level_means(ranges), whole.bits, whole.starts))

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *facts, bits, starts = shared.value
            lm, own = LanguageModel(*facts), Filter(bits, hashes, 1, starts)
            for batch in batches:
                columns = lm.scored(batch, lambda names: own.level(names & _KEPT, (names >> shift).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, _SCORED)

        scored = space.table(numbered.drop("train").mapInArrow(here, schema), "scored")
        rare = scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.m").join(words, "word", "left")
        listed = rare.groupBy("rid").agg(F.collect_list(F.struct("word", "m", F.coalesce("n", F.lit(0)).alias("n"))).alias("tail"))
        scored = _with_rest(scored.drop("tail").join(listed, "rid", "left"), total + known_types + 1)
    else:
        # Buckets keep the chunks where they are for both uses.
        usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = space.bucketed(pack_chunks(numbered), "chunks", "chunk", max(usual, math.ceil(size / _BUCKET)))
        answers = space.table(find_levels(chunks, groups, hashes), "answers")
        shared = context.broadcast((*parts, level_means(answers.where("entries is not null"))))

        def score(table: pa.Table, answers: pa.Table) -> pa.Table:
            told = Answers(answers, shift)
            return pa.table(LanguageModel(*shared.value).scored(_unpacked(table.column("rows")), told.levels, told.exact), names=_SCORED)

        told = answers.drop("entries", "total").groupBy("chunk")
        scored = chunks.groupBy("chunk").cogroup(told).applyInArrow(score, schema)
        scored = space.table(_with_rest(scored, total + known_types + 1), "scored")
    shared.destroy()
    return scored.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        "score",
    )


def _with_rest(scored: DataFrame, size: int) -> DataFrame:
    """The share of the words of ``tail`` in ``n_known`` and in the base score, added up in the order of the words."""
    add = lambda start, value: F.coalesce(F.aggregate(F.sort_array("tail"), start, lambda s, t: s + value(t)), start)
    known = add(F.lit(0).cast("bigint"), lambda t: F.when(t["n"] > 0, t["m"]).otherwise(F.lit(0).cast("bigint")))
    base = add(F.lit(0.0), lambda t: t["m"] * F.log10((t["n"] + 1) / F.lit(float(size))))
    return scored.withColumns({"more_known": known, "more_base": base}).drop("tail")
