"""Passages that repeat across documents, found and located by automata of phrases.

Documents are dealt to blocks. Every window of words is hashed; a block sends each window once, with
its smallest document, to the bucket of the window, and the bucket tells the blocks which of their
windows start in a document of another block that comes first. With that a block knows the windows it has
to give up. It merges them to phrases, compiles these to Aho-Corasick automata over its own words, and
streams all its documents through them: every place where a phrase occurs is covered.

So an automaton is a shard that holds the phrases of one block's documents, and a document meets only the
shards that can match it. Work grows with the text, and neither a block nor a bucket grows with it: their
numbers do.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from themeloom.llm.words import hash_words, mixed, text_batches, window_hashes

_LAST = np.iinfo(np.int64).max
_MOST_DOCS = 1 << 16    # documents of a block that one message can number


@dataclass(frozen=True)
class RepeatParams:
    """A window has ``window`` words. A block takes about ``block_bytes`` of text, a bucket the
    windows of about ``bucket_bytes``. A phrase has ``phrase`` windows at most (longer runs become
    several that overlap), an automaton about ``automaton_words`` words, and ``piece_bytes`` of a text
    are split into words at once. None of these but ``window`` changes a result."""

    window: int = 13
    block_bytes: int = 8 << 20
    bucket_bytes: int = 12 << 20
    phrase: int = 64
    automaton_words: int = 1 << 19
    piece_bytes: int = 1 << 20


class _Numbered(dict):
    """Words with numbers in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Words:
    """Words of a block as numbers, and the hash of each."""

    def __init__(self, params: RepeatParams):
        self.params, self.numbers = params, _Numbered()

    def ids(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.numbers.__getitem__, piece.split()), np.int32) for piece in self._pieces(text or "")]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of all texts, one text after the other, and how many each has."""
        width = self.params.window
        length = np.array([len(one) for one in texts], np.int64)
        size = np.maximum(length - width + 1, 0)
        if not size.any():
            return np.empty(0, np.uint64), size
        hashes = window_hashes(hash_words(list(self.numbers))[np.concatenate(texts)], width)
        # Of the windows over all texts, those that end in the text they start in.
        start = np.repeat(np.cumsum(length) - length, size)
        return hashes[start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)], size

    def _pieces(self, text: str) -> Iterator[bytes]:
        """The text in pieces that end where a word does."""
        raw, at = text.encode(), 0
        while at < len(raw):
            end = min(len(raw), at + self.params.piece_bytes)
            while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            yield raw[at:end]
            at = end


# --- which windows start in an earlier document ------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes before all second ones: like ones lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(raw: bytes, dtype, count: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, count)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _packed(hashes: np.ndarray, docs: np.ndarray) -> bytes:
    """Ascending hashes and each one's document; numbers that rise are kept as differences. Documents are
    numbered within the message, so a message never holds more than its windows call for."""
    ids, place = np.unique(docs, return_inverse=True)
    steps = np.diff(hashes, prepend=np.uint64(0)), np.diff(ids, prepend=0), place.astype(np.uint16)
    return zstandard.compress(b"".join(map(_planes, steps)), 1)


def _unpacked(raw: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    plain = zstandard.decompress(raw)
    steps, ids, place = plain[: 8 * count], plain[8 * count : -2 * count], plain[-2 * count :]
    ids = np.cumsum(_numbers(ids, np.int64, len(ids) // 8))
    return np.cumsum(_numbers(steps, np.uint64, count), dtype=np.uint64), ids[_numbers(place, np.uint16, count)]


def _messages(block: int, docs: list[int], words: _Words, texts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row per bucket: each different window of these documents with its smallest document."""
    hashes, size = words.windows(texts)
    owner = np.repeat(np.array(docs, np.int64), size)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    hashes, owner = hashes[first], owner[first]
    bucket = _bucket(hashes, buckets)
    order = np.argsort(bucket, kind="stable")  # hashes stay ascending within a bucket
    borders = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, order[lo:hi]) for b, (lo, hi) in enumerate(zip(borders[:-1], borders[1:])) if hi > lo]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _ in rows], pa.int32()),
            pa.array([block] * len(rows), pa.int32()),
            pa.array([len(part) for _, part in rows], pa.int32()),
            pa.array([_packed(hashes[part], owner[part]) for _, part in rows], pa.binary()),
        ],
        ["bucket", "block", "n", "windows"],
    )


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Drawn from other bits than the order of the hashes."""
    return (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int32)


def _sender(params: RepeatParams, buckets: int):
    most = params.block_bytes // 4  # words that a message may hold: more than a usual block has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, _Words] = {}
        docs: dict[int, list[int]] = defaultdict(list)
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        count: Counter[int] = Counter()
        for batch in batches:
            for block, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "doc", "text"))):
                found = words.setdefault(block, _Words(params)).ids(text)
                docs[block].append(doc)
                held[block].append(found)
                count[block] += len(found)
                if count[block] >= most or len(docs[block]) == _MOST_DOCS:
                    yield _messages(block, docs.pop(block), words.pop(block), held.pop(block), buckets)
                    count.pop(block)
        for block in docs:
            yield _messages(block, docs[block], words[block], held[block], buckets)

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """For a bucket: the windows of each block that an earlier document of another block has."""
    hashes, docs, blocks = [], [], []
    for block, count, raw in zip(*(table.column(c).to_pylist() for c in ("block", "n", "windows"))):
        some, owner = _unpacked(raw, count)
        hashes.append(some)
        docs.append(owner)
        blocks.append(np.full(count, block, np.int32))
    hashes, docs, blocks = map(np.concatenate, (hashes, docs, blocks))
    order = np.argsort(hashes, kind="stable")
    hashes, docs, blocks = hashes[order], docs[order], blocks[order]
    start = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    count = np.diff(start, append=len(hashes))
    smallest = np.repeat(np.minimum.reduceat(docs, start), count)
    # A block that has the first document itself knows, even if it sent several messages.
    owner = np.repeat(np.maximum.reduceat(np.where(docs == smallest, blocks, -1), start), count)
    late = np.flatnonzero((docs > smallest) & (blocks != owner))
    late = late[np.argsort(blocks[late], kind="stable")]
    borders = np.flatnonzero(np.diff(blocks[late], prepend=-1))
    parts = np.split(late, borders[1:]) if len(late) else []
    return pa.table(
        {
            "block": pa.array([int(blocks[p[0]]) for p in parts], pa.int32()),
            "windows": pa.array([_planes(hashes[p]) for p in parts], pa.binary()),
        }
    )


# --- phrases and their places --------------------------------------------------------


class _Automata:
    """Phrases of a block, compiled in shards of a bounded size."""

    def __init__(self, params: RepeatParams):
        self.params, self.shards, self.size = params, [], 0

    def add(self, phrase: np.ndarray, after: int) -> None:
        """``after``: the phrase counts only in documents with a larger id than this."""
        if not self.shards or self.size >= self.params.automaton_words:
            self.shards.append(ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE))
            self.size = 0
        if self.shards[-1].add_word(tuple(phrase.tolist()), (len(phrase), after)):
            self.size += len(phrase)

    def compiled(self) -> _Automata:
        for shard in self.shards:
            shard.make_automaton()
        return self

    def covered(self, ids: np.ndarray, doc: int) -> np.ndarray:
        """Which words lie in a phrase, wherever it occurs in the document."""
        change = np.zeros(len(ids) + 1, np.int32)
        longest = self.params.phrase + self.params.window
        for shard in self.shards:
            for at in range(0, len(ids), self.params.piece_bytes):
                lo = max(0, at - longest)
                for end, (length, after) in shard.iter(tuple(ids[lo : at + self.params.piece_bytes].tolist())):
                    if doc > after:
                        change[lo + end + 1 - length] += 1
                        change[lo + end + 1] -= 1
        return np.cumsum(change[:-1]) > 0


def _phrases(automata: _Automata, ids: np.ndarray, gone: np.ndarray, after: np.ndarray) -> None:
    """Adds the runs of windows that are ``gone``, long ones in parts."""
    params = automata.params
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    for start, end in zip(edge[::2], edge[1::2]):
        for at in range(start, end, params.phrase):
            stop = min(end, at + params.phrase)
            automata.add(ids[at : stop + params.window - 1], int(after[at:stop].max()))


def _cleaner(params: RepeatParams, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        docs = left.column("doc").to_numpy()
        words = _Words(params)
        ids = [words.ids(text) for text in _texts(left)]
        hashes, size = words.windows(ids)
        owner = np.repeat(docs, size)
        known = [_numbers(raw, np.uint64, len(raw) // 8) for raw in right.column("windows").to_pylist()]
        known = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
        distinct, place = np.unique(hashes, return_inverse=True)
        # A window that another block has earlier goes everywhere, others after their first document here.
        after = np.full(len(distinct), _LAST)
        np.minimum.at(after, place, owner)
        after[np.isin(distinct, known, assume_unique=True)] = np.iinfo(np.int64).min
        after = after[place]
        ends = np.cumsum(size)
        automata = _Automata(params)
        for number, (one, stop) in enumerate(zip(ids, ends)):
            limit = after[stop - size[number] : stop]
            _phrases(automata, one, limit < docs[number], limit)
        automata.compiled()
        names = list(words.numbers)
        removed, spans, kept = [], [], []
        for one, doc in zip(ids, docs):
            out = automata.covered(one, doc)
            edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
            removed.append(int(out.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            kept.append(b" ".join([names[i] for i in one[~out].tolist()]).decode())
        return pa.table(
            [
                left.column("row"),
                pa.array([len(one) for one in ids], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, schema.field("spans").type),
                pa.array(kept, pa.string()),
            ],
            ["row", "n_words", "n_removed", "spans", "kept_text"],
        )

    return run


def _texts(table: pa.Table) -> Iterator[str | None]:
    for chunk in table.column("text").chunks:
        for value in chunk:
            yield value.as_py()


def remove_repeats(
    docs: DataFrame, keep: list[str], params: RepeatParams = RepeatParams(), text: str = "text", order: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: ``row`` with the kept columns, ``n_words``, ``n_removed``, ``spans``
    (places of removed words, start to end) and ``kept_text`` (the words left, joined by one space).

    A word goes when a window that covers it starts, word by word the same, in a row with a smaller
    ``order`` too. Windows are judged on the input, not on what is left. Rows of equal order (repeated
    rows) take nothing from each other; rows without order come after all others and take nothing from
    each other. A null text has no words, a text shorter than a window loses none, an empty table gives
    no rows. Windows are told apart by 64 bits within a bucket, and buckets grow in number with the
    text: less than one false pair is expected in 1e12 windows.

    The text crosses the network once, and beside it about 8 bytes per window.
    """
    plain = F.col(order).cast("bigint")
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    blocks, buckets = (1 + total // size for size in (params.block_bytes, params.bucket_bytes))
    # Rows without order are dealt by their text.
    draw = F.when(plain.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(plain))
    dealt = text_batches(docs).select(
        F.pmod(draw, F.lit(blocks)).cast("int").alias("block"),
        F.coalesce(plain, F.lit(int(_LAST))).alias("doc"),
        F.col(text).cast("string").alias("text"),
        F.struct(*keep).alias("row"),
    )
    # Both uses read the same columns, so that Spark sends the texts once.
    dealt = dealt.repartition(blocks, "block")
    sent = dealt.mapInArrow(_sender(params, buckets), "bucket INT, block INT, n INT, windows BINARY")
    told = sent.groupBy("bucket").applyInArrow(_earlier, "block INT, windows BINARY")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    found = StructType.fromDDL("n_words BIGINT, n_removed BIGINT, spans ARRAY<STRUCT<start: INT, end: INT>>, kept_text STRING")
    schema = StructType([dealt.schema["row"], *found])  # with the kept columns' own nullability
    clean = _cleaner(params, pa.schema([("spans", spans)]))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(clean, schema)
