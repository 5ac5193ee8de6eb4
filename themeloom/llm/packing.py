"""Harmonic packing of documents into sequences of a fixed number of tokens.

A piece of length r belongs to class k = capacity // r, whose bins take exactly k pieces. Each
task fills its own bins, one open bin per class, so nothing is exchanged. A document is cut into
whole sequences and a rest; a rest that would waste too much of its share of a bin is cut to
the next smaller share, and what remains is classed again. Bins that a task has not filled at
its end are joined: their pieces follow each other, cut at the ends of sequences, and the last
of them falls into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.words import text_batches

_CACHE = 200_000
# Characters whose normal form is themselves and whose lower case is the same everywhere.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the tokenizer's pattern, for plain characters in lower case.
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# The tokenizer writes a byte as a character of its own: here for the two bytes of a letter.
_VISIBLE = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
_VISIBLE |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BYTES = {c: "".join(_VISIBLE[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


@dataclass(frozen=True)
class PackParams:
    """``tokenizer`` is the path of a tokenizer file on every worker whose words are separated by
    white space, ``end`` the id after each document. At most ``waste`` of its share of a bin is
    lost by a piece."""

    tokenizer: str
    capacity: int = 2048
    end: int = 1
    waste: float = 1 / 32


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizer.

    Spaces and line feeds separate words, and ids of a word do not depend on its neighbours, so
    words are looked up. A new word of plain
    characters falls into the units that the tokenizer's pattern cuts out, which are looked up
    too or go to its model; any other word goes through the whole tokenizer. Both caches stop
    growing at a limit: frequent words come early.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {"": b""}
        self.units: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.word(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)

    def word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:  # so no special token's string is in it
            found = b"".join(map(self.unit, _UNIT.findall(word.lower())))
        else:
            found = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.words) < _CACHE:
            self.words[word] = found
        return found

    def unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            found = _packed([t.id for t in self.model.tokenize(unit if unit.isascii() else unit.translate(_BYTES))])
            if len(self.units) < _CACHE:
                self.units[unit] = found
        return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cuts(length: int, capacity: int, waste: float) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        share = capacity // (capacity // rest)
        piece = rest if share - rest <= waste * share else capacity // (capacity // rest + 1)
        pieces.append(piece)
        rest -= piece
    return pieces


class Bins:
    """The bins of one task: pieces in, placed pieces out. A piece is (number, start, length)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        kind = self.capacity // piece[2]
        held = self.open.setdefault(kind, [])
        held.append(piece)
        return self._placed(self.open.pop(kind)) if len(held) == kind else []

    def close(self) -> list[tuple]:
        """Pieces of unfilled bins in sequences without a gap; the last are powers of two."""
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        total, placed, held = sum(p[2] for p in left), [], []
        size = room = min(self.capacity, 1 << max(total.bit_length() - 1, 0))
        for piece in left:
            while piece[2]:
                part = min(piece[2], room)
                held.append((piece[0], piece[1], part, *piece[3:]))
                piece = (piece[0], piece[1] + part, piece[2] - part, *piece[3:])
                room -= part
                if not room:
                    placed += self._placed(held)
                    total -= size
                    held, size = [], min(self.capacity, 1 << max(total.bit_length() - 1, 0))
                    room = size
        return placed

    def _placed(self, pieces: list[tuple]) -> list[tuple]:
        """Each piece with its sequence and its offset there."""
        number, offset, out = self.next, 0, []
        self.next += 1
        for piece in pieces:
            out.append((*piece, number, offset))
            offset += piece[2]
        return out


def pack(docs: DataFrame, params: PackParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. Every id of every document lies in one piece.

    A null text has only the end id, and so has one without tokens. Rows with equal or null ids are
    packed one by one. An empty table gives no rows. Sequence ids hold the number of the task
    and a number inside it; a task run again gives the same. A task holds less than a sequence
    per class, besides its batch of texts.
    """
    from pyspark import TaskContext

    given = text_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    end = np.array([params.end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(params.tokenizer).encode
        bins = Bins(params.capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            placed: list[tuple] = []
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for name, value in zip(names, texts):
                ids = encode(value) + end
                total, start = len(ids) // 4, 0
                for length in cuts(total, params.capacity, params.waste):
                    placed += bins.add((name, start, length, ids[4 * start : 4 * (start + length)], start, total))
                    start += length
            if placed:
                yield _pieces(placed)
        if placed := bins.close():
            yield _pieces(placed)

    schema = "doc_id BIGINT, start BIGINT, length BIGINT, ids BINARY, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"
    return given.mapInArrow(run, schema)


def _pieces(placed: list[tuple]) -> pa.RecordBatch:
    """A piece cut again takes its part of the ids it was made with (from ``base`` on)."""
    name, start, length, held, base, total, number, offset = zip(*placed)
    ids = [h[4 * (s - b) : 4 * (s - b + n)] for h, s, b, n in zip(held, start, base, length)]
    columns = [name, start, length, None, total, number, offset]
    arrays = [pa.array(ids, pa.binary()) if c is None else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
