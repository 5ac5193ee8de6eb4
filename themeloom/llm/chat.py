"""Chat formatting on tokens.

A turn is three reserved ids around two encoded segments: start, role, split, text, end. Role and
text are encoded on their own, so no merge crosses a border, and the strings that stand for the
reserved ids are escaped where a text holds them. Token places and the loss mask of a conversation
are running sums over its turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from themeloom.llm.words import text_batches

START, SPLIT, END = "<turn>", "</role>", "</turn>"
_CONTROL = re.compile("|".join(map(re.escape, (START, SPLIT, END))))


@dataclass(frozen=True)
class ChatParams:
    """``ranks`` is the path of a byte-level rank file on every worker and ``pattern`` its split
    pattern. The reserved ids follow the ``first_free`` id. Loss falls on ``loss_roles``."""

    ranks: str
    pattern: str
    first_free: int = 50_257
    loss_roles: tuple[str, ...] = ("assistant",)
    #: About how much is encoded at once. A longer text is cut after words where the pattern splits it anyway, which
    #: gives the ids of the whole; a longer piece of the pattern is encoded as one.
    part: int = 1 << 16


def escape(text: str) -> str:
    """Backslashes are doubled, and one is put after the first character of a control string."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Codec:
    """Segments to ids and back."""

    params: ChatParams
    coder: object = field(init=False)

    def __post_init__(self) -> None:
        import tiktoken

        with open(self.params.ranks, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coder = tiktoken.Encoding("chat", pat_str=self.params.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(self.params.pattern)
        first = self.params.first_free
        self.start, self.split, self.end = first, first + 1, first + 2

    def encode(self, segment: str) -> list[int]:
        segment, size = escape(segment), self.params.part
        if len(segment) <= size:
            return self.coder.encode_ordinary(segment)
        cuts = [0]
        for piece in self.pieces.finditer(segment):
            # Not after white space: how the pattern splits that depends on what follows.
            if piece.end() - cuts[-1] >= size and not segment[piece.end() - 1].isspace():
                cuts.append(piece.end())
        parts = (segment[a:b] for a, b in zip(cuts, [*cuts[1:], len(segment)]) if b > a)
        return [x for part in parts for x in self.coder.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode_bytes(ids).decode()

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids of a turn and where its text's ids begin and end."""
        head, body = self.encode(role), self.encode(text)
        ids = np.array([self.start, *head, self.split, *body, self.end], "<u4")
        return ids, len(head) + 2, len(head) + 2 + len(body)

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Escaped role and text of a turn's ids; raises if they are not one whole turn."""
        found = ids.tolist()
        split = found.index(self.split)
        if found[0] != self.start or found[-1] != self.end or max(found[1:split] + found[split + 1 : -1], default=0) >= self.start:
            raise ValueError("not one turn")
        return self.decode(found[1:split]), self.decode(found[split + 1 : -1])


def format_turns(
    turns: DataFrame, params: ChatParams, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn, in order: conv_id, place, ids (binary, little-endian unsigned 32-bit), start
    (its first token in the conversation), loss_start and loss_end (equal where no loss falls).

    Turns without a number come first; turns with equal numbers follow by role and text, so repeated
    rows are turns of their own. Null roles and texts are empty. Rows without conversation id form
    one conversation. An empty table gives no rows. Turns are encoded one by one wherever they are;
    only the running sum brings those of a conversation together, sorted and row by row.
    """
    given = text_batches(turns).select(
        F.col(key).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(params)
        for batch in batches:
            found = [codec.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            loss = [r in params.loss_roles for r in batch.column("role").to_pylist()]
            begin = [b if on else 0 for (_, b, _), on in zip(found, loss)]
            end = [e if on else 0 for (_, _, e), on in zip(found, loss)]
            arrays = [
                *[batch.column(c) for c in ("conv_id", "turn", "role")],
                pa.array([hashlib.md5(t.encode()).digest() for t in batch.column("text").to_pylist()], pa.binary()),
                pa.array([ids.tobytes() for ids, _, _ in found], pa.binary()),
                *[pa.array(x, pa.int64()) for x in (begin, end, [len(ids) for ids, _, _ in found])],
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "digest", "ids", "b", "e", "n"])

    encoded = given.mapInArrow(
        run, "conv_id BIGINT, turn BIGINT, role STRING, digest BINARY, ids BINARY, b BIGINT, e BIGINT, n BIGINT"
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = encoded.withColumn("place", F.row_number().over(order)).withColumn("start", before)
    return placed.select(
        "conv_id", "place", "ids", "start", (F.col("start") + F.col("b")).alias("loss_start"), (F.col("start") + F.col("e")).alias("loss_end")
    )


def read_back(formatted: DataFrame, params: ChatParams) -> DataFrame:
    """One row per conversation, read from the ids alone: n_turns, turns_sha256 (role, line feed, text,
    line feed per turn), loss_chars and loss_sha256 (text under the loss mask), formatted_chars (code
    points with the control strings). A conversation's digests are carried from row to row, so a long
    conversation is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, done = Codec(params), None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "ids", "start", "loss_start", "loss_end")]
            for name, raw, start, loss_start, loss_end in zip(*columns):
                if held is None or held[0] != name:
                    if held:
                        done.append(_row(held))
                    held = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u4")
                role, text = codec.read(ids)
                held[1] += 1
                held[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                if loss_end > loss_start:
                    under = unescape(codec.decode(ids[loss_start - start : loss_end - start].tolist()))
                    held[3] += len(under)
                    held[4].update(under.encode())
                held[5] += len(START) + len(role) + len(SPLIT) + len(text) + len(END)
            if done:
                yield _rows(done)
                done = []
        if held:
            yield _rows([_row(held)])

    together = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return together.mapInArrow(
        run,
        "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, formatted_chars BIGINT",
    )


def _row(held: list) -> tuple:
    return held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
