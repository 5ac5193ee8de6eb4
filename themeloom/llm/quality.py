"""Quality rules: figures of single texts, and lines that many documents of a host share.

A line is normalised (A-Z lowered, runs of white space to one space, digits to 0) and hashed
with its host. A line that more distinct texts of the host hold than the limit is removed from
all of them, and a document left with too little is rejected. Copies of one text count as one
document, so a text does not fall because it was copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType
from xxhash import xxh3_64_intdigest

from themeloom.llm.words import SPACES, signed, text_batches
from themeloom.workspace import Workspace

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SYMBOLS = b"#*$%&|<>"
_LINE = pa.struct([("key", pa.int64()), ("words", pa.int32())])
_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityParams:
    """A text fails with fewer words than ``min_words``, or with more than ``repeat_percent``
    of its words in repeated windows. A line goes when more than ``line_docs`` and more than
    ``line_percent`` of the distinct texts of its host hold it, and whenever more than ``line_most`` do,
    however large the host is. A document is depleted when
    fewer than ``left_words`` words or less than ``left_percent`` of them remain."""

    min_words: int = 50
    repeat_percent: int = 50
    window: int = 3
    line_docs: int = 10
    line_percent: int = 1
    line_most: int = 100
    left_words: int = 20
    left_percent: int = 20


def repeat_words(words: list, window: int) -> int:
    """Words that lie in a window found twice or more, the first find included."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key = codes[:count]
    for step in range(1, window):
        if step > 1:  # dense numbers for the windows so far keep the product exact
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + codes[step : step + count]
    _, place, found = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(found[place] >= 2)
    covered = np.zeros(len(words), bool)
    for step in range(window):
        covered[twice + step] = True
    return int(covered.sum())


def text_figures(text: str, window: int = 3) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words, window)


def measure(docs: DataFrame, text: str, host: str, keep: list[str], params: QualityParams) -> DataFrame:
    """Columns ``row`` (a struct of the kept columns), the figures, ``host`` and ``content``
    (hashes) and ``lines`` (key of host and normalised line, words), in the text's order; lines
    without a word are left out."""
    apart = text not in keep  # else it is read from the row
    own = [F.col(text).alias("text")] if apart else []
    given = text_batches(docs).select(F.struct(*keep).alias("row"), *own, F.col(host).cast("string").alias("host"))
    row = given.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures, hosts, contents, keys, counts, ends = [], [], [], [], [], [0]
            texts = batch.column("text") if apart else batch.column("row").field(text)
            for value, name in zip(texts.to_pylist(), batch.column("host").to_pylist()):
                value = value or ""
                figures.append(text_figures(value, params.window))
                raw = value.encode()
                seed = 0 if name is None else xxh3_64_intdigest(name.encode(), 1)
                hosts.append(seed)
                contents.append(xxh3_64_intdigest(raw))
                for line in raw.split(b"\n"):
                    if parts := line.split():
                        keys.append(xxh3_64_intdigest(b" ".join(parts).lower().translate(_DIGITS), seed))
                        counts.append(len(parts))
                ends.append(len(keys))
            table = np.array(figures, np.int64).reshape(-1, len(_FIGURES))
            key = pa.array(signed(np.array(keys, np.uint64)))
            lines = pa.StructArray.from_arrays([key, pa.array(counts, pa.int32())], fields=list(_LINE))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(_FIGURES))],
                    pa.array(signed(np.array(hosts, np.uint64))),
                    pa.array(signed(np.array(contents, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines),
                ],
                ["row", *_FIGURES, "host", "content", "lines"],
            )

    columns = ", ".join(f"{name} BIGINT" for name in (*_FIGURES, "host", "content"))
    schema = f"row {row}, {columns}, lines ARRAY<STRUCT<key: BIGINT, words: INT>>"
    return given.mapInArrow(run, schema)


def frequent_lines(space: Workspace, measured: DataFrame, params: QualityParams) -> DataFrame:
    """(key) of the lines above the limit. The distinct step spreads a line by its texts, so a
    line or host that is everywhere makes no large task."""
    lines = measured.select("host", "content", F.explode("lines.key").alias("key")).distinct()
    often = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > params.line_docs)
    often = space.table(often, "often")
    texts = measured.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    above = often.join(space.table(texts, "texts"), "host").where(
        (F.col("n") * 100 > F.col("texts") * params.line_percent) | (F.col("n") > params.line_most)
    )
    return space.table(above.select("key").distinct(), "frequent")


def quality_rules(
    space: Workspace,
    docs: DataFrame,
    keep: list[str],
    params: QualityParams = QualityParams(),
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``row`` with the kept columns, the figures, ``base_failed``,
    ``cut_lines`` (places of removed lines among the lines with words), ``left_words`` and
    ``kept``.

    A null text counts as empty and fails; a null host is a host of its own; repeated rows get
    equal results; an empty table gives none."""
    space = space.part()
    measured = measure(docs, text, host, keep, params).withColumn("rid", F.monotonically_increasing_id())
    measured = space.table(measured, "measured")
    frequent = frequent_lines(space, measured, params)
    placed = measured.select("rid", F.posexplode("lines").alias("place", "line"))
    cut = (
        placed.select("rid", "place", "line.key", "line.words")
        .join(frequent, "key")
        .groupBy("rid")
        .agg(F.sum("words").alias("cut_words"), F.sort_array(F.collect_list("place")).alias("cut_lines"))
    )
    left = F.col("n_words") - F.coalesce("cut_words", F.lit(0))
    failed = (F.col("n_words") < params.min_words) | (
        100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words")
    )
    enough = (left >= params.left_words) & (100 * left >= params.left_percent * F.col("n_words"))
    return (
        measured.drop("lines", "host", "content")
        .join(cut, "rid", "left")
        .select(
            "row",
            *_FIGURES,
            failed.alias("base_failed"),
            F.coalesce("cut_lines", F.array().cast("array<int>")).alias("cut_lines"),
            left.alias("left_words"),
            (~failed & enough).alias("kept"),
        )
    )


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, places: pd.Series) -> pd.Series:
    """The texts without their lines at ``places``, counted among the lines that have words."""
    return pd.Series([t if t is None or not len(p) else _left(t, set(p)) for t, p in zip(text, places)], dtype=object)


def _left(text: str, places: set[int]) -> str:
    left, place = [], 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            place += 1
            if place - 1 in places:
                continue
        left.append(line)
    return "\n".join(left)
