"""Words and their hashes, as numpy arrays inside Arrow tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return: exactly what ``bytes.split`` yields. ``bytes.lower`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

SPACES = " \t\n\r\x0b\x0c"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Rows that a task holds at once where whole texts go through Python.
TEXT_BATCH = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``TEXT_BATCH`` rows: long texts in batches
    of the usual 10,000 rows would fill the memory of workers."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_BATCH:
        spark.conf.set(_BATCH, str(TEXT_BATCH))
    return df


def lower_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case; null has none."""
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for every window of ``width`` words in order; a shorter text is one window."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    found = hashes[:count].copy()
    for step in range(1, width):
        found = mixed(found * _ODD + hashes[step : step + count])
    return found


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return values.view(np.int64)
