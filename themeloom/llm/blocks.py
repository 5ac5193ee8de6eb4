"""Pairs within large groups, block by block.

The rows of a group are dealt to parts of a bounded size, and every pair of parts becomes a block
of its own: no group is ever in one task, and no pair leaves one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def into_blocks(rows: DataFrame, item: str, size: str, block: int) -> DataFrame:
    """Adds part, first and second: each row once per block of its group that its part belongs to.
    ``size`` is the number of rows of the group, ``item`` what its part is drawn from."""
    parts = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(item), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other")).drop("other")


def per_block(rows: DataFrame, key: str, found: Callable[[pa.Table], list[tuple]], schema: pa.Schema) -> DataFrame:
    """What ``found`` returns for each block (a group of equal key, first and second) of two rows or
    more. A task holds one block at a time, besides its Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            names = np.stack([table.column(c).to_numpy() for c in (key, "first", "second")])
            borders = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1), len(table)]
            for a, b in zip(borders[:-2], borders[1:-1]):
                if b - a > 1:
                    yield packed(found(table.slice(a, b - a)))
            rest = table.slice(borders[-2])
        if rest is not None and len(rest) > 1:
            yield packed(found(rest))

    def packed(results: list[tuple]) -> pa.RecordBatch:
        columns = zip(*results) if results else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    dealt = rows.repartition(key, "first", "second").sortWithinPartitions(key, "first", "second")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} BIGINT" for f in schema))


def smallest_linked(close: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches along the links of a block."""
    root = ids.copy()
    while True:
        spread = np.minimum(root, np.where(close, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (spread == root).all():
            return root
        root = spread
