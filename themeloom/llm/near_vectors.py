"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash is the coordinate of largest absolute value, with its sign, after three rounds of random
signs and a fast Hadamard transform. Buckets join ``width`` hashes with the label. Every vector is
filed in its own bucket of each table and in the next likely ones. Pairs that meet in a bucket
are verified by their cosine in double precision, each in one bucket only. Buckets larger than a
block are split into blocks and compared block by block, so none is ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeloom.llm.blocks import into_blocks, per_block, smallest_linked
from themeloom.llm.components import components
from themeloom.llm.words import mixed, signed
from themeloom.workspace import Workspace


@dataclass(frozen=True)
class VectorParams:
    """``tables`` and ``probes`` raise recall; ``width`` hashes per bucket make it more selective
    and should grow with the logarithm of the vectors per label."""

    cosine: float = 0.93
    tables: int = 12
    width: int = 3
    probes: int = 4
    block: int = 512
    seed: int = 20


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two."""
    step, (rows, size) = 1, x.shape
    while step < size:
        x = x.reshape(rows, size // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(rows, size)
        step *= 2
    return x / np.sqrt(size)


def bucket_keys(vectors: np.ndarray, labels: np.ndarray, params: VectorParams) -> np.ndarray:
    """Buckets of unit vectors, tables by probes: first the own one, then those that change the
    hash whose runner-up is nearest."""
    rows, dims = vectors.shape
    size = max(2, 1 << (dims - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :dims] = vectors
    rng = np.random.default_rng(params.seed)
    keys = np.empty((rows, params.tables, params.probes), np.uint64)
    label = mixed(labels.astype(np.int64).view(np.uint64) + np.uint64(1))
    for table in range(params.tables):
        best, loss = [], []
        for _ in range(params.width):
            turned = padded
            for _ in range(3):
                turned = _hadamard(turned * rng.choice([-1.0, 1.0], size))
            order = np.argsort(-np.abs(turned), axis=1)[:, : params.probes]
            value = np.take_along_axis(turned, order, axis=1)
            best.append(order * 2 + (value < 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value))
        # The own bucket, then single changes in the order of what they lose.
        changes = [(w, p) for w in range(params.width) for p in range(1, order.shape[1])]
        cost = np.stack([loss[w][:, p] for w, p in changes], axis=1)
        chosen = np.argsort(cost, axis=1, kind="stable")[:, : params.probes - 1]
        for probe in range(params.probes):
            code = label + np.uint64(table)
            change = np.array(changes)[chosen[:, min(probe, chosen.shape[1]) - 1]] if probe else None
            for w in range(params.width):
                column = best[w][:, 0]
                if probe:
                    column = np.where(change[:, 0] == w, best[w][np.arange(rows), change[:, 1]], column)
                code = mixed(code + column.astype(np.uint64) + np.uint64(1))
            keys[:, table, probe] = code
    return keys.reshape(rows, -1)


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in double precision, and where each vector begins (one more at the end)."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(sizes)])


def _filed(vectors: DataFrame, params: VectorParams) -> DataFrame:
    """(id, keys): the buckets of every vector, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts = _matrix(batch.column("vector"))
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            for size in np.unique(np.diff(starts)):  # vectors of different lengths never meet
                rows = np.flatnonzero(np.diff(starts) == size)
                unit = _unit(values[starts[rows][:, None] + np.arange(size)])
                keys = signed(bucket_keys(unit, labels[rows], params) + np.uint64(size))
                for row, found in zip(rows, keys):
                    out[row] = np.unique(found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "keys"])

    return vectors.select("id", "vector", "label").mapInArrow(run, "id BIGINT, keys ARRAY<BIGINT>")


def _block_links(rows: pa.Table, params: VectorParams) -> list[tuple[int, int, int]]:
    """(id, smallest id joined in this block, links) for the rows of one block of a bucket: parts
    ``first`` and ``second`` of its rows. A pair that also meets in a bucket with a smaller key is
    left to that one."""
    key, first, second = (rows.column(c)[0].as_py() for c in ("key", "first", "second"))
    vectors = rows.column("vector").combine_chunks()
    values, starts = _matrix(vectors)
    size = np.diff(starts)[0]
    same = np.diff(starts) == size
    if not same.all():  # two lengths in a bucket only if its key is equal by accident
        return [x for part in (rows.filter(pa.array(same)), rows.filter(pa.array(~same))) for x in _block_links(part, params)]
    unit = _unit(values.reshape(-1, size))
    close = unit @ unit.T >= params.cosine
    np.fill_diagonal(close, False)
    if first != second:
        part = rows.column("part").to_numpy()
        close &= part[:, None] != part[None, :]
    if not close.any():
        return []
    keys, ends = _matrix_of_keys(rows.column("keys").combine_chunks())
    row = np.repeat(np.arange(len(unit)), np.diff(ends))
    smaller = keys < key
    names, place = np.unique(keys[smaller], return_inverse=True)
    met = np.zeros((len(unit), len(names)), np.float32)
    met[row[smaller], place] = 1
    close &= (met[:, met.sum(axis=0) > 1] @ met[:, met.sum(axis=0) > 1].T) == 0
    ids, weight = rows.column("id").to_numpy(), rows.column("w").to_numpy()
    links, root = close @ weight, smallest_linked(close, ids)
    return [(int(ids[i]), int(root[i]), int(links[i])) for i in np.flatnonzero(links)]


def _matrix_of_keys(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return keys.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def near_vectors(
    space: Workspace,
    vectors: DataFrame,
    params: VectorParams = VectorParams(),
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors at the cosine or above, of the
    same label), component_id (smallest id reachable by links), kept (whether that is its own).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without
    label, link with nothing; so do vectors of different lengths. Equal vectors of a label are one
    class with a weight: its members link with each other and share all other links. Rows without
    id count as links of others but get no component of their own. An empty table gives no rows.
    """
    space = space.part()
    own = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).cast("bigint").alias("label"))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    own = own.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
    own = space.table(own.withColumn("same", F.when(F.col("sound"), F.md5(F.to_json(F.struct("label", "vector"))))), "vectors")
    grouped = own.where("sound").groupBy("same").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("vector").alias("vector"), F.first("label").alias("label")
    )
    classes = space.table(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    filed = space.table(_filed(classes, params), "filed")

    entries = filed.select("id", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = entries.join(space.table(sizes, "sizes"), "key")
    blocks = into_blocks(met, "id", "n", params.block).join(classes.select("id", "w", "vector"), "id").join(filed, "id")
    columns = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    found = space.table(per_block(blocks, "key", lambda rows: _block_links(rows, params), columns), "found")

    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    edges = found.select("a", "b").where("a != b").distinct()
    whole = components(space, edges).withColumnRenamed("component", "group")
    facts = classes.select("id", "same", "least", "w").join(links.withColumnRenamed("a", "id"), "id", "left").join(whole, "id", "left")
    facts = space.table(facts.withColumn("group", F.coalesce("group", "id")), "facts")
    first = facts.groupBy("group").agg(F.min("least").alias("component_id"))
    named = space.table(facts.join(first, "group").select("same", "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "named")
    linked = own.where("sound").select("vec_id", "same").join(named, "same").select("vec_id", "n_links", "component_id")
    alone = own.where("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
