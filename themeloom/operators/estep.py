"""Inference of topic logits per document.

The pieces with given logits (proportions, objective, gradient, Hessian, expected counts)
are DataFrame expressions over triplets. The search for the best logits needs them many
times per document, so ``infer`` runs it inside the tasks, in numpy, for many documents
at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from themeloom.constants import SMALLEST_NORMAL
from themeloom.functions import dot, linear_map, number_array, quadratic_form, softmax_with_reference
from themeloom.lookup import BROADCAST_BYTES, lookup_join
from themeloom.operators.covariates import Vectors
from themeloom.operators.newton import evaluate, search
from themeloom.operators.ragged import list_column, ragged, square

TOPIC_BYTES = 64 * 1024 * 1024    # topics up to this size are sent whole to every task, by way of the driver in each iteration
CHUNK_CELLS = 1 << 19             # terms x topics solved together
PHI_BYTES = 256 * 1024 * 1024     # expected counts a task holds at most before it hands them on
BLOCK_BYTES = 64 * 1024 * 1024    # topics of the terms that a block of documents may bring together

RESULT = "kind STRING, doc_id BIGINT, aspect INT, idx INT, vec ARRAY<DOUBLE>, bound DOUBLE"
_SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("doc_id", pa.int64()),
        ("aspect", pa.int32()),
        ("idx", pa.int32()),
        ("vec", pa.list_(pa.float64())),
        ("bound", pa.float64()),
    ]
)


# --- pieces with given logits ----------------------------------------------------


def parameter_lookup(documents: DataFrame, eta: DataFrame, mu: DataFrame) -> DataFrame:
    """Attach start logits and prior mean to every document, by id."""
    return documents.join(eta.select("doc_id", "eta"), "doc_id").join(
        mu.select("doc_id", "mu"), "doc_id"
    )


def topic_slice(triplets: DataFrame, topics: Topics, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Triplets with the topic probabilities ``b`` of their term. With topics per aspect
    the triplets need an ``aspect`` column. A term without topics has probability 0 in each, as
    where the topics are sent whole: its entries count, and inference floors them.

    Ids fall with the document frequency. Of topics beyond ``limit`` bytes those of the most frequent terms are sent to all
    tasks, as many as fit half of it; only the entries of the others are shuffled, once, and so are their topics."""
    keys = ["aspect", "term_id"] if topics.aspects > 1 else ["term_id"]
    if topics.bytes <= limit:
        sliced = triplets.join(F.broadcast(topics.table), keys, "left")
    else:
        frequent = F.coalesce(F.col("term_id") < F.lit(topics.terms * limit // (2 * topics.bytes)), F.lit(False))
        near = triplets.where(frequent).join(F.broadcast(topics.table.where(frequent)), keys, "left")
        far = triplets.where(~frequent).join(topics.table.where(~frequent).hint("merge"), keys, "left")
        sliced = near.unionByName(far)
    return sliced.withColumn("b", F.coalesce("b", number_array([0.0] * topics.topics)))


def proportions(eta: DataFrame) -> DataFrame:
    """(doc_id, theta)."""
    return eta.select("doc_id", softmax_with_reference(F.col("eta")).alias("theta"))


def _with_theta(sliced: DataFrame, theta: DataFrame) -> DataFrame:
    """Triplets with ``theta`` of their document. Such that have it, say from the corpus, whose documents need no shuffle of
    their entries, are left as they are."""
    return sliced if "theta" in sliced.columns else sliced.join(theta, "doc_id")


def _explained(sliced: DataFrame, theta: DataFrame) -> DataFrame:
    """Triplets with ``p``, the share of each topic in the term."""
    joined = _with_theta(sliced, theta)
    word = F.greatest(dot(F.col("theta"), F.col("b")), F.lit(SMALLEST_NORMAL))
    # The division is bound to one evaluation of the sum per row.
    share = F.aggregate(
        F.array(word),
        F.lit(0.0),
        lambda acc, v: acc + v,
        lambda s: F.zip_with("theta", "b", lambda t, b: t * b / s),
    )
    return joined.withColumn("p", share)


def log_likelihood(sliced: DataFrame, theta: DataFrame) -> DataFrame:
    """(doc_id, n, likelihood): sum over terms of count times log probability."""
    joined = _with_theta(sliced, theta)
    word = F.greatest(dot(F.col("theta"), F.col("b")), F.lit(SMALLEST_NORMAL))
    return joined.groupBy("doc_id").agg(
        F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log(word)).alias("likelihood")
    )


def objective(sliced: DataFrame, state: DataFrame, precision: np.ndarray) -> DataFrame:
    """(doc_id, likelihood, prior, value): the function minimised per document, for all
    documents of ``state`` (doc_id, eta, mu). A document without terms has likelihood 0."""
    likelihood = log_likelihood(sliced, proportions(state))
    prior = 0.5 * quadratic_form(_deviation(), precision.tolist())
    joined = state.join(likelihood, "doc_id", "left")
    parts = joined.select(
        "doc_id", F.coalesce("likelihood", F.lit(0.0)).alias("likelihood"), prior.alias("prior")
    )
    return parts.withColumn("value", F.col("prior") - F.col("likelihood"))


def gradient(sliced: DataFrame, state: DataFrame, precision: np.ndarray) -> DataFrame:
    """(doc_id, k, value): gradient of the objective."""
    theta = proportions(state)
    topics = len(precision) + 1
    expected = (
        _explained(sliced, theta)
        .groupBy("doc_id")
        .agg(
            F.sum("cnt").alias("n"),
            F.array(*[F.sum(F.col("cnt") * F.get("p", F.lit(k))) for k in range(topics)]).alias("counts"),
        )
    )
    joined = state.join(theta, "doc_id").join(expected, "doc_id", "left")
    counts = F.coalesce("counts", number_array([0.0] * topics))
    n = F.coalesce("n", F.lit(0.0))
    pull = linear_map(_deviation(), precision.tolist())
    push = F.zip_with(counts, "theta", lambda c, t: c - n * t)
    slope = F.zip_with(pull, F.slice(push, 1, topics - 1), lambda a, b: a - b)
    return joined.select("doc_id", F.posexplode(slope).alias("k", "value"))


def hessian(sliced: DataFrame, eta: DataFrame, precision: np.ndarray) -> DataFrame:
    """(doc_id, k1, k2, value): second derivatives of the objective, for documents that
    have terms.

    A document's entries come together in its row, and its outer products are added up in one packed vector
    of K (K - 1) / 2 numbers, half of the symmetric matrix; cells are written out last."""
    size = len(precision)
    entry = F.struct(F.col("cnt").cast("double").alias("cnt"), "b")
    rows = sliced.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_list(entry).alias("entries"))
    rows = rows.join(eta.select(F.col("doc_id").cast("bigint").alias("doc_id"), "eta"), "doc_id")
    flat = rows.select("doc_id", "eta", F.col("entries.cnt").alias("counts"), F.flatten("entries.b").alias("topics"))
    first, second = np.triu_indices(size)
    place = np.zeros((size, size), np.int64)
    place[first, second] = place[second, first] = np.arange(len(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                counts, starts = ragged(one.column("counts"))
                topics, edges = ragged(one.column("topics"))
                counts, topics = counts[starts[0] : starts[-1]], topics[edges[0] : edges[-1]].reshape(-1, size + 1)
                packed = _packed_curvature(counts, topics, square(one.column("eta"))[0], precision, first, second)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size * size, one.column("doc_id")[0].as_py())),
                        pa.array(np.repeat(np.arange(size, dtype=np.int32), size)),
                        pa.array(np.tile(np.arange(size, dtype=np.int32), size)),
                        pa.array(packed[place].ravel()),
                    ],
                    names=["doc_id", "k1", "k2", "value"],
                )

    return flat.mapInArrow(run, "doc_id BIGINT, k1 INT, k2 INT, value DOUBLE")


def _packed_curvature(
    counts: np.ndarray, topics: np.ndarray, eta: np.ndarray, precision: np.ndarray, first: np.ndarray, second: np.ndarray
) -> np.ndarray:
    """Upper half of a document's curvature, row by row. Terms are taken in parts of a bounded size."""
    logits = np.append(eta, 0.0)
    e = np.exp(logits - logits.max())
    theta = e / e.sum()
    share = topics * theta / np.maximum(topics @ theta, SMALLEST_NORMAL)[:, None]
    packed = np.zeros(len(first))
    step = max(1, CHUNK_CELLS // max(1, len(first)))
    for at in range(0, len(counts), step):
        part = share[at : at + step]
        packed += counts[at : at + step] @ (part[:, first] * part[:, second])
    even = counts.sum() * theta
    diagonal = np.where(first == second, (counts @ share - even)[first], 0.0)
    return packed - even[first] * theta[second] - diagonal + precision[first, second]


def expected_counts(sliced: DataFrame, theta: DataFrame, by: list[str], topics: int) -> DataFrame:
    """(by, phi): expected topic counts, summed by columns of the triplets, such as term_id
    or aspect and term_id."""
    return _explained(sliced, theta).groupBy(*by).agg(
        F.array(*[F.sum(F.col("cnt") * F.get("p", F.lit(k))) for k in range(topics)]).alias("phi")
    )


def _deviation() -> Column:
    return F.zip_with("eta", "mu", lambda e, m: e - m)


# --- inference -------------------------------------------------------------------


@dataclass(frozen=True)
class Topics:
    """Topic-word probabilities (term_id, b), or (aspect, term_id, b) with ``aspects`` > 1
    when the topics differ between aspects."""

    table: DataFrame
    topics: int
    terms: int
    aspects: int = 1

    @property
    def bytes(self) -> int:
        return self.aspects * self.terms * (16 + 8 * self.topics)

    def array(self) -> np.ndarray:
        """aspects x terms x topics; only for sizes below the limit."""
        cells = np.zeros((self.aspects, self.terms, self.topics))
        aspect = F.col("aspect") if self.aspects > 1 else F.lit(0)
        arrow = self.table.select(aspect.alias("aspect"), "term_id", "b").toArrow().combine_chunks()
        for batch in arrow.to_batches():
            where = batch.column("aspect").to_numpy(), batch.column("term_id").to_numpy()
            cells[where] = square(batch.column("b"))
        return cells


@dataclass(frozen=True)
class Prior:
    """Inverse of the prior covariance and half the log of its determinant."""

    precision: np.ndarray
    entropy: float

    @staticmethod
    def of(covariance: np.ndarray) -> Prior:
        return Prior(np.linalg.inv(covariance), 0.5 * float(np.linalg.slogdet(covariance)[1]))


def share_topics(topics: Topics, topic_bytes: int = TOPIC_BYTES) -> Broadcast | None:
    """The topics as a broadcast array, if they are small enough. Whoever iterates destroys it
    once the result is stored."""
    if topics.bytes > topic_bytes:
        return None
    return topics.table.sparkSession.sparkContext.broadcast(topics.array())


def infer(
    documents: DataFrame,
    topics: Topics,
    prior: Prior,
    aspects: int = 1,
    detail: bool = False,
    topic_bytes: int = TOPIC_BYTES,
    shared: Broadcast | None = None,
    sums: bool = True,
    gamma: np.ndarray | None = None,
) -> DataFrame:
    """Most probable logits of every document, with what the M-step needs.

    ``documents``: doc_id, aspect, term_ids, counts, eta (start) and mu; with a column x
    also the sums of products of (x, eta). With ``gamma`` the tasks take mu as x times these
    coefficients instead. Result rows by ``kind``:

        doc        doc_id, aspect, vec = eta, bound
        unsettled  doc_id of a document whose search ran out of steps
        nu         row idx of the summed posterior covariances, one sum per task
        phi        expected topic counts of term idx under an aspect, summed per task
        weight     expected topic counts of all terms together, one sum per task
        moment     row idx of the summed products of (x, eta), one sum per task; of eta alone where x is sparse
        cross      where x is sparse: row idx of the summed products of x with eta, one sum per task
        doc_nu     with ``detail``: row idx of a document's posterior covariance
        doc_phi    with ``detail``: expected topic counts of term idx in a document

    Without ``sums`` only rows of the first two kinds are worked out. Topics up to ``topic_bytes`` go to every task
    as one array, ``shared`` if the caller made it by ``share_topics``. Larger ones go where they are needed: each
    block of documents gets the topics of its own terms, once per term and block.
    """
    columns = ["doc_id", "aspect", "term_ids", "counts", "eta"]
    columns += [c for c in documents.columns if c == "x" and (sums or gamma is not None)]
    columns += ["mu"] if gamma is None else []
    shared = shared or share_topics(topics, topic_bytes)
    rows = documents.select(*columns)
    task = _Task(shared, topics.topics, topics.terms, topics.aspects, prior, detail and sums, sums)
    if gamma is not None:
        task.gamma = documents.sparkSession.sparkContext.broadcast(np.ascontiguousarray(gamma))
    if shared is not None:
        return rows.mapInArrow(task, RESULT)
    placed, dictionary = _blocks(rows, topics)
    return placed.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(lambda left, right: task.block(left, right), RESULT)


def _blocks(documents: DataFrame, topics: Topics, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents with their block, and (block, [aspect,] term_id, b) of every term of a block. Documents are
    shuffled as they are, without topics; blocks are as many as keep the topics of one below ``block_bytes``."""
    entries = documents.agg(F.sum(F.size("term_ids"))).first()[0] or 0
    blocks = max(1, math.ceil(entries * 8 * topics.topics / block_bytes))
    dealt = documents.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block")
    keys = ["aspect", "term_id"] if topics.aspects > 1 else ["term_id"]
    found = dealt.select("block", *keys[:-1], F.explode("term_ids").alias("term_id")).distinct()
    # A term is there once per block at most, so no key is frequent and no topics need to be repeated.
    known = lookup_join(found, topics.table, keys, topics.bytes, spread="term_id")
    # Columns of their own: the two sides come from one table.
    return dealt, known.select(*(F.col(c).alias(c) for c in ("block", *keys)), "b")


class _Task:
    """The work of one task: solve its documents in chunks, keep the sums."""

    def __init__(self, shared, topics, terms, aspects, prior, detail, sums):
        self.shared, self.topics, self.terms, self.aspects = shared, topics, terms, aspects
        self.prior, self.detail, self.sums = prior, detail, sums
        self.gamma: Broadcast | None = None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self._solved(batches, lambda aspect, terms: self.shared.value[aspect, terms])

    def block(self, documents: pa.Table, dictionary: pa.Table) -> pa.Table:
        """A block of documents with the topics of its terms; a term without topics has probability 0."""
        dictionary = dictionary.combine_chunks()
        aspect = dictionary.column("aspect").to_numpy() if self.aspects > 1 else 0
        key = aspect * self.terms + dictionary.column("term_id").to_numpy().astype(np.int64)
        order = np.argsort(key)
        known = np.append(key[order], np.iinfo(np.int64).max)
        cells = np.zeros((len(known), self.topics))
        if len(order):
            cells[:-1] = square(dictionary.column("b").combine_chunks())[order]

        def values(aspect: np.ndarray | int, terms: np.ndarray) -> np.ndarray:
            wanted = aspect * self.terms + terms.astype(np.int64)
            place = np.searchsorted(known, wanted)
            return cells[np.where(known[place] == wanted, place, len(known) - 1)]

        return pa.Table.from_batches(self._solved(documents.combine_chunks().to_batches(), values), _SCHEMA)

    def _solved(self, batches: Iterator[pa.RecordBatch], values: Callable) -> Iterator[pa.RecordBatch]:
        size = self.topics - 1
        nu_sum, weight = np.zeros((size, size)), np.zeros((1, self.topics))
        moment = cross = None
        phi = _Counts(self.terms, self.topics, BLOCK_BYTES if self.shared is None else PHI_BYTES)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            doc_ids = batch.column("doc_id").to_numpy()
            aspects = batch.column("aspect").to_numpy()
            eta, bound = np.empty((len(doc_ids), size)), np.empty(len(doc_ids))
            settled = np.empty(len(doc_ids), bool)
            x = Vectors(batch.column("x")) if "x" in batch.schema.names else None
            mu = square(batch.column("mu")) if self.gamma is None else x.times(self.gamma.value)
            for rows, ids, at, done, result in self._chunks(batch, aspects, mu, values):
                eta[rows], bound[rows], settled[rows] = result.eta, result.bound, done
                if not self.sums:
                    continue
                nu_sum += result.nu.sum(axis=0)
                counts = result.phi[at]
                weight += counts.sum(axis=0)
                yield from phi.add(aspects[rows][at[0]], ids, counts)
                if self.detail:
                    yield _rows("doc_phi", ids, counts, doc_id=doc_ids[rows][at[0]])
                    index = np.tile(np.arange(size), len(rows))
                    yield _rows(
                        "doc_nu", index, result.nu.reshape(-1, size), doc_id=np.repeat(doc_ids[rows], size)
                    )
            yield _rows("doc", None, eta, doc_id=doc_ids, aspect=aspects, bound=bound)
            if not settled.all():
                yield _rows("unsettled", None, eta[~settled], doc_id=doc_ids[~settled], aspect=aspects[~settled])
            if x is not None and self.sums:
                both = eta if x.dense is None else np.hstack([x.dense, eta])
                moment = both.T @ both if moment is None else moment + both.T @ both
                if x.dense is None:
                    cross = _grown(cross, 1 + int(x.at.max(initial=0)), size)
                    x.add_crossed(cross, eta)
        if seen and self.sums:
            yield _rows("nu", np.arange(size), nu_sum)
            yield _rows("weight", None, weight)
        if moment is not None:
            yield _rows("moment", np.arange(len(moment)), moment)
        if cross is not None:
            some = np.flatnonzero(cross.any(axis=1))
            yield _rows("cross", some, cross[some])
        yield from phi.rows()

    def _chunks(self, batch: pa.RecordBatch, aspects: np.ndarray, mu: np.ndarray, values: Callable):
        """Documents of similar length together, padded to the longest. Yields the rows of
        a chunk, its term ids, their places in the padded arrays, which rows settled, and the solution."""
        ids, starts = ragged(batch.column("term_ids"))
        counts, _ = ragged(batch.column("counts"))
        eta = square(batch.column("eta"))
        lengths = np.diff(starts)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # Lengths rise along the order: the last document of a chunk is its longest.
            # Besides terms x topics a document needs topics x topics for its curvature.
            width = np.maximum(lengths[order[at:]], self.topics)
            fits = width * np.arange(1, len(width) + 1) * self.topics <= CHUNK_CELLS
            rows = order[at : at + max(1, int(np.count_nonzero(fits)))]
            at += len(rows)
            long = lengths[rows]
            doc = np.repeat(np.arange(len(rows)), long)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(long) - long, long)
            source = np.repeat(starts[rows], long) + place
            terms = ids[source]
            padded = np.zeros((len(rows), max(1, long.max()), self.topics))
            padded[doc, place] = values(aspects[rows][doc].astype(np.int64) if self.aspects > 1 else 0, terms)
            weight = np.zeros(padded.shape[:2])
            weight[doc, place] = counts[source]
            best, settled = search(padded, weight, eta[rows], mu[rows], self.prior.precision)
            result = evaluate(padded, weight, best, mu[rows], self.prior.precision, self.prior.entropy, self.sums)
            yield rows, terms, (doc, place), settled, result


def _grown(rows: np.ndarray | None, height: int, width: int) -> np.ndarray:
    """The array with at least so many rows."""
    if rows is None:
        return np.zeros((height, width))
    return rows if len(rows) >= height else np.vstack([rows, np.zeros((max(height, 2 * len(rows)) - len(rows), width))])


class _Counts:
    """Expected topic counts by aspect and term, summed in the task. Whole arrays where they fit ``limit``;
    else the terms met so far, sorted, handed on when they have grown to it."""

    def __init__(self, terms: int, topics: int, limit: int):
        self.terms, self.topics, self.limit = terms, topics, limit
        self.dense: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys, self.sums = np.empty(0, np.int64), np.empty((0, self.topics))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, aspects: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(terms):
            return
        keys, sums = _sum_by(aspects.astype(np.int64) * self.terms + terms, counts)
        for aspect in np.unique(keys // self.terms).tolist():
            if 8 * self.terms * self.topics * (len(self.dense) + (aspect not in self.dense)) <= self.limit:
                self.dense.setdefault(aspect, np.zeros((self.terms, self.topics)))
        whole = np.isin(keys // self.terms, list(self.dense))
        for aspect, table in self.dense.items():
            ours = keys // self.terms == aspect
            table[keys[ours] % self.terms] += sums[ours]
        if not whole.all():
            self.new.append((keys[~whole], sums[~whole]))
            self.waiting += int((~whole).sum())
            if 8 * self.topics * self.waiting >= self.limit // 4:
                self._merge()
                if 8 * self.topics * len(self.keys) >= self.limit // 2:
                    yield from self._sparse_rows()

    def _merge(self) -> None:
        keys, sums = zip((self.keys, self.sums), *self.new)
        self.keys, self.sums = _sum_by(np.concatenate(keys), np.concatenate(sums))
        self.new, self.waiting = [], 0

    def _sparse_rows(self) -> Iterator[pa.RecordBatch]:
        some = self.sums.any(axis=1)  # as below: a term without topics has no row
        keys = self.keys[some]
        yield _rows("phi", keys % self.terms, self.sums[some], aspect=keys // self.terms)
        self.clear()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for aspect, sums in self.dense.items():
            terms = np.flatnonzero(sums.any(axis=1))
            yield _rows("phi", terms, sums[terms], aspect=aspect)
        self._merge()
        if len(self.keys):
            yield from self._sparse_rows()


def _sum_by(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ids):
        return ids, values
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    return ids[first], np.add.reduceat(values[order], first, axis=0)


def _rows(kind, index, vectors, doc_id=None, aspect=None, bound=None) -> pa.RecordBatch:
    count = len(vectors)

    def column(values, dtype):
        if values is None:
            return pa.nulls(count, dtype)
        return pa.array(np.broadcast_to(np.asarray(values), (count,)), dtype)

    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * count, pa.string()),
            column(doc_id, pa.int64()),
            column(aspect, pa.int32()),
            column(index, pa.int32()),
            list_column(vectors),
            column(bound, pa.float64()),
        ],
        schema=_SCHEMA,
    )
