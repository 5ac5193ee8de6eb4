"""From texts and term counts to the corpus the model is fitted on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from themeloom.lookup import BROADCAST_BYTES, lookup_join
from themeloom.workspace import Workspace

WORD_PATTERN = r"\p{L}+"
ADDED_ROWS = 1 << 11   # documents whose entries are put in order together
PART_TOKENS = 1 << 17  # tokens that are counted together, unless one document has more


# --- words -----------------------------------------------------------------------


def split_words(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of each line, split at single spaces, as column ``word``.

    Spaces at the end of a line yield nothing, repeated or leading ones yield empty
    words, an empty line yields one empty word.
    """
    line = F.col(column)
    trimmed = F.rtrim(line)
    words = (
        F.when(line == "", F.array(F.lit("")))
        .when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, " "))
    )
    return lines.select(*keep, F.explode(words).alias("word"))


def word_counts(words: DataFrame) -> DataFrame:
    """(word, cnt). Summed in each task before the shuffle, so hot words are cheap."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def doc_terms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, cnt) of lower-cased runs of letters in the whole text.

    A document is one row, so all its tokens are in one task: they are counted there,
    without a shuffle, some documents of a batch at a time.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    rows = documents.where(F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("doc_id"), tokens.alias("tokens")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                column = part.column("tokens")
                words = pa.table(
                    {
                        "doc_id": pc.take(part.column("doc_id"), pc.list_parent_indices(column)),
                        "term": pc.list_flatten(column),
                    }
                )
                counted = words.group_by(["doc_id", "term"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["doc_id", "term", "cnt"]).to_batches()

    return rows.mapInArrow(count, "doc_id BIGINT, term STRING, cnt BIGINT")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents of a batch, up to ``PART_TOKENS`` at a time; rows with one id stay together."""
    if pc.count_distinct(batch.column("doc_id"), mode="all").as_py() < batch.num_rows:
        batch = batch.take(pc.sort_indices(batch.column("doc_id")))
    names, first = batch.column("doc_id").to_pylist(), 0
    ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False), dtype=np.int64)
    while first < len(names):
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + PART_TOKENS, "right")))
        while end < len(names) and names[end] == names[end - 1]:
            end += 1
        yield batch.slice(first, end - first)
        first = end


# --- vocabulary ------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Stored table (term_id, term, df, total) with its measured size. ``entries`` is the
    number of (document, term) pairs, the sum of the document frequencies, where it is known."""

    table: DataFrame
    terms: int
    bytes: int
    entries: int | None


def vocabulary(
    space: Workspace, terms: DataFrame, documents: int, min_doc_share: float, name: str = "vocabulary"
) -> Vocabulary:
    """Terms held by at least ``min_doc_share`` of the documents; share 0 keeps all.

    Ids are 0-based in the order of falling document frequency, then by term.
    """
    counted = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("cnt").cast("bigint").alias("total")
    )
    kept = counted.where(F.col("df") >= F.lit(min_doc_share * documents))
    ranked = with_ranks(space, kept, [F.desc("df"), F.asc("term")], "term_id", name)
    table = space.table(ranked.select(F.col("term_id").cast("int"), "term", "df", "total"), name)
    size = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0)).alias("b"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("e"),
    ).first()
    return Vocabulary(table, size["n"], size["b"], size["e"])


def with_ranks(space: Workspace, df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """Add the 0-based rank in the given total order, without sorting in one task.

    Rows are range-partitioned and stored with their place inside their partition;
    the only ordered step over everything adds up one count per partition.
    """
    place = F.monotonically_increasing_id()
    placed = space.table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(place, 33))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))),
        f"{name}_placed",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    ranked = placed.join(F.broadcast(starts), "_part")
    return ranked.withColumn(column, F.col("_start") + F.col("_place")).drop(
        "_part", "_place", "_start"
    )


def document_term(terms: DataFrame, vocab: Vocabulary, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Triplets (doc_id, term_id, cnt) of the terms in the vocabulary.

    Ids fall with the document frequency. Of a vocabulary beyond ``limit`` bytes the most frequent terms
    are sent to all tasks, as many as fit half of it, and their entries stay where they are; only the entries of the
    others are shuffled, once, and so are their ids: none of them is frequent enough for a skewed join.
    """
    ids = vocab.table.select("term", "term_id")
    if vocab.bytes <= limit:
        return lookup_join(terms, ids, "term", vocab.bytes, spread="doc_id").select("doc_id", "term_id", "cnt")
    frequent = F.col("term_id") < F.lit(vocab.terms * limit // (2 * vocab.bytes))
    sent = F.broadcast(ids.where(frequent))
    near = terms.join(sent, "term")
    far = terms.join(sent, "term", "left_anti").join(ids.where(~frequent).hint("merge"), "term")
    return near.unionByName(far).select("doc_id", "term_id", "cnt")


def document_term_matrix(triplets: DataFrame) -> DataFrame:
    """The same, from triplets that may repeat a (document, term) pair."""
    return triplets.groupBy("doc_id", "term_id").agg(F.sum("cnt").alias("cnt"))


# --- sums and index sets ---------------------------------------------------------


def terms_per_document(triplets: DataFrame) -> DataFrame:
    """Distinct terms of each document."""
    return triplets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def document_lengths(triplets: DataFrame) -> DataFrame:
    """Tokens of each document."""
    return triplets.groupBy("doc_id").agg(F.sum("cnt").alias("n"))


def term_totals(triplets: DataFrame) -> DataFrame:
    """Tokens of each term."""
    return triplets.groupBy("term_id").agg(F.sum("cnt").alias("total"))


def word_probability(totals: DataFrame) -> DataFrame:
    """Share of each term in all tokens."""
    tokens = totals.agg(F.sum("total").cast("double")).scalar()
    return totals.select("term_id", (F.col("total") / tokens).alias("prob"))


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows whose value reaches the threshold."""
    return df.where(F.col(column) >= F.lit(threshold))


def index_difference(everything: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Keys of ``everything`` that ``drop`` does not hold."""
    return everything.select(key).join(drop.select(key), key, "left_anti")


def zero_terms(vocab: DataFrame, row_sums: DataFrame) -> DataFrame:
    """Vocabulary terms without any co-occurrence."""
    return index_difference(vocab, row_sums.where(F.col("s") > 0), "term_id")


def drop_terms(df: DataFrame, dropped: DataFrame, *columns: str, terms: int | None = None) -> DataFrame:
    """Remove the terms of ``dropped`` from every named index column. If the caller knows that there are at most
    ``terms`` of them, they are sent to the rows up to the usual size."""
    for column in columns:
        ids = dropped.select(F.col("term_id").alias(column))
        if terms is None or 16 * terms > BROADCAST_BYTES:
            df = df.join(ids, column, "left_anti")
        else:
            df = df.join(F.broadcast(ids), column, "left_anti")
    return df


def check_dimensions(topics: int, terms: int) -> None:
    if topics >= terms:
        raise ValueError(f"{topics} topics need more than {terms} terms in the vocabulary")


# --- distribution ----------------------------------------------------------------


def corpus_rows(triplets: DataFrame, documents: DataFrame, partitions: int) -> DataFrame:
    """One row per document, spread by ``doc_id``: the input of inference.

    ``documents`` holds doc_id, aspect and covariates x for every document, also those
    without a vocabulary term; the result adds n, term_ids and counts. One shuffle
    brings entries and attributes together, neighbouring entries of a document as one row; counts of a
    repeated (document, term) pair are added up there, without another. A row holds one entry per vocabulary term at most, so
    its size does not grow with the text.
    """
    entries = triplets.select("doc_id", F.col("term_id").cast("int").alias("term_id"), F.col("cnt").cast("double").alias("cnt"))
    key = entries.schema["doc_id"].dataType.simpleString()
    parts = entries.mapInArrow(_runs, f"doc_id {key}, part STRUCT<term_ids: ARRAY<INT>, counts: ARRAY<DOUBLE>>")
    together = parts.unionByName(documents.select("doc_id", "aspect", "x"), allowMissingColumns=True)
    grouped = together.repartition(partitions, "doc_id").groupBy("doc_id").agg(
        F.coalesce(F.max("aspect"), F.lit(0)).alias("aspect"),
        F.first("x", ignorenulls=True).alias("x"),
        F.collect_list("part").alias("parts"),
    )
    kept = ", ".join(f"{c} {grouped.schema[c].dataType.simpleString()}" for c in ("doc_id", "aspect", "x"))
    return grouped.mapInArrow(_added_parts, f"{kept}, n DOUBLE, term_ids ARRAY<INT>, counts ARRAY<DOUBLE>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring entries of a document as one row; entries without a term leave the row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, term = batch.column("doc_id"), batch.column("term_id")
        changed = [v[1:] != v[:-1] for v in (pc.fill_null(doc, 0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False))]
        first = np.append(0, 1 + np.flatnonzero(changed[0] | changed[1]))
        some = term.is_valid().to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(np.add.reduceat(some, first, dtype=np.int64))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, c.filter(pa.array(some))) for c in (term, batch.column("cnt"))]
        part = pa.StructArray.from_arrays(lists, names=["term_ids", "counts"])
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(first)), part], names=["doc_id", "part"])


def _added_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of every document in the order of their terms; counts of a term are added up."""
    for whole in batches:
        for at in range(0, whole.num_rows, ADDED_ROWS):
            batch = whole.slice(at, ADDED_ROWS)
            parts = batch.column("parts")
            doc = pc.list_parent_indices(parts).to_numpy()
            terms, counts = (pc.struct_field(parts.flatten(), c) for c in ("term_ids", "counts"))
            doc = doc[pc.list_parent_indices(terms).to_numpy()]
            key = (doc << 32) + terms.flatten().to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            added = counts.flatten().to_numpy(zero_copy_only=False)[order]
            added, doc = np.add.reduceat(added, first) if len(first) else added, doc[order][first]
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))).astype(np.int32)
            found = (key[first] & 0xFFFFFFFF).astype(np.int32), added
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in found]
            n = pa.array(np.bincount(doc, added, minlength=batch.num_rows).astype(np.float64))
            names = ["doc_id", "aspect", "x", "n", "term_ids", "counts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), n, *columns], names=names)


def corpus_entries(corpus: DataFrame, *keep: str) -> DataFrame:
    """Back to long form: (doc_id, kept columns, term_id, cnt)."""
    entries = F.arrays_zip(F.col("term_ids").alias("term_id"), F.col("counts").alias("cnt"))
    rows = corpus.select("doc_id", *keep, F.explode(entries).alias("e"))
    return rows.select("doc_id", *keep, "e.term_id", "e.cnt")
