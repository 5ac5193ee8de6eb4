"""Language identification by words, with character n-grams for words never seen.

Per language the model holds log frequencies of words and of character n-grams. A known word
counts with its own log frequency; an unseen one with those of its longest n-grams that are
known, falling back from five characters to one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom.llm.words import text_batches

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``sample`` bounds the labelled documents per language that the model is fitted on, taken
    by a hash of their text's id; ``words`` and ``grams`` are the entries that every language brings in, its most
    frequent ones, so that none takes another's place. Every language gets ``smoothing`` entries more of each kind,
    divided as all languages' entries are, so one with few texts gains nothing by that."""

    sample: int = 2000
    words: int = 50_000
    grams: int = 25_000
    longest: int = 5
    smoothing: float = 10.0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    """Character n-grams of the word between marks of its ends; single characters without."""
    marked = f"<{word}>" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language, one row per entry. ``words`` and ``grams`` give the rows."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    longest: int
    seen: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def unseen(self, word: str) -> np.ndarray:
        """Mean of the known n-grams of the largest size that has any; zeros if none has."""
        found = self.seen.get(word)
        if found is None:
            found = np.zeros(len(self.languages))
            for size in range(min(self.longest, len(word) + 2), 0, -1):
                rows = [self.grams[g] for g in grams_of(word, size) if g in self.grams]
                if rows:
                    found = self.gram_logs[rows].mean(axis=0)
                    break
            if len(self.seen) >= 50_000:
                self.seen.clear()
            if len(word) <= 64:
                self.seen[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The most probable language, and the share of its mean probability per word among
        all languages. A text that is null or has no letter is ``und`` with score 0, and so is any text
        where nothing was learned. Equal scores go to the first language by code point."""
        words = words_of(text) if text else []
        if not words or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        rows = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        total = self.word_logs[rows[rows >= 0]].sum(axis=0)
        for place in np.flatnonzero(rows < 0):
            total = total + self.unseen(words[place])
        mean = total / len(words)
        best = int(np.argmax(mean))
        return self.languages[best], float(1.0 / np.exp(mean - mean[best]).sum())


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, entry, n) of the words of all texts."""
    given = text_batches(docs).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                counts.setdefault(name, Counter()).update(words_of(value))
            for name, found in counts.items():
                yield _rows(0, name, found).drop_columns("kind")

    found = given.mapInArrow(run, "lang STRING, entry STRING, n BIGINT")
    return found.groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, longest: int) -> DataFrame:
    """(kind, lang, entry, n): n-grams of each size, one for each distinct word they are in, so
    frequent words don't decide them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], Counter] = {}
            for name, word in zip(batch.column("lang").to_pylist(), batch.column("entry").to_pylist()):
                for size in range(1, longest + 1):
                    counts.setdefault((name, size), Counter()).update(grams_of(word, size))
            for (name, size), found in counts.items():
                yield _rows(size, name, found)

    found = words.select("lang", "entry").mapInArrow(run, "kind INT, lang STRING, entry STRING, n BIGINT")
    return found.groupBy("kind", "lang", "entry").agg(F.sum("n").alias("n"))


def _rows(kind: int, lang: str, counts: Counter) -> pa.RecordBatch:
    rows = len(counts)
    columns = [pa.array([kind] * rows, pa.int32()), pa.array([lang] * rows, pa.string()), pa.array(counts.keys(), pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["kind", "lang", "entry", "n"])


def fit_languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", params: LanguageParams = LanguageParams()
) -> LanguageModel:
    """Fit on a bounded sample of the documents with text and label. The driver receives at most
    ``params.words + params.grams`` entries for each language, with their counts by language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    # A document is in when the hash of its key falls under the share its language needs.
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col(lang) == name) & (share < min(1.0, params.sample / totals[name])))
    counted = count_words(labelled.where(chosen), text, lang).persist()
    try:
        words = _most_frequent(counted, ["entry"], params.words, languages).toArrow()
        grams = _most_frequent(count_grams(counted, params.longest), ["kind", "entry"], params.grams, languages).toArrow()
    finally:
        counted.unpersist()
    word_rows, word_logs = _logs(words, languages, params.smoothing)
    gram_rows, gram_logs = _logs(grams, languages, params.smoothing)
    return LanguageModel(languages, word_rows, word_logs, gram_rows, gram_logs, params.longest)


def _most_frequent(counted: DataFrame, entry: list[str], most: int, languages: list[str]) -> DataFrame:
    """(entry, n0, n1, ...): the entries that are among the ``most`` frequent of a language, with their counts in all."""
    own = Window.partitionBy("lang").orderBy(F.desc("n"), *entry)
    top = counted.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most).select(*entry).distinct()
    counts = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{k}") for k, name in enumerate(languages)]
    return counted.join(top, entry, "left_semi").groupBy(*entry).agg(*(counts or [F.count("n").alias("n")])).orderBy(*entry)


def _logs(found: pa.Table, languages: list[str], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies among the entries of one kind and language."""
    rows = found.num_rows
    table = np.array([found.column(f"n{k}").to_numpy() for k in range(len(languages))], float).T.reshape(rows, len(languages))
    kinds = found.column("kind").to_numpy() if "kind" in found.column_names else np.zeros(rows, int)
    logs = np.zeros_like(table)
    for k in np.unique(kinds):
        part = table[kinds == k]
        every = part.sum(axis=1, keepdims=True) / part.sum()
        logs[kinds == k] = np.log((part + smoothing * every) / (part.sum(axis=0) + smoothing))
    return {entry: i for i, entry in enumerate(found.column("entry").to_pylist())}, logs


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``row`` (a struct of the kept columns), ``lang_pred`` and ``score`` for every row; see
    ``LanguageModel.predict`` for null and letterless texts."""
    apart = text not in keep  # else it is read from the row
    own = [F.col(text).alias("text")] if apart else []
    given = text_batches(docs).select(F.struct(*keep).alias("row"), *own)
    # Plain data: workers need no copy of this package to read it.
    parts = (model.languages, model.words, model.word_logs, model.grams, model.gram_logs, model.longest)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = LanguageModel(*shared.value)
        for batch in batches:
            texts = batch.column("text") if apart else batch.column("row").field(text)
            found = [own_model.predict(value) for value in texts.to_pylist()]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), names, scores], ["row", "lang_pred", "score"])

    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {row}, lang_pred STRING, score DOUBLE")


def held_out(key: str | Column, parts: int, part: int) -> Column:
    """True for the rows whose id, as text, has this remainder of its CRC-32. A null id has none."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
