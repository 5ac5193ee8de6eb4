"""Documents to packed training sequences: quality rules, language, near duplicates, mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm.language import UNKNOWN, fit_languages, predict_languages
from themeloom.llm.mixing import mix
from themeloom.llm.ngram_join import JoinParams, ngram_join
from themeloom.llm.packing import pack
from themeloom.llm.quality import quality_rules, without_lines
from themeloom.llm.queries import word_tokenizer
from themeloom.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language is less certain than this is in none that was learned.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many texts of a source share are cut out of the rest."""
    kept = quality_rules(Workspace(spark), docs, COLUMNS).where("kept")
    cut = F.size("cut_lines") > 0
    rows = kept.select(
        "row.doc_id", without_lines("row.text", "cut_lines").alias("text"), "row.lang", "row.source", "row.n_chars", cut.alias("cut")
    )
    return rows.withColumn("n_chars", F.when(F.col("cut"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; a missing ``lang`` becomes the predicted one."""
    found = predict_languages(docs, fit_languages(docs), COLUMNS)
    known = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select("row.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 80 %); rows without id stay."""
    groups = ngram_join(Workspace(spark), docs, params=JoinParams(width=5, percent=80))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mix(Workspace(spark), docs, COLUMNS).where("copies > 0")
    return mixed.select("row.*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, word_tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: The tokenizer and the language model can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = space.table(stage(spark, docs, sf_dir), f"{number}_{name}")
    return docs
