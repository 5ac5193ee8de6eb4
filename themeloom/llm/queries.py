"""The operators as registered queries: each reads whole tables and returns every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm.chat import ChatParams, format_turns, read_back
from themeloom.llm.divergence import audit_divergence
from themeloom.llm.filter_audit import audit_filters
from themeloom.llm.language import fit_languages, held_out, predict_languages
from themeloom.llm.licenses import scan_licenses
from themeloom.llm.lm import lm_scores
from themeloom.llm.mixing import mix
from themeloom.llm.near_vectors import near_vectors
from themeloom.llm.ngram_join import ngram_join
from themeloom.llm.packing import PackParams, pack
from themeloom.llm.quality import quality_rules
from themeloom.llm.repeats import remove_repeats
from themeloom.llm.url_rules import UrlParams, filter_urls
from themeloom.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_tokenizer() -> PackParams:
    """The public tokenizer that packing uses; workers have its file at the same place."""
    import public_tokenizers

    return PackParams(public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit_languages(docs.where(~held_out("doc_id", 4, 2)))
    found = predict_languages(docs, model, ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    pieces = pack(table(spark, folder, "documents"), word_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents linked at 90 % Jaccard similarity of 3-word shingles."""
    return ngram_join(Workspace(spark), table(spark, folder, "documents"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150 % takes from every document."""
    mixed = mix(Workspace(spark), table(spark, folder, "documents"), ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and verdict of every document. Lines are counted by distinct texts of a source: copies count once."""
    found = quality_rules(Workspace(spark), table(spark, folder, "documents"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page. A page has the labels of the document with its id: bad ones are
    those of low quality and toxic ones. Rules are pruned by support and confidence alone."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    )
    judged = filter_urls(Workspace(spark), table(spark, folder, "pages"), labels, UrlParams(certainty=0.0))
    return judged.withColumn("mined_rule", F.array_join("mined_rule", " "))


@query
def op3_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of a label at a cosine of 0.93."""
    return near_vectors(Workspace(spark), table(spark, folder, "embeddings"))


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence statements in every document."""
    found = scan_licenses(table(spark, folder, "documents"))
    joined = [F.array_join(c, " ").alias(c) for c in ("sentences", "licenses")]
    return found.select("doc_id", *joined, "unmatched", "verdict")


#: A conversation whose texts hold the strings of a template.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@query
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation and one with control strings, read back from its tokens."""
    import public_tokenizers

    params = ChatParams(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = [(-7, k, role, CONTROL_TEXT) for k, role in enumerate(("user", "assistant"))]
    every = turns.unionByName(spark.createDataFrame(odd, "conv_id BIGINT, turn BIGINT, role STRING, text STRING"))
    return read_back(format_turns(every, params), params)


@query
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document under a model of the documents that are not held out."""
    docs = table(spark, folder, "documents")
    found = lm_scores(Workspace(spark), docs, ~held_out("doc_id", 7, 2))
    return found.withColumn("held_out", held_out("doc_id", 7, 2))


@query
def op11_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of windows that an earlier document has."""
    left = remove_repeats(table(spark, folder, "documents"), ["doc_id"])
    return left.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How every source differs from the others of its language, and its most telling terms."""
    return audit_divergence(Workspace(spark), table(spark, folder, "documents"))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters do to every source in all their orders."""
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))
