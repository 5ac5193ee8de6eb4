"""Every query that SQL can state against its SQL, and all others on whole tables."""

from __future__ import annotations

import glob
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from counted import exact_scores
from themeloom.llm.language import UNKNOWN
from themeloom.llm.lm import LmParams
from themeloom.llm.oracles import ORACLES
from themeloom.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return connection


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, database, name):
    found, wanted = QUERIES[name](spark, FOLDER).toPandas(), database.execute(ORACLES[name]).fetchdf()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns) and len(found) == len(wanted)
    found, wanted = (x[columns].sort_values(columns).reset_index(drop=True) for x in (found, wanted))
    for column in columns:
        same = (found[column] == wanted[column]) | (found[column].isna() & wanted[column].isna())
        assert same.all(), f"{column}: {found[~same].head(3).to_dict('records')} {wanted[~same].head(3).to_dict('records')}"


def test_urls_against_brute_force(spark):
    found = QUERIES["op1_url_rules"](spark, FOLDER).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for row in found:
        rest = (urls[row["page_id"]] or "").partition("://")[2].replace("#", "?").split("?")[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (rules[rule] if rule else "block" if row["mined_rule"] else "allow")
    assert len(found) == len(urls)


def test_languages_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op2_language"](spark, FOLDER).collect()
    assert len(found) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held if docs[r["doc_id"]]["lang"] and r["lang_pred"] != UNKNOWN]
    assert np.mean(right) > 0.95


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces = QUERIES["op4_packing"](spark, FOLDER).collect()
    check_pieces(pieces, ids)


def check_pieces(pieces, ids):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        end = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == end and p["doc_tokens"] == len(ids[doc])
            end += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][p["start"] : end], "<u4").tobytes())
        assert end == len(ids[doc])
    padding = 0
    for parts in by_sequence.values():
        end = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding < 0.02 * sum(map(len, ids.values()))


def test_scores_against_brute_force(spark, texts):
    found = QUERIES["op10_lm_scores"](spark, FOLDER).collect()
    lower = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, words in lower.items() if not held[i] for w in words)
    total, types = sum(counts.values()), len(counts)
    exact = exact_scores({i: t[:-1] for i, t in lower.items()}, [i for i in texts if not held[i]], LmParams().prior)
    assert len(found) == len(texts)
    for row in found:
        words = lower[row["doc_id"]]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[row["doc_id"]], len(words), total)
        assert row["n_known"] == sum(counts[w] > 0 for w in words)
        assert row["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words), rel=1e-9)
        # A false entry, one probe of an absent level in 256, changes a count.
        assert row["score"] == pytest.approx(exact[row["doc_id"]], rel=0.01, abs=1)
    assert sum(r["score"] for r in found) == pytest.approx(sum(exact.values()), rel=0.005)
    # Held-out texts are more probable under pairs of words than under words alone.
    held_rows = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)


def test_pipeline(spark):
    """The stages one after the other, each against the verdicts on its own input."""
    from corpus_pipeline import COLUMNS, STAGES, run

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rejected = QUERIES["op9_quality_rules"](spark, FOLDER).where("not kept").select("doc_id")
    kept = dict(STAGES)["quality_rules"](spark, docs, FOLDER).cache()
    assert kept.columns == COLUMNS
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").exceptAll(rejected).collect()}
    one = dict(STAGES)["ngram_jaccard_join"](spark, kept, FOLDER).cache()
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    root = {a: a for a in sets}
    for _ in sets:
        for a, b in sorted(links):
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in one.collect()} == set(root.values())
    packed = run(spark, FOLDER)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
