"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from counted import exact_scores
from themeloom.llm.components import components
from themeloom.llm.language import LanguageParams, fit_languages, predict_languages
from themeloom.llm.licenses import SENTENCES, scan_licenses
from themeloom.llm.lm import Filter, LmParams, find_levels, levels, lm_scores, pack_chunks
from themeloom.llm.mixing import MixParams, expected_copies, mix, word_count
from themeloom.llm.ngram_join import JoinParams, _frequencies, _grades, _sets, ngram_join, open_pairs, prefix_of
from themeloom.llm.packing import Bins, WordEncoder, cuts, pack
from themeloom.llm.quality import QualityParams, quality_rules, repeat_words, without_lines
from themeloom.llm.queries import word_tokenizer

LONG = " ".join(f"w{i}x{i * i % 97}" for i in range(30_000))
_ENCODER = WordEncoder(word_tokenizer().tokenizer)
PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, PROSE, "en", None),
    (5, PROSE, "en", None), (6, PROSE.upper(), None, "a"), (None, PROSE, "en", "a"), (7, "one two", "en", "b"), (8, "one two", "de", "b"),
    (9, "123 456 !!", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(documents):
    return documents(ROWS)


def rows(df, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def test_quality(space, odd):
    found = quality_rules(space, odd, ["doc_id"])
    got = rows(found, "row.doc_id", "n_words", "base_failed", "kept")
    assert len(got) == len(ROWS)
    assert [g[:4] for g in got if g[0] in (1, 2, 3)] == [(1, 0, True, False), (2, 0, True, False), (3, 0, True, False)]
    assert [g for g in got if g[0] == 5] == [(5, 60, False, True)] * 2
    assert (4, 30_000, False, True) in got and (None, 60, False, True) in got


def test_quality_lines(space, documents):
    """A line in many texts of a host goes, copies of a text count once, and what is left decides."""
    head = "Subscribe to our letter 12 today"
    own = lambda k: " ".join(f"t{k}n{i}" for i in range(60))
    many = [(k, f"{head}\n{own(k)}", "en", "a") for k in range(12)]
    short = [(100 + k, f"{head.replace('12', '99')}\n" * 10 + f"own{k}", "en", "a") for k in range(2)]
    copies = [(200 + k, f"copied line of one text\n{own(999)}", "en", "a") for k in range(30)]
    other = [(300, f"{head}\n{own(300)}", "en", "b")]
    found = quality_rules(space, documents([*many, *short, *copies, *other]), ["doc_id", "text"]).withColumn(
        "left", without_lines("row.text", "cut_lines")
    )
    got = {r["row"]["doc_id"]: r for r in found.collect()}
    assert all(got[k]["left"] == own(k) and got[k]["left_words"] == 60 and got[k]["kept"] for k in range(12))
    assert not any(got[100 + k]["kept"] for k in range(2))
    assert all(got[200 + k]["kept"] and len(got[200 + k]["cut_lines"]) == 0 for k in range(30))
    assert got[300]["left"] == f"{head}\n{own(300)}"


def test_lines_of_a_large_host(space, documents):
    """However large the host is, a line in more than the most texts goes; one in fewer than its share stays."""
    own = lambda k: " ".join(["".join(chr(97 + int(c)) for c in str(k))] * 60)
    rows = [(k, ("everywhere\n" if k < 21 else "in a few\n" if k < 40 else "") + own(k), "en", "hot") for k in range(2100)]
    params = QualityParams(line_most=20)
    found = {r["row"]["doc_id"]: r["cut_lines"] for r in quality_rules(space, documents(rows), ["doc_id"], params).collect()}
    assert all(found[k] == [0] for k in range(21)) and not any(found[k] for k in range(21, 2100))
    usual = {r["row"]["doc_id"]: r["cut_lines"] for r in quality_rules(space, documents(rows), ["doc_id"]).collect()}
    assert not any(usual.values())  # 21 are 1 % of them, and fewer than 100


def test_every_language_brings_in_its_words(spark):
    """A language with few texts keeps its entries beside one with many."""
    docs = [(k, " ".join(f"{c}{k % 50}x" for c in "abcdefgh"), "big") for k in range(400)]
    docs += [(1000 + k, "qua quo qui", "small") for k in range(3)]
    docs = [(i, re.sub(r"\d+", lambda m: "z" * (int(m[0]) % 7 + 1) + "y" * (int(m[0]) // 7 + 1), t), lang) for i, t, lang in docs]
    model = fit_languages(spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING"), params=LanguageParams(words=40, grams=30))
    assert {"qua", "quo", "qui"} <= set(model.words) and 40 <= len(model.words) <= 80
    assert model.predict("qui quo")[0] == "small" and model.predict("azy")[0] == "big"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14))
def test_repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert repeat_words(words, 3) == len(covered)


def test_language(odd):
    model = fit_languages(odd)
    got = rows(predict_languages(odd, model, ["doc_id"]), "row.doc_id", "lang_pred", "score")
    assert len(got) == len(ROWS)
    assert all((i, "und", 0.0) in got for i in (1, 2, 3, 9))
    assert (5, "en") in {g[:2] for g in got}


def test_language_backs_off(documents):
    words = {"de": ["schiffe", "schrank", "tisch"], "es": ["perro", "gato", "queso"]}
    train = documents([(i, " ".join(w), lang, "a") for i, (lang, w) in enumerate(words.items())])
    model = fit_languages(train, params=LanguageParams(smoothing=0.1))
    assert model.predict("schranktisch")[0] == "de" and model.predict("quesogato")[0] == "es"
    assert fit_languages(train.limit(0)).predict("tisch") == ("und", 0.0)


def test_ngram_join(space, odd):
    got = rows(ngram_join(space, odd), "doc_id", "n_shingles", "component_id")
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 29_998, 4), (5, 58, 5), (5, 58, 5), (6, 58, 5), (7, 1, 7), (8, 1, 7), (9, 1, 9), (None, 58, None)],
        key=lambda r: (r[0] is None, r[0] or 0),
    )


def test_ngram_join_against_brute_force(space, documents):
    """Groups of near copies around the threshold, larger than ``few`` and than a block."""
    rng = np.random.default_rng(3)
    texts = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in rng.integers(0, 400, 120)]
        for _ in range((3, 8, 30, 45)[group]):
            own = list(base)
            for place in rng.integers(0, 120, rng.integers(0, 4)):
                own[place] = f"edit{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    found = ngram_join(space, docs, params=JoinParams(cells=1 << 12, few=6, block=16, strip=8))
    assert rows(found, "doc_id", "component_id") == list(enumerate(root))


def test_a_pair_is_open_in_one_block():
    """Blocks of all frequent n-grams open every linked pair once, or leave it to a rarer n-gram."""
    rng = np.random.default_rng(9)
    params = JoinParams(width=1, percent=80, block=8, strip=8)
    base = rng.choice(1 << 40, 30, replace=False)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:29], rng.integers(1 << 41, 1 << 50, 1)])).astype(np.uint64) for _ in range(24)]
    frequencies = np.ones(1 << 12, np.uint32)
    prefixes = [prefix_of(s, frequencies, params.percent).astype(np.int64).tolist() for s in sets]
    frequent = {g for g, n in Counter(g for p in prefixes for g in p).items() if n > 6}
    opened = Counter()
    for gram in frequent:
        members = [i for i, p in enumerate(prefixes) if gram in p]
        for first in range(2):
            for second in range(first, 2):
                rows = [i for i in members if i % 2 in (first, second)]
                lists = [([g for g in prefixes[i] if g not in frequent], [g for g in prefixes[i] if g in frequent]) for i in rows]
                table = pa.table({
                    "gram": [gram] * len(rows), "first": [first] * len(rows), "second": [second] * len(rows), "part": [i % 2 for i in rows],
                    "n": [len(sets[i]) for i in rows], "place": [prefixes[i].index(gram) for i in rows],
                    "rare": pa.array([r for r, _ in lists], pa.list_(pa.int64())), "often": pa.array([o for _, o in lists], pa.list_(pa.int64())),
                })
                opened.update((rows[a], rows[b]) for a, b in zip(*np.nonzero(open_pairs(table, params))) if a < b)
    linked = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            rarer = (set(prefixes[a]) & set(prefixes[b])) - frequent
            assert opened[a, b] <= 1
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                linked += 1
                assert bool(opened[a, b]) != bool(rarer)
    assert linked > 20


def test_ngram_join_of_ids_with_several_texts(space, documents):
    """Rows of one id are one node, however many texts it has; repeated rows change nothing."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    rows_ = []
    for i in range(40):
        own = list(base if i < 30 else other)
        own[int(rng.integers(0, 100))] = f"edit{i}"
        rows_.append((i, " ".join(own), "en", "a"))
    joined = [*rows_, (3, " ".join(other), "en", "a"), *[rows_[7]] * 20, (99, "something else", "en", "a")]
    small = JoinParams(width=5, percent=80, cells=1 << 12, few=6, block=16, strip=8)
    apart = ngram_join(space, documents([*rows_, *[rows_[7]] * 20]), params=small)
    assert set(rows(apart, "doc_id", "component_id")) == {(i, 0 if i < 30 else 30) for i in range(40)}
    found = rows(ngram_join(space, documents(joined), params=small), "doc_id", "component_id")
    assert set(found) == {(i, 0) for i in range(40)} | {(99, 99)} and len(found) == len(joined)


def test_components(spark, space):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(rows(components(space, spark.createDataFrame(chain, "a BIGINT, b BIGINT")), "id", "component"))
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_mix(space, odd, documents):
    found = mix(space, odd, ["doc_id"])
    assert found.count() == len(ROWS)
    got = rows(found, "row.doc_id", "size", "copies", "taken")
    assert all(t == s * c and 0 <= c <= 2 for _, s, c, t in got) and (1, 0, 0, 0) in got
    many = documents([(i, "w " * (i % 9 + 1), "en", ("a", "b", "c", None)[i % 4]) for i in range(400)])
    mixed = mix(space, many, ["doc_id", "source"]).cache()
    for r in mixed.groupBy("row.source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("s")).collect():
        assert abs(r["t"] - r["target"]) <= 9 and r["target"] <= 2 * r["s"]
    total = mixed.agg(F.sum("size")).first()[0]
    assert sum(r[0] for r in mixed.groupBy("row.source").agg(F.max("target").alias("t")).select("t").collect()) == pytest.approx(1.5 * total)
    again = mix(space, many.repartition(3), ["doc_id", "source"])
    assert rows(mixed, "row.doc_id", "taken") == rows(again, "row.doc_id", "taken")


def test_unequal_odds(spark, space):
    """Two sizes of a source are taken at the stated rates over many seeds; the largest get certain copies."""
    rows = [(k, "w " * (4 if k % 2 else 1), "en", "a") for k in range(60)] + [(100, "w " * 400, "en", "a")]
    docs = spark.createDataFrame([r[:2] + r[3:] for r in rows], "doc_id BIGINT, text STRING, source STRING").cache()
    sized = docs.select("source", word_count("text").alias("size"))
    targets = spark.createDataFrame([("a", 550, 875.0)], "source STRING, source_size BIGINT, target DOUBLE")
    params = MixParams(weights=(1,), share_percent=100)
    each = {r["size"]: r for r in expected_copies(sized, targets, params).collect()}
    assert each[400]["whole"] == 2 and each[400]["rest"] == 0
    factor = 75 / (30 * 1 * 1 + 30 * 4 * 2)
    assert each[1]["whole"] + each[1]["rest"] == pytest.approx(factor) and each[4]["whole"] + each[4]["rest"] == pytest.approx(2 * factor)
    assert each[1]["open"] == pytest.approx(75)
    taken, seeds = Counter(), 120
    many = docs.where("doc_id < 100").crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    # A source per seed: the ranks differ, the odds do not.
    many = many.select((F.col("doc_id") + 1000 * F.col("seed")).alias("doc_id"), "text", F.format_string("s%03d", "seed").alias("source"), (F.col("doc_id") % 2).alias("long"))
    found = mix(space, many, ["source", "long"], MixParams(weights=(1,), share_percent=40))
    for r in found.groupBy("row.source", "row.long").agg(F.sum("copies").alias("c"), F.sum("taken").alias("t"), F.max("target").alias("target")).collect():
        taken[r["long"]] += r["c"]
    factor = 0.4 * 150 / (30 + 30 * 4 * 2)
    assert taken[0] / (30 * seeds) == pytest.approx(factor, rel=0.1)
    assert taken[1] / (30 * seeds) == pytest.approx(2 * factor, rel=0.1)


def test_pack_cases(odd):
    found = pack(odd, word_tokenizer()).collect()
    assert sum(p["length"] for p in found if p["doc_id"] in (1, 2, 3)) == 3  # the end id alone
    assert sum(1 for p in found if p["doc_id"] == 5 and p["start"] == 0) == 2
    assert all(len(p["ids"]) == 4 * p["length"] for p in found)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9000))
def test_cuts(length):
    pieces = cuts(length, 2048, 1 / 32)
    assert sum(pieces) == length and all(2048 // (2048 // p) - p <= 2048 // (2048 // p) / 32 for p in pieces)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins(lengths):
    bins, placed = Bins(64, 5), []
    for k, n in enumerate(lengths):
        placed += bins.add((k, 0, n, b"", 0, n))
    closed = bins.close()
    sums: dict = {}
    for p in [*placed, *closed]:
        assert p[-1] == sums.get(p[-2], 0)
        sums[p[-2]] = sums.get(p[-2], 0) + p[2]
    assert sum(sums.values()) == sum(lengths) and max(sums.values(), default=0) <= 64
    assert all(sums[p[-2]].bit_count() == 1 for p in closed)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZ'é ß\n.,-<|>0Σİ²\u0301\x1c\t"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_equals_tokenizer(text):
    own = _ENCODER
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_scores(space, odd):
    got = rows(lm_scores(space, odd, F.lit(True), LmParams(bits=1 << 16, frequent=4)), "doc_id", "n_tokens", "n_known", "train_tokens")
    assert len(got) == len(ROWS) and (1, 1, 1, got[0][3]) in got and (4, 30_001, 30_001, got[0][3]) in got
    nothing = lm_scores(space, odd, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in nothing)


def test_scores_by_counts(space, documents):
    """More text than one range of the filter holds, read both ways: with so many hashes that no false
    entry occurs, the scores are those of the counts, down to words and pairs seen once."""
    texts = {k: [f"w{k}x{i}" for i in range(200)] + ["the", "end"] * (k % 7) + [f"c{k % 3}", "x"] for k in range(60)}
    table = documents([(k, " ".join(t), "en", "a") for k, t in texts.items()])
    params = LmParams(bits=1 << 12, hashes=24, frequent=4)
    wanted = exact_scores(texts, [k for k in texts if k % 5], params.prior)
    sent = {r["doc_id"]: r for r in lm_scores(space, table, F.expr("doc_id % 5 != 0"), params).collect()}
    joined = lm_scores(space, table, F.expr("doc_id % 5 != 0"), replace(params, broadcast_bytes=0)).collect()
    assert {k: r["score"] for k, r in sent.items()} == pytest.approx(wanted, rel=1e-9)
    assert {r["doc_id"]: r for r in joined} == sent


def test_both_ways_of_scores_on_odd_rows(space, odd):
    ways = [lm_scores(space, odd, F.col("doc_id") > 2, LmParams(bits=1 << 16, frequent=4, broadcast_bytes=b)) for b in (0, 1 << 26)]
    joined, sent = (sorted(map(str, w.collect())) for w in ways)
    assert joined == sent and len(sent) == len(ROWS)
    for most in (0, 1 << 26):
        assert lm_scores(space, odd.limit(0), F.lit(True), LmParams(broadcast_bytes=most)).count() == 0


def test_frequencies_take_a_byte(documents):
    """The table that goes by the driver has a byte for a cell, which rises with the frequency."""
    counts = np.concatenate([np.arange(1 << 12), [(1 << k) + d for k in range(13, 33) for d in (-1, 0, 1)]]).astype(np.uint64)
    grades = _grades(counts).astype(int)
    assert (np.diff(grades) >= 0).all() and (grades[:16] == np.arange(16)).all() and grades[-1] == 239
    docs = documents([(k, "a b c d" if k else "a b c", "en", "a") for k in range(40)])
    params = JoinParams(cells=1 << 12)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    table = _frequencies(_sets(texts, params), params.cells)
    assert table.nbytes == params.cells and sorted(table[table > 0]) == sorted(_grades(np.array([39, 40], np.uint64)))


def test_chunks_are_sent_once(documents, monkeypatch):
    """A chunk sends its n-grams once, in fewer bytes than the texts have; ranges count the training rows among
    them, without a filter sent beforehand."""
    import themeloom.llm.lm as lm

    monkeypatch.setattr(lm, "_CHUNK", 1 << 12)
    texts = [" ".join(f"word{(7 * k + i) % 97}" for i in range(200)) for k in range(20)]
    docs = documents([(k, t, "en", "a") for k, t in enumerate(texts)]).coalesce(1)
    numbered = docs.select("doc_id", F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 4 != 0).alias("train"), F.col("doc_id").alias("rid"))
    batches = docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        chunks = pack_chunks(numbered).localCheckpoint()
        assert chunks.count() > 1 and chunks.agg(F.sum(F.length("rows"))).first()[0] < sum(map(len, texts)) / 3
        answers = find_levels(chunks, 4, 24).collect()
    finally:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    entries = np.sum([r["entries"] for r in answers if r["entries"]], axis=0)
    total = np.sum([r["total"] for r in answers if r["total"]], axis=0)
    # 97 words and the end; 97 pairs in a row, and every first and last word with the end.
    train = [t.split() for k, t in enumerate(texts) if k % 4]
    pairs = {p for t in train for p in zip(["", *t], [*t, ""])}
    assert entries[:64].sum() == 98 and entries[64:].sum() == len(pairs)
    assert total[:64].sum() == total[64:].sum() == 15 * 201


def test_filter_levels():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**64, 20_000, np.uint64)
    counts = rng.integers(1, 200, 20_000)
    own = Filter(np.zeros(1 << 19, np.uint8), 4, 1)
    own.insert(names, levels(counts))
    found = own.level(names)
    assert (found >= levels(counts)).all() and (found == levels(counts)).mean() > 0.9
    assert (own.level(rng.integers(0, 2**64, 20_000, np.uint64)) > 0).mean() < 0.1
    # As many bits as the entries need: an absent entry is found with a chance of 2 ** -hashes.
    fitted = Filter.of(names, levels(counts), 8)
    assert (fitted.level(rng.integers(0, 2**64, 200_000, np.uint64)) > 0).mean() == pytest.approx(2**-8, rel=0.2)


def test_licenses(documents):
    texts = [
        None, "", "Some prose. All rights reserved.",
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software!",
        "Redistributions of source code must retain the above copyright notice; Redistributions in binary form must reproduce the above copyright notice, etc.\n"
        "Neither the name of X nor Y may be used to endorse or promote products.",
        "The software is provided as is, without any warranty.", "Your driving license is void.",
    ]
    found = scan_licenses(documents([(i, t, "en", "a") for i, t in enumerate(texts)]))
    got = [(r[0], list(r[1]), r[2], r[3]) for r in found.orderBy("doc_id").select("doc_id", "licenses", "unmatched", "verdict").collect()]
    assert got == [
        (0, [], "", "none"), (1, [], "", "none"), (2, ["All-Rights-Reserved"], "", "known"), (3, ["GPL-3.0", "CC-BY-NC"], "", "several"),
        (4, ["MIT"], "", "known"), (5, ["BSD-3-Clause"], "", "known"), (6, [], "NoWarranty", "partial"), (7, [], "", "none"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def branches(parsed):
    """A sentence for every way through a parsed pattern."""
    ways = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "SUBPATTERN":
            more = branches(value[-1])
        elif kind == "BRANCH":
            more = [w for part in value[1] for w in branches(part)]
        else:  # optional parts, and runs of any or of listed characters
            inside = value[2]
            more = ["x y"] if str(inside[0][0]) == "ANY" else ["4.0"] if str(inside[0][0]) == "IN" else ["", *branches(inside)]
        ways = [w + m for w in ways for m in more]
    return ways


def test_every_branch_of_licenses(documents):
    patterns = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
    said = sorted({w.strip() for _, p in SENTENCES for w in branches(re._parser.parse(p))})
    wanted = {w: next((name for name, p in patterns if p.fullmatch(w)), None) for w in said}
    texts = [f"Some prose. {w.replace(' ', '  ').capitalize()}." for w in said]
    found = scan_licenses(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {said[r["doc_id"]]: [*r["sentences"], None][0] for r in found} == wanted
    assert sum(w is not None for w in wanted.values()) > 500


def test_wrapped_licenses(documents):
    """Sentences over several lines, as in files, with comment marks and Windows line ends."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files, to deal\nin it."
    bsd = (
        "Redistributions of source code must retain\nthe above copyright notice.\nRedistributions in binary form must\nreproduce the above copyright notice.\n"
        "Neither the name of the owner nor its contributors\nmay be used to endorse or promote\nproducts."
    )
    gpl = "Some title\nThis program is licensed under the GNU General Public\nLicense, version 3\n\nMore"
    texts = [
        mit, bsd, gpl, mit.replace("\n", "\n * "), "# " + bsd.replace("\n", "\n# "), ";; " + gpl.replace("\n", "\r\n;; "),
        "Licensed under the MIT\n\nLicense", "All rights reserved\nLicensed under CC\nBY 4.0\nAll rights reserved", "Licensed under the MIT License and more",
        "This file is released under the GNU General Public License, version 2\nor any later version.", mit.replace("to deal\nin it.", "etc") + "\nAll rights reserved",
    ]
    found = scan_licenses(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [list(r["licenses"]) for r in found] == [
        ["MIT"], ["BSD-3-Clause"], ["GPL-3.0"], ["MIT"], ["BSD-3-Clause"], ["GPL-3.0"],
        [], ["CC-BY", "All-Rights-Reserved"], [], ["GPL-2.0-or-later"], ["MIT", "All-Rights-Reserved"],
    ]
    assert list(found[7]["sentences"]) == ["AllRights", "CCBY", "AllRights"]


NOTICES = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as
    published by the Free Software Foundation, either version 3 of the
    License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
    License, v. 2.0. If a copy of the MPL was not distributed with this
    file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
    purpose with or without fee is hereby granted, provided that the above
    copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT": "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-SA": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}
TAGS = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0+": "GPL-2.0-or-later", "LGPL-2.1-or-later": "LGPL-2.1-or-later",
    "AGPL-3.0-only": "AGPL-3.0", "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "CC-BY-SA-4.0": "CC-BY-SA", "ISC": "ISC", "Unlicense": "Unlicense",
}


def test_standard_notices(documents):
    """The notices that the licences themselves give, plain and as comments, and tags in files."""
    said = [(name, t) for name, text in NOTICES.items() for t in (text, "# " + text.replace("\n", "\n# "))]
    said += [(name, f"{a}SPDX-License-Identifier: {tag}{b}\ncode(here);") for tag, name in TAGS.items() for a, b in (("// ", ""), ("/* ", " */"))]
    found = scan_licenses(documents([(i, t, "en", "a") for i, (_, t) in enumerate(said)])).collect()
    assert {r["doc_id"]: list(r["licenses"]) for r in found} == {i: [name] for i, (name, _) in enumerate(said)}


def test_empty_tables_and_stages(spark, documents, odd):
    """Every stage of the pipeline, on no rows and on odd ones."""
    for name, stage in STAGES:
        assert stage(spark, documents([]), "").count() == 0, name
        assert stage(spark, odd, "").count() >= 1, name
