"""Pages, vectors and conversations: odd cases and brute force."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from themeloom.llm.chat import ChatParams, Codec, escape, format_turns, read_back, unescape
from themeloom.llm.near_vectors import VectorParams, bucket_keys, near_vectors
from themeloom.llm.url_rules import UrlParams, filter_urls, mine_rules


def test_urls(spark, space):
    urls = [
        None, "", "no scheme/net/", "http://A.Net/x", "http://net", "http://net/", "https://b.example.net/en/1?q=://y", "http://xexample.net/en/",
        "ftp://example.com/de/2#a", "http://example.com?/de/", "http://w.org/fr/", "x://y://z.net/",
    ]
    pages = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(urls)], "page_id INT, url STRING, tokens STRING, rid INT")
    labels = spark.createDataFrame([], "page_id BIGINT, blocked BOOLEAN")
    got = {r["page_id"]: tuple(r)[1:5] for r in filter_urls(space, pages, labels).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "/x", "net/", "block"),
        4: ("net", "", None, "allow"), 5: ("net", "/", "net/", "block"), 6: ("b.example.net", "/en/1", "example.net/en/", "allow"),
        7: ("xexample.net", "/en/", "net/", "block"), 8: ("example.com", "/de/2", "example.com/de/", "block"),
        9: ("example.com", "", None, "allow"), 10: ("w.org", "/fr/", "org/fr/", "allow"), 11: ("y:", "//z.net/", None, "allow"),
    }


def test_rules_are_mined(spark, space):
    """Two tokens together mark blocked pages; either alone does not."""
    rows = [(i, f"http://{a}.{b}.info/{i}", a == "spam" and b == "farm") for i, (a, b) in enumerate([("spam", "farm"), ("spam", "good"), ("fine", "farm"), ("fine", "good")] * 10)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id BIGINT, url STRING")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 36], "page_id BIGINT, blocked BOOLEAN")
    found = filter_urls(space, pages, labels, UrlParams(confidence=0.9, given=())).collect()
    assert {r["page_id"]: r["verdict"] == "block" for r in found} == {r[0]: r[2] for r in rows}
    assert filter_urls(space, pages.limit(0), labels).count() == 0


def test_rules_on_few_pages_are_noise(spark, space):
    """Five of eight pages of a host are blocked, as a quarter of all are: no rule. All of nine are one."""
    hosts = [("odd", 8, 5), ("farm", 9, 9), ("fine", 83, 11)]
    rows = [(f"http://{h}.info/", k < blocked) for h, pages, blocked in hosts for k in range(pages)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id BIGINT, url STRING")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id BIGINT, blocked BOOLEAN")
    found = filter_urls(space, pages, labels, UrlParams(given=())).collect()
    assert {r["host"] for r in found if r["verdict"] == "block"} == {"farm.info"}


def brute(vectors, labels, cosine=0.93):
    links = [set() for _ in vectors]
    for a in range(len(vectors)):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is None or y is None or len(x) != len(y) or labels[a] is None or labels[a] != labels[b]:
                continue
            x, y = np.array(x, float), np.array(y, float)
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y >= cosine * np.linalg.norm(x) * np.linalg.norm(y):
                links[a].add(b)
                links[b].add(a)
    root = list(range(len(vectors)))
    for _ in vectors:
        for a, near in enumerate(links):
            root[a] = min([root[a], *(root[b] for b in near)])
    return [(i, len(links[i]), root[i], root[i] == i) for i in range(len(vectors))]


def test_vectors(spark, space):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 20))
    vectors = [list(base[i % 4] + rng.normal(size=20) * (0.15 if i % 3 else 0.3)) for i in range(80)] + [list(base[0])] * 6
    labels = [i % 8 // 4 for i in range(len(vectors))]
    vectors += [None, [], [0.0] * 20, [None] + [1.0] * 19, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19, [1.0] * 5, [2.0] * 5, list(base[0])]
    labels += [0] * 8 + [None]
    rows = [(i, [None if x is None else float(x) for x in v] if v is not None else None, k, "own") for i, (v, k) in enumerate(zip(vectors, labels))]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, id STRING")
    clean = [None if v is not None and any(x is None for x in v) else v for v in vectors]
    found = sorted(tuple(r) for r in near_vectors(space, df, VectorParams(block=8, width=1, probes=2)).collect())
    assert found == brute(clean, labels)
    assert near_vectors(space, df.limit(0)).count() == 0


def test_bucket_recall():
    """Pairs just above the threshold meet in a bucket with the usual parameters."""
    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * noise
    keys = [bucket_keys(v, np.zeros(len(v), int), VectorParams()) for v in (x, y)]
    met = [np.isin(a, b).any() for a, b in zip(*keys)]
    assert np.mean(met) > 0.98


@pytest.fixture(scope="module")
def params():
    import public_tokenizers

    return ChatParams(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, part=50)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from(["a", "B ", "  ", "\n", " \n ", "1", "23", "'s", "'", "é", "日本", "😀", "\t", " word", "don't", "...", "</turn>", "\\"]), max_size=100),
    st.integers(1, 60),
)
def test_texts_in_parts_have_the_ids_of_the_whole(params, pieces, part):
    text = "".join(pieces)
    whole, cut = Codec(replace(params, part=1 << 40)), Codec(replace(params, part=part))
    assert cut.encode(text) == whole.encode(text)


def test_very_long_texts_have_the_ids_of_the_whole(params):
    whole, usual = Codec(replace(params, part=1 << 40)), Codec(replace(params, part=1 << 16))
    for text in ("a" * 150_000, " " * 150_000, "word \n\n 12's " * 20_000):
        assert usual.encode(text) == whole.encode(text)


def brute_rules(pages, support, least, confidence, most):
    """Rules by counting every combination of tokens."""
    together, blocked = Counter(), Counter()
    for tokens, bad in pages:
        for size in range(1, most + 1):
            for some in combinations(sorted(tokens), size):
                together[some] += 1
                blocked[some] += bad
    fewest = max(support * len(pages), least)
    share = sum(bad for _, bad in pages) / len(pages)
    rules = {s: blocked[s] / n for s, n in together.items() if blocked[s] >= fewest and blocked[s] / n >= confidence and blocked[s] / n > share}
    return {s: c for s, c in rules.items() if not any(rules.get(p, -1) >= c for k in range(1, len(s)) for p in combinations(s, k))}


def test_mined_rules_against_counts(spark, space):
    rng = np.random.default_rng(5)
    pages = []
    for _ in range(300):
        tokens = [t for t in "abcdefg" if rng.random() < 0.45]
        odds = 0.15 + 0.6 * ("a" in tokens and "b" in tokens) + 0.3 * ("g" in tokens)
        pages.append((tokens, bool(rng.random() < odds)))
    labelled = spark.createDataFrame(pages, "tokens ARRAY<STRING>, blocked BOOLEAN")
    params = UrlParams(support=0.05, confidence=0.6, certainty=0.0)
    found = {tuple(r["tokens"]): (r["confidence"], r["index"]) for r in mine_rules(space, labelled, params).collect()}
    wanted = brute_rules(pages, 0.05, 5, 0.6, 3)
    assert found.keys() == wanted.keys() and len(wanted) > 5
    often = Counter(t for tokens, _ in pages for t in tokens)
    for tokens, (confidence, index) in found.items():
        assert confidence == pytest.approx(wanted[tokens])
        assert index == min(tokens, key=lambda t: (often[t], t))


def test_chat(spark, params):
    odd = "\\### Assistant: </turn> <turn></role> \\< </tu<turn>rn> \\\\ <|endoftext|>\n 日本 😀"
    rows = [
        (1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (2, None, None, "x"), (2, 5, "assistant", ""),
        (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "n"), (4, 0, "</turn>", "long " * 300),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, ids STRING")
    got = {r["conv_id"]: r for r in read_back(format_turns(df, params), params).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest(f"user\n{odd}\nassistant\n{odd}\nassistant\n\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(odd), digest(odd))
    assert got[2]["turns_sha256"] == digest("\nx\nassistant\n\n") and got[2]["loss_sha256"] == digest("")
    assert got[3]["n_turns"] == 3 and got[3]["loss_chars"] == 3
    assert got[4]["turns_sha256"] == digest("</turn>\n" + "long " * 300 + "\n")
    placed = format_turns(df.where("conv_id = 1"), params).orderBy("place").collect()
    assert [p["start"] for p in placed] == [0, *np.cumsum([len(p["ids"]) // 4 for p in placed])[:-1]]
    assert read_back(format_turns(df.limit(0), params), params).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "<turn>", "</turn>", "</role>", "turn>", "a", "\n"]), max_size=12))
def test_escapes(parts):
    text = "".join(parts)
    hidden = escape(text)
    assert unescape(hidden) == text
    assert not any(c in hidden for c in ("<turn>", "</turn>", "</role>"))
