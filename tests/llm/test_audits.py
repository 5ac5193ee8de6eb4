"""Repeated passages, source divergence and filter audit: odd cases and brute force."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from themeloom.llm.divergence import DivergenceParams, audit_divergence, joint_tables, kept_terms, term_counts, terms_of
from themeloom.llm.filter_audit import audit_filters, text_failures
from themeloom.llm.repeats import RepeatParams, remove_repeats

# --- repeated passages ---------------------------------------------------------------

SMALL = RepeatParams(window=4, block_bytes=300, bucket_bytes=700, phrase=3, automaton_words=20, piece_bytes=16)


def without_repeats(rows, window):
    """(n_words, kept) of each row by definition."""
    split = [(i if i is not None else np.inf, (t or "").encode().split()) for i, t in rows]
    first = {}
    for order, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, np.inf), order)
    found = []
    for order, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < order:
                gone.update(range(at, at + window))
        found.append((len(words), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return found


def repeat_rows():
    rng = np.random.default_rng(2)
    words = ["a", "b", "A", "ß", "x y", "d,", "日本"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(60)]
    passage = " ".join(rng.choice(words, 25))
    texts += [f"{a}\n{passage}\t {b}" for a, b in zip(texts[:20], texts[20:40])]  # a passage in many
    texts += [texts[3]] * 5 + ["", None, "   \n", "a " * 400, "a " * 401, "a b c"]
    ids = list(rng.permutation(len(texts)).astype(int))
    ids[-1] = ids[-7] = None
    ids[7] = ids[8]  # repeated ids
    return [(None if i is None else int(i), t, "en", "s") for i, t in zip(ids, texts)]


@pytest.mark.parametrize("params", [SMALL, RepeatParams(window=4)])
def test_repeats_against_brute_force(documents, params):
    rows = repeat_rows()
    rows += rows[:2]  # repeated rows
    found = remove_repeats(documents(rows), ["doc_id", "text", "row", "tokens"], params).collect()
    wanted = without_repeats([r[:2] for r in rows], 4)
    got = sorted((repr(f["row"]["doc_id"]), repr(f["row"]["text"]), f["n_words"], f["kept_text"]) for f in found)
    assert got == sorted((repr(r[0]), repr(r[1]), n, kept) for r, (n, kept) in zip(rows, wanted))
    for f in found:
        words = (f["row"]["text"] or "").encode().split()
        gone = [k for s in f["spans"] for k in range(s["start"], s["end"])]
        assert len(gone) == f["n_removed"] and f["row"]["row"] == "own row"
        assert b" ".join(w for k, w in enumerate(words) if k not in set(gone)).decode() == f["kept_text"]


def test_repeats_in_a_very_long_text_and_an_empty_table(documents):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (3, "w4998 w4999 w0 w1 own", "en", "s")]
    found = {f["row"]["doc_id"]: f for f in remove_repeats(documents(rows), ["doc_id"], RepeatParams(window=4)).collect()}
    assert [found[i]["n_removed"] for i in (1, 2, 3)] == [0, 200_000, 4]
    assert found[3]["kept_text"] == "own"
    assert remove_repeats(documents([]), ["doc_id"]).count() == 0


# --- source divergence ---------------------------------------------------------------


def divergences(rows, top=200):
    """Every row of the audit by definition."""
    rows = [((l or ""), (s or ""), terms_of(t or "")) for _, t, l, s in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    found = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        groups = {s: c for (l, s), c in counts.items() if l == lang}
        shares = {}
        for name, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            shares[name] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        def price(p, q):
            return (p - q) ** 2 // q

        for a in groups:
            pairs = [(b, sum(price(shares[a][t], shares[b][t]) for t in kept)) for b in groups if b != a]
            terms = [(t.decode(), price(p, shares[None][t])) for t, p in shares[a].items() if groups[a][t] and p > shares[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, a, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(found)


def divergence_rows():
    rng = np.random.default_rng(3)
    words = np.array("the of É日本 ß x1y Don't A a z-z co_op über".split())
    rows = []
    for k in range(120):
        source = ["hot", "hot", "b", None, "", "日", "z"][k % 7]
        rows.append((k, " ".join(rng.choice(words, rng.integers(0, 30), p=rng.dirichlet(np.ones(len(words)) / 3))), ["en", "fr", None][k % 3], source))
    rows += [(200, None, "xx", "only"), (201, "", "yy", "p"), (202, "rare", "yy", "q"), (203, "the " * 5000, "en", "b"), (203, "the " * 5000, "en", "b")]
    return rows


@pytest.mark.parametrize("params", [DivergenceParams(), DivergenceParams(held=4, block=3, columns=2, cells=8, top=3)])
def test_divergence_against_brute_force(documents, space, params):
    rows = divergence_rows()
    found = sorted(tuple(r) for r in audit_divergence(space, documents(rows), params).collect())
    assert found == divergences(rows, params.top)
    assert audit_divergence(space, documents([]), params).count() == 0


def test_joint_tables_count_terms(documents):
    rows = divergence_rows()
    params = DivergenceParams(block=3, columns=2, cells=8)
    terms = kept_terms(term_counts(documents(rows), params, "text", "lang", "source"), params)
    wanted = Counter()
    for r in terms.collect():
        held = [(g["source"], g["cnt"]) for g in r["groups"]]
        for i, a in enumerate(held):
            for b in held[i:]:
                first, second = sorted((a, b), key=lambda g: g[0].encode())
                wanted[r["lang"], *first, *second] += 1
    found = {tuple(r)[:5]: r["n"] for r in joint_tables(terms, params).collect()}
    assert found == wanted


# --- filter audit --------------------------------------------------------------------


def audits(rows, labels):
    """The audit by applying the filters in every order."""
    parts, marks = defaultdict(list), {}
    for i, quality, toxic in labels:
        if i is None:
            continue
        good, bad = marks.get(i, (False, False))
        marks[i] = good or quality == 1, bad or toxic == 1
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _, s in rows:
        fails = {f for k, f in enumerate("ABCD") if text_failures(t or "") >> k & 1}
        if i is not None and first[t or ""] < i:
            fails.add("E")
        parts[s or ""].append((fails, *marks.get(i, (False, False))))
    found, shapley = [], Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                found.append(
                    [part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs),
                     sum(d[1] for d in gone), sum(d[2] for d in gone), f]
                )
    return sorted((*row[:9], shapley[row[0], row[9]]) for row in found)


def test_failures_of_a_text():
    words = [f"w{k}" for k in range(60)]
    assert text_failures(" ".join(words)) == 0
    assert text_failures("") == 1 and text_failures("one") == 1
    assert text_failures(" ".join(words[:39] + ["w0"] * 21)) == 0  # 39 of 60: 65 %
    assert text_failures(" ".join(words[:38] + ["w0"] * 22)) == 2
    assert text_failures(" ".join(words).upper()) & 4
    assert text_failures(" ".join(words) + "|") == 8
    assert text_failures("É" * 19 + "A") == 1 and text_failures("É" * 18 + "A") == 5


def test_audit_against_brute_force(spark, documents):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(150):
        size = int(rng.integers(30, 90))
        words = [f"w{v}" for v in rng.integers(0, rng.choice([30, 400]), size)]
        text = " ".join(w.upper() if rng.random() < 0.06 else w for w in words) + rng.choice(["", " #", " $ |"])
        rows.append((k, text, "en", ["hot", "hot", None, "", "z"][k % 5]))
        labels.append((k, int(rng.integers(0, 2)), int(rng.random() < 0.2)))
    rows += [(200 + k, rows[k % 9][1], "en", ["hot", "z"][k % 2]) for k in range(40)]  # copies in other parts
    rows += [(300, None, None, None), (301, "", "en", "hot"), (None, rows[3][1], "en", "hot"), (None, None, "en", "hot")]
    rows += [rows[0], rows[0], rows[-1]]  # repeated rows
    labels += [(0, 1, 0), (0, 0, 1), (None, 1, 1), (999, 1, 1), (200, None, None)]
    given = spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    found = audit_filters(documents(rows), given)
    assert sorted(tuple(r) for r in found.collect()) == audits(rows, labels)
    assert audit_filters(documents([]), given).count() == 0
