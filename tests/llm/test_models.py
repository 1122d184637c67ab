"""Classifiers by held-out accuracy, personal data, and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from wattloom.llm import langid, pii, quality, queries, toxicity
from wattloom.llm.textblocks import Places, blocks, tokenize

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    queries.ship(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_toxicity_held_out(small):
    docs, labels = small
    rows = [r for r in toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect() if r.held_out and r.toxic is not None]
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    # some thirty toxic documents to learn from, several of them without a toxic word
    assert auc > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("discounts", [None, [(0.75,) * 3] * 2, [(0.5, 1.2, 1.7), (0.9, 1.1, 2.0)]])
def test_kneser_ney_ratios_are_those_of_the_formula(spark, discounts):
    """None: the discounts that the query runs with, each class's from its own counts of counts."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    sample = [(" ".join(rng.choices(words[: 9 + 3 * y], k=rng.randint(0, 20))), y) for y in (0, 1) for _ in range(24)]
    model = toxicity.compare(toxicity.count_pairs(spark.createDataFrame(sample, "text string, y int").repartition(3)), discounts)
    n = [collections.Counter() for _ in (0, 1)]
    for text, y in sample:
        t = text.split()
        n[y].update(zip(["<s>", *t], t))
    k = [collections.Counter(w for _, w in n[y]) for y in (0, 1)]
    types = len(k[0]) + len(k[1]) + 1
    used = discounts
    if discounts is None:
        times = [collections.Counter(n[y].values()) for y in (0, 1)]
        assert all(c[j] for c in times for j in (1, 2, 3, 4))
        used = []
        for c in times:
            share = c[1] / (c[1] + 2 * c[2])
            used.append([j - (j + 1) * share * c[j + 1] / c[j] for j in (1, 2, 3)])
            used[-1] = [min(max(d, 0.1), j - 0.05) for j, d in enumerate(used[-1], 1)]

    def word_p(w, y):
        shared = max((w in k[0]) + (w in k[1]), 1) / types
        return max(k[y][w] - 0.75, 0) / sum(k[y].values()) + 0.75 * len(k[y]) / sum(k[y].values()) * shared

    def pair_p(h, w, y):
        of = {p: c for p, c in n[y].items() if p[0] == h}
        if not of:
            return word_p(w, y)
        taken = lambda c: used[y][min(c, 3) - 1] if c else 0.0
        return (n[y][h, w] - taken(n[y][h, w]) + sum(map(taken, of.values())) * word_p(w, y)) / sum(of.values())

    for text in ["w0 w1 w2 w11 w10 w3", "w5 nowhere w5", "w0 w0 w0 w9", ""]:
        t = text.split()
        want = [math.log(pair_p(h, w, 1) / pair_p(h, w, 0)) for h, w in zip(["<s>", *t], t)]
        (block,) = blocks(pa.array([text]))
        got, lower, level, known = model.ratios(tokenize(block))
        np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)
        np.testing.assert_allclose(lower, [math.log(word_p(w, 1) / word_p(w, 0)) for w in t], rtol=1e-5, atol=1e-6)
        said = [n[0][p] + n[1][p] for p in zip(["<s>", *t], t)]  # every pair counts, however rare
        assert level.tolist() == [sum(c >= e for e in toxicity.LIMITS) for c in said]
        assert known.tolist() == [w in k[0] or w in k[1] for w in t]
    for y in (0, 1):  # and they are probabilities: over all words, with the place of the unseen ones
        total = sum(pair_p("w0", w, y) for w in {*k[0], *k[1]})
        unseen = (1 - total) / (1 / types * 0.75 * len(k[y]) / sum(k[y].values()))
        assert 0 < total < 1 and 0 < unseen <= 1


def test_own_discounts_stay_below_the_counts():
    assert toxicity.own_discounts(0, 0, 0, 0) == (0.75,) * 3
    for seen in [(1, 0, 0, 0), (10, 1, 9, 0), (5, 40, 1, 90), (1000, 300, 150, 90)]:
        assert all(0.1 <= d < j for j, d in enumerate(toxicity.own_discounts(*seen), 1))
    assert toxicity.own_discounts(1000, 300, 150, 90)[0] == pytest.approx(1 - 2 * 0.625 * 0.3)


def test_labels_of_one_class_give_their_share(spark):
    docs = spark.createDataFrame([(i, f"word{i} here") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len({r.score for r in rows}) == 1 and rows[0].score > 0.9 and all(r.predicted == 1 for r in rows)


def test_quality_held_out(small):
    docs, labels = small
    rows = [r for r in quality.score_quality(docs, labels).join(labels, "doc_id").collect() if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("labelled", [1, 2, 40])
def test_few_quality_labels(spark, labelled):
    docs = spark.createDataFrame([(i, f"word{i % 2} here {'!' * (i % 3)}" if i % 7 else None) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(labelled)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 60 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_context_vectors_are_sums_of_index_vectors(spark):
    texts = ["a b c a", "b c", "", "c c c"]
    lexicon = quality.common_words(spark.createDataFrame([(t,) for t in texts], "text string"), 2)
    (block,) = blocks(pa.array(texts))
    t, word, _ = quality.units(block, Places(lexicon))
    assert sorted(set(word[word < quality.LEXICON].tolist())) == [0, 1] and (word >= quality.LEXICON).any()  # c, and a or b, have units
    total = np.zeros((quality.UNITS, quality.DIM))
    _, word, shape = quality.units(block, Places(lexicon))
    for d in range(len(texts)):
        of = np.flatnonzero(t.doc == d)
        for i, j in zip(of, of[1:]):
            for left, right in ((word, word), (word, shape), (shape, shape)):
                for a, b in ((left[i], right[j]), (left[j], right[i])):
                    for k in (0, 1):
                        total[a, quality.INDEX[k][b]] += quality.SIGN[k][b]
    got = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), lexicon)
    used = np.flatnonzero(np.linalg.norm(got, axis=1) > 0)
    assert set(used) == set(word) | set(shape)
    np.testing.assert_allclose(np.linalg.norm(got[used], axis=1), 1)
    for k in (0, 1):  # each unit's own index vector comes on top, then the length is made 1
        np.add.at(total, (np.arange(quality.UNITS), quality.INDEX[k]), quality.SIGN[k] * np.linalg.norm(total, axis=1) * 0.5)
    np.testing.assert_allclose(got[used], total[used] / np.linalg.norm(total[used], axis=1, keepdims=True), atol=1e-9)


def test_language_held_out(small):
    docs, _ = small
    rows = [r for r in langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


@pytest.fixture(scope="module")
def chain():
    return pii.train_chain(pii.labelled_table())


@pytest.mark.parametrize(
    ("text", "base", "added"),
    [
        ("a.b@c.de then 10.0.0.1 or +41 (79) 123-4567.", ["email", "ip", "phone"], []),
        ("pay 4111 1111 1111 1111 now", ["card"], []),
        ("pay 4111 1111 1111 1112 at 300.1.1.1 for @home", [], []),
        ("please mail bob.jones [at] acme [dot] com, thanks", [], ["email"]),
        ("call (415) 555-2671 now", [], ["phone"]),
        ("card 4111/1111/1111/1111 ok", [], ["card"]),
        ("seen 10[.]1[.]22[.]13 tonight", [], ["ip"]),
        ('Version 2.0. token = "0641917ea4e9" on 2024-01-15 10:30 at the dot', [], []),
        ("", [], []),
    ],
)
def test_spans(chain, text, base, added):
    ((found, spans),) = pii.find_spans([text], chain)
    assert [k for _, _, k in found] == base
    assert [s[2] for s in spans if s not in found] == added
    assert not any(k in pii.redacted(text, spans) for k in ("@c.de", "[at]", "2671"))


def plain_spans(text):
    """The base contract as it is written: the patterns with re, failing matches dropped."""
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"),
                "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_of_all_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        want = plain_spans(texts[r.doc_id])
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert r.base_sha256 == digest and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in want) for kind in pii.KINDS]
        assert set(",".join(f"{k}:{a}:{b}" for a, b, k in want).split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_of_odd_texts():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choices("a1.@-+ 2(0é", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "1." * 400_000, "a@" * 400_000, "+1 " * 300_000, "9" * 5_000 + ".1.1.1"])
def test_long_runs_take_linear_time(text):
    began = time.time()
    assert pii.base_spans(text) == [] or text.startswith("1.")
    assert time.time() - began < 10


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    words = ["10", "call", "[at]", "x.y"]
    names = sorted({n for f in pii.features(words) for n in f} | {n for f in pii.features(words[1:]) for n in f})
    k = len(pii.TAGS)
    chain = pii.Chain({n: i for i, n in enumerate(names)}, rng.normal(0, 1, (len(names), k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k))
    sequences = [words, words[1:], words[:1]]
    for tokens, got in zip(sequences, chain.decode(sequences)):
        emit = [chain.emit[[chain.index[n] for n in f if n in chain.index]].sum(axis=0) for f in pii.features(tokens)]
        score = lambda path: chain.first[path[0]] + sum(e[t] for e, t in zip(emit, path)) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))
        assert tuple(got) == max(itertools.product(range(k), repeat=len(tokens)), key=score)


def test_addresses_within_long_digit_runs(chain):
    for before in range(80, 110):
        text = "7 " * before + "bob [at] acme [dot] com " + "8 " * 40
        assert [k for _, _, k in pii.find_spans([text], chain)[0][1]] == ["email"], before


def test_overlapping_spans_are_replaced_once():
    assert pii.redacted("ab cd ef", [(0, 5, "card"), (3, 8, "phone")]) == "[CARD]"


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, tiny), name)
        rows = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in rows} <= ids
        ids = {r.doc_id for r in rows}
        left.append(len(rows))
    assert left[1] < left[0] and left[2] < left[1] and left[3] == left[2]
    assert not any("@mail" in r.text and ".example.com" in r.text for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert {r.doc_id for r in last.collect()} == ids
