"""The filter audit, the licence scan and the whitening against brute force, and on odd inputs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wattloom.llm import audit, licences, whitening

# ---- licence scan -------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def at(text, start, sequence):
    return [0 <= start + j < len(text) and text[start + j] == w for j, w in enumerate(sequence)]


def by_brute_force(text, templates):
    """(start, template) of every place at which enough words agree and the key phrases stand."""
    out, text = [], words(text)
    for k, t in enumerate(templates):
        notice = t.notice.split()
        need = int(np.ceil(t.share * len(notice) - 1e-9))
        for start in range(-len(notice), len(text)):
            around = [text[i] if 0 <= i < len(text) else None for i in range(start - licences.SLACK, start + len(notice) + licences.SLACK)]
            if sum(at(text, start, notice)) >= need and all(any(around[i : i + len(p)] == p for i in range(len(around))) for p in (key.split() for key in t.keys)):
                out.append((start, k))
    return sorted(out)


def scraps(seed):
    """Texts of notices, whole, cut, changed and mixed up, among common words."""
    rnd, vocabulary = random.Random(seed), sorted({w for t in licences.TEMPLATES for w in t.notice.split()})
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            notice = rnd.choice(licences.TEMPLATES).notice.split()
            if rnd.random() < 0.5:
                for _ in range(rnd.randint(0, 1 + len(notice) // 5)):
                    notice[rnd.randrange(len(notice))] = rnd.choice(vocabulary)
            if rnd.random() < 0.4:
                cut = rnd.randint(0, max(1, len(notice) // 5))
                notice = notice[cut:] if rnd.random() < 0.5 else notice[: len(notice) - cut]
            parts += [rnd.choice(["The", "x;y", "software", "été", "THE"]) for _ in range(rnd.choice([0, 0, 1, 5]))] + notice
        yield i, rnd.choice([" ", "\n", "-", ". "]).join(parts).title()


@pytest.mark.parametrize("seed", [1, 2])
def test_every_place_of_every_notice(spark, seed):
    texts = dict(scraps(seed))
    got = licences.find_licences(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    number = {(t.label, len(t.notice.split())): k for k, t in enumerate(licences.TEMPLATES)}
    assert len(number) == len(licences.TEMPLATES)  # label and length tell the templates apart
    assert {r.doc_id for r in got} == set(texts) and sum(len(r.matches) for r in got) > 50
    for r in got:
        assert [(m.start, number[m.label, m.words]) for m in r.matches] == by_brute_force(texts[r.doc_id], licences.TEMPLATES)
        assert r.n_words == len(words(texts[r.doc_id])) and all(0 < m.share <= 1 for m in r.matches)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base_of(text):
    text = words(text)
    return sorted((i, label) for p, label in PHRASES.items() for i in range(len(text)) if text[i : i + len(p.split())] == p.split())


def test_base_phrases_of_whole_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licences.scan(docs).collect():
        found = base_of(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licence_scan_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "-- \n"), (4, "Under the MIT-license"), (4, "Under the MIT-license"), (None, "cc by cc by nc nc cc BY.NC"), (5, "word " * 100_000 + "apache license version 2"), (6, "under the mit lïcense"), (7, "GNU Affero General Public License, version 3: licensed under")]
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "doc_id long, text string, label string, share double, start int")
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licences.scan(docs).collect())
    assert got == sorted([
        ("1", 0, 0, None, None, "", "", 0.0), ("2", 0, 0, None, None, "", "", 0.0), ("3", 0, 0, None, None, "", "", 0.0), ("4", 4, 1, 0, 0, "mit", "mit", 1.0), ("4", 4, 1, 0, 0, "mit", "mit", 1.0),
        ("None", 9, 2, 2, 6, "cc-by-nc", "cc-by-nc", 1.0), ("5", 100_004, 1, 100_000, 100_000, "apache-2", "apache-2", 1.0), ("6", 4, 0, None, None, "", "", 0.0), ("7", 9, 0, None, None, "", "", 0.0),
    ])
    assert licences.scan(docs.limit(0)).collect() == []


# ---- whitening ----------------------------------------------------------------------------------


def vectors(spark, arrays, ids=None):
    rows = [(i, None if a is None else [None if x is None else float(x) for x in a], 3, 1.0) for i, a in zip(ids or range(len(arrays)), arrays)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened double")


def check_whitening(got, arrays, components):
    x = np.array([[int(np.floor(64 * float(v))) + 1_000_000 for v in a] for a in arrays], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array(x * n - sums, dtype=float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    want = centred @ u / np.sqrt(e)
    table = defaultdict(dict)
    for r in got:
        table[r.vec_id][r.component] = r
    assert all(sorted(row) == list(range(1, components + 1)) for row in table.values()) and len(table) == n
    mine = np.array([[table[i][c].whitened for c in range(1, components + 1)] for i in range(n)])
    signs = np.sign((mine * want).sum(axis=0))
    np.testing.assert_allclose(mine * signs, want, atol=1e-7)
    one = next(iter(table.values()))
    np.testing.assert_allclose([one[c].explained for c in range(1, components + 1)], e / np.trace(v), rtol=1e-9)
    np.testing.assert_allclose(mine.T @ mine / n, np.eye(components), atol=1e-8)
    for i in range(n):
        assert {r.deviation for r in table[i].values()} == {sum(int(y) ** 2 for y in x[i] * n - sums)}
        assert {(r.n, r.identity_error < 1e-8) for r in table[i].values()} == {(n, True)}


@pytest.mark.parametrize("shape, falling", [((300, 64), 0.0), ((200, 80), 0.5), ((50, 5), 0.1), ((40, 33), 0.0)])
def test_whitening_against_a_dense_solver(spark, shape, falling):
    random = np.random.default_rng(3)
    arrays = random.standard_normal(shape) * 8 * np.exp(-falling * np.arange(shape[1]) / 8) + 5
    got = whitening.whiten(vectors(spark, arrays.tolist()).repartition(3)).collect()
    check_whitening(got, arrays, min(32, shape[1]))


def test_range_finder_stays_small_where_it_can_and_expands_where_it_must():
    random = np.random.default_rng(5)
    basis = np.linalg.qr(random.standard_normal((96, 96)))[0]
    for values, size in ((np.r_[10.0 * 0.8 ** np.arange(8), np.full(88, 1e-9)], 18), (np.linspace(2, 1, 96), 96)):
        v = (basis * values) @ basis.T
        e, u, used = whitening.range_finder(lambda q: v @ q, 96, 8)
        assert used == size
        np.testing.assert_allclose(e, values[:8], rtol=1e-10)
        np.testing.assert_allclose(np.abs(np.sum(u * basis[:, :8], axis=0)), 1.0, atol=1e-10)


def test_whitening_of_odd_vectors(spark):
    sound = [[1.0, 2.0], [2.0, 1.0], [5.0, 5.5], [5.0, 5.5]]
    odd = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0], [], [1.0, 2.0, 3.0]]
    got = whitening.whiten(vectors(spark, sound + odd)).collect()
    check_whitening(got, np.array(sound), 2)
    for rows in ([], odd[:4], [[1.0, 2.0]], [[3.0, 3.0]] * 4, [[]] * 3):
        assert whitening.whiten(vectors(spark, rows)).collect() == []
    flat = whitening.whiten(vectors(spark, [[1.0, 7.0], [2.0, 7.0], [4.0, 7.0]])).collect()
    assert sorted((r.vec_id, r.component) for r in flat) == [(0, 1), (1, 1), (2, 1)]
    huge = whitening.whiten(vectors(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 0.0]])).collect()
    assert {r.vec_id: r.deviation for r in huge} == {0: None, 1: None, 2: (3 * 0 - 64) ** 2}
    same = whitening.whiten(vectors(spark, [[0.0], [1.0], [1.0]], [5, 5, None])).collect()
    assert sorted((str(r.vec_id), r.component) for r in same) == [("5", 1), ("5", 1), ("None", 1)]


# ---- filter audit -------------------------------------------------------------------------------

TOKENS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, n long, mask int, part string"


def audit_by_brute_force(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, source, *_ in docs:
        t = text or ""
        w = TOKENS.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if t in least and (i is None or least[t] < i) else set()
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                failing = [r for r in mine if f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    got = audit.audit_filters(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(out) == len(got)
    return out


def test_filter_audit_by_brute_force(spark):
    rnd = random.Random(4)
    pool = ["", None, "a b", "A # b", "B " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i % 90}" for i in range(199)), "\x0b\x1fx y\x85z " * 70, "é$ " * 210]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(pool), rnd.choice(["p", "q", None, ""]), 1, 2, "z") for _ in range(200)]
    docs += docs[:20]
    labels = [(rnd.choice([None, *range(90)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)]
    assert audited(spark, docs, labels) == audit_by_brute_force(docs, labels)
    assert audited(spark, docs[:1], []) == audit_by_brute_force(docs[:1], [])
    assert audited(spark, [], labels) == {}


def test_exact_limits_of_the_filters(spark):
    w = lambda n, k: " ".join(f"w{i % k}" for i in range(n))
    texts = [w(199, 199), w(200, 200), w(200, 100), w(201, 100), w(202, 101), "A" + "b" * 49, "A" + "b" * 48, "AB" + "b" * 98, "É" * 10]
    docs = [(i, t, "s", 0, 0, "z") for i, t in enumerate(texts)]
    assert audited(spark, docs, []) == audit_by_brute_force(docs, [])


def test_a_text_keeps_little_per_document(spark, tiny):
    """What leaves the texts is narrow, and no sort or window sees the text itself."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    plan = audit.audit_filters(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Aggregate" in line or "Window" in line or "Join" in line:
            assert "text#" not in line
