"""Operators against brute force."""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wattloom.llm import decontaminate, lm, mixing, neardup, repeats
from wattloom.llm.textblocks import blocks, tokenize

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return SPACE.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_language_model_base(docs, texts):
    count = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update([*tokens(t), "\n"])
    n, v = sum(count.values()), len(count)
    gain = []
    for r in lm.score_documents(docs).collect():
        ts = [*tokens(texts[r.doc_id]), "\n"]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(count[w] > 0 for w in ts), n)
        if r.held_out:
            gain.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gain) > 0.07


def small_lexicon(spark, texts):
    return lm.lexicon(lm.token_counts(spark.createDataFrame([(t,) for t in texts], "text string")))


def sequence_of(lex, texts):
    (block,) = blocks(pa.array(texts))
    t = tokenize(block)
    return t, lm.sequence(t, lex, *lex.find(t.hash.view(np.int64)))


def test_probabilities_add_up_over_all_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    rng = random.Random(3)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(30)) for _ in range(40)]
    lex = small_lexicon(spark, texts)
    model = lm.start_model(lex)
    for name in ("word", "output", "group"):
        setattr(model, name, np.random.default_rng(1).normal(0, 0.5, getattr(model, name).shape))
    t, s = sequence_of(lex, [texts[0], ""])
    r = model.context(s)[:1]
    p = np.exp([model.log_probabilities(r, np.array([o]), lex.first)[0] for o in range(len(lex.output_count))])
    assert p.sum() == pytest.approx(1) and len(p) == min(20, len(lex.hash)) + lm.GROUPS + 1
    # within the rest of a group: smoothed counts of its words and one place for all others
    for g in np.flatnonzero(lex.rest_tokens):
        of = lex.count[(lex.output == lex.first[g + 1] - 1)]
        total = lex.rest_tokens[g] + 0.1 * (lex.rest_types[g] + 1)
        assert (of + 0.1).sum() / total + 0.1 / total == pytest.approx(1)
    # contexts do not cross documents: the first word sees ends only
    words = len(lex.hash)
    assert [s.word[b[1]] for b in s.before] == [words + lm.GROUPS] * lm.POSITIONS
    assert s.word[s.before[1][2]] == words + lm.GROUPS and s.output[-1] == lex.end and len(s.word) == len(t.hash) + 3


def test_training_learns_word_order(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP_TOKENS", 256)
    rng = random.Random(5)
    texts = [" ".join(f"a{k} b{k} c{k}" for k in (rng.randrange(30) for _ in range(30))) for _ in range(300)]
    lex = small_lexicon(spark, texts)
    start = lm.start_model(lex)
    model = start
    docs = spark.createDataFrame([(t,) for t in texts[30:]], "text string").repartition(2)
    for _ in range(3):
        model = lm.train_round(docs, lex, model)
    _, s = sequence_of(lex, texts[:30])
    before, after = (m.log_probabilities(m.context(s), s.output[1:], lex.first).mean() for m in (start, model))
    assert after > before + 0.7


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 800)
    monkeypatch.setattr(lm, "SHARD_TASKS", 3)  # several shards in a task
    rng = random.Random(8)
    rows = [(i if i % 5 else None, " ".join(f"a{k} b{k}" for k in (rng.randrange(40) for _ in range(rng.randint(0, 40))))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharded = lm.in_shards(docs, 6_000)
    assert sharded.rdd.getNumPartitions() == 3 and sharded.count() == 150 and sharded.select("shard").distinct().count() > 3
    got = [sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm.score_documents(docs.repartition(n)).collect()) for n in (1, 7)]
    np.testing.assert_allclose(got[0], got[1], rtol=1e-6)


def test_every_token_of_a_shard_takes_part(spark, monkeypatch):
    monkeypatch.setattr(lm, "FIRST_STEP", 16)
    monkeypatch.setattr(lm, "STEP_TOKENS", 64)
    texts = [" ".join(f"w{i * j % 17}" for j in range(300)) for i in range(1, 90)]
    lex = small_lexicon(spark, texts)
    _, s = sequence_of(lex, texts)
    trainer = lm.Trainer(lm.start_model(lex), lex)
    trainer.take(s)
    assert trainer.tokens == len(s.word) - 1 == trainer.output_met.sum()


@pytest.mark.parametrize(("words", "count", "head", "kept"), [(700, 2_000_000, 512, 512), (500, 2_000_000, 512, 500), (30, 5, 40, 30)])
def test_border_of_the_head_with_many_equal_counts(spark, monkeypatch, words, count, head, kept):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "DICTIONARY", 600)
    rows = spark.range(words).selectExpr("xxhash64(id) AS h", "cast(id % 7 AS int) AS grp", f"{count}L AS c").union(spark.sql(f"SELECT {lm.END_HASH}L, 0, 9L"))
    lex = lm.lexicon(rows)
    assert len(lex.output_count) == kept + lm.GROUPS + 1 and lex.tokens == words * count + 9
    assert lex.output.max() < len(lex.output_count) and (~lex.is_rest[lex.output]).sum() == kept
    assert lex.output_count.sum() == lex.tokens and len(lex.hash) == min(words, 600)


def brute_removed(raws, length=200):
    count = collections.Counter(b[p : p + length] for b in raws for p in range(len(b) - length + 1))
    for b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        yield gone


def test_pieces_of_a_long_text_hold_every_window_once(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(900)) + "x" * 700
    column, tids = pa.array(["a" * 300, text, "b"]), np.array([5, 6, 7])
    monkeypatch.setattr(repeats, "blocks", functools.partial(blocks, limit=1))
    found = []
    for piece in (8_000_000, 250):
        monkeypatch.setattr(repeats, "PIECE", piece)
        windows = {}
        for block, tid, fresh, base in repeats._pieces(tids, column, {7}):
            a = repeats.anchors(block)
            assert fresh.tolist() == [tid[0] != 7]
            for d, start, count, shift in zip(a.doc, a.start, a.count, a.shift):
                for i in range(count):
                    at = (int(tid[d]), base + int(start) + i)
                    assert at not in windows
                    windows[at] = base + int(start + shift)  # the anchor's place
        found.append(windows)
    assert found[0] == found[1] and len(found[0]) == 101 + len(text) - 199


@pytest.mark.parametrize("hot", [2_000, 1])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(70), text(55)
    rows = [text(rng.randint(0, 120)) for _ in range(30)]
    rows += [text(rng.randint(0, 40)) + shared[rng.randint(0, 60) :] + text(rng.randint(0, 40)) for _ in range(12)]
    rows += [line + text(3) + line, "ab" * 400, "ab" * 399 + "c", shared, shared, "x" * 199, "x" * 200, "x" * 201, "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    raws = [(t or "").encode() for t in rows]
    for i, gone in enumerate(brute_removed(raws)):
        kept = bytes(np.frombuffer(raws[i], np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raws[i]), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_plain_doubling_finds_the_same_spans(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    shared = text(70)
    rows = [text(rng.randint(0, 60)) for _ in range(8)] + [text(5) + shared + text(9), shared[30:] + text(4), "ab" * 150, ""]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "tid long, text string").repartition(3)
    for spans in (repeats.doubled_spans(texts), repeats.repeated_spans(texts.where("octet_length(text) >= 200"))):
        cover = {i: np.zeros(len(t.encode()), bool) for i, t in enumerate(rows)}
        for r in spans.collect():
            cover[r.tid][r.start : r.stop] = True
        for i, gone in enumerate(brute_removed([t.encode() for t in rows])):
            assert cover[i].tolist() == gone.tolist(), i


def test_names_tell_patterned_bytes_apart():
    from wattloom.llm import textblocks as tb

    thue = [bin(i).count("1") % 2 for i in range(4096)]
    a = bytes(97 + x for x in thue)
    data = np.frombuffer(a + bytes(195 - x for x in a) + b" ", np.uint8)
    t = tb.token_hashes(data, np.array([0, 4096]), np.array([4096, 8192]))
    n = tb.name_ranges(tb.names(data), np.array([0, 4096]), np.array([4096, 8192]))
    assert t[0] != t[1] and n[0] != n[1]
    starts = np.arange(len(data) - 63)
    seen = {}
    for i, h in zip(starts.tolist(), tb.names(data).tolist()):
        assert seen.setdefault(h, data[i : i + 64].tobytes()) == data[i : i + 64].tobytes()


def shingles(text):
    t = tokens(text)
    return collections.Counter(tuple(t[j : j + 5]) for j in range(max(1, len(t) - 4))) if t else collections.Counter()


def brute_classes(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if same or sum((sets[a] & sets[b]).values()) >= 0.8 * max(sum((sets[a] | sets[b]).values()), 1):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_duplicate_classes(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_TEXTS", chunk)
    rng = random.Random(9)
    more = dict(texts)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    for k in range(60):  # copies at growing distances, chains and mutual strangers among them
        copy = base[:]
        for _ in range(k % 12):
            copy[rng.randrange(200)] = f"v{rng.randint(0, 10**6)}"
        more[10_000 + k] = " ".join(copy)
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.duplicate_classes(df).collect()}
    assert got == brute_classes(more)
    kept = {r.doc_id for r in neardup.drop_duplicates(df).collect()}
    assert kept == set(got.values())


def test_overlaps_and_spanning_links():
    rng = np.random.default_rng(5)
    cells = [np.unique(rng.integers(0, 9_000, rng.integers(0, 6_000)).astype(np.uint64)) for _ in range(7)]
    left, right = np.array([0, 2, 3]), np.array([1, 4, 5, 6])
    want = [[len(np.intersect1d(cells[i], cells[j])) for j in right] for i in left]
    assert neardup.overlaps(cells, left, right).tolist() == want
    near = np.zeros((6, 6), bool)
    for i, j in ((0, 3), (3, 5), (5, 0), (1, 2)):
        near[i, j] = near[j, i] = True
    assert sorted(tuple(sorted(e)) for e in neardup.spanning_links(near)) in ([(0, 3), (0, 5), (1, 2)], [(0, 3), (1, 2), (3, 5)])


def test_recall_of_links_just_above_the_threshold(spark):
    rng = random.Random(12)
    rows = []
    for k in range(300):  # pairs of 0.80 to 0.83
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(204)]
        cut = rng.randint(18, 22)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: 204 - cut], *(f"v{rng.randint(0, 10**9)}" for _ in range(cut))]))]
    got = neardup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sets = {i: set(shingles(t)) for i, t in rows}
    linked = [k for k in range(300) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    found = {r.doc_id for r in got if r.class_size == 2}
    assert len(linked) > 150 and sum(2 * k in found for k in linked) >= 0.99 * len(linked)
    assert all(i // 2 in linked for i in found)


def test_signatures_estimate_weighted_jaccard():
    import pyarrow as pa

    from wattloom.llm.textblocks import blocks

    a = " ".join(f"a{i}" for i in range(300))
    b = " ".join(f"a{i}" for i in range(60, 360))
    (block,) = blocks(pa.array([a, b]))
    cells, bounds = neardup.weighted_cells(block)
    sig = neardup.dart_signatures(cells, bounds, 2000)
    exact = neardup.similarity(*(np.sort(cells[x:y]).tobytes() for x, y in zip(bounds, bounds[1:])))
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.04)


def brute_tiles(text, item, least):
    used_t, used_i, tiles = [False] * len(text), [False] * len(item), []
    while True:
        best = []
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used_t[i + n] and not used_i[j + n]:
                    n += 1
                if n >= least and (not best or n > best[0]):
                    best = [n, i, j]
        if not best:
            return tiles
        n, i, j = best
        tiles.append((i, j, n))
        for k in range(n):
            used_t[i + k] = used_i[j + k] = True


def test_tiles_are_greedy():
    rng = random.Random(3)
    for _ in range(60):
        text, item = [rng.choice("abc") for _ in range(40)], [rng.choice("abc") for _ in range(25)]
        seeds = [(i, j) for i in range(36) for j in range(21) if text[i : i + 5] == item[j : j + 5]]
        i, j = (np.array([s[k] for s in seeds], int) for k in (0, 1))
        got, want = decontaminate.greedy_tiles(i, j, 40, 25), brute_tiles(text, item, 5)
        assert [n for _, _, n in sorted(got, key=lambda t: -t[2])][:1] == [n for _, _, n in want][:1]
        assert all(text[a : a + n] == item[b : b + n] for a, b, n in got)


def test_reordered_passages_are_caught(spark):
    item = [f"t{i}" for i in range(40)]
    parts = [item[i : i + 8] for i in range(0, 40, 8)]
    rng = random.Random(1)
    mixed = sum(([*p, "x"] for p in rng.sample(parts, 5)), [])
    docs = [(1, " ".join(mixed)), (2, " ".join(item[:12])), (3, " ".join(rng.sample(item, 40))), (4, "prefix " + " ".join(item).upper())]
    for block_mb in (16, 1e-4):
        got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "other words of no kind here")], "item_id long, text string"), block_mb=block_mb)
        assert {(r.doc_id, r.item_id, r.covered_tokens, r.n_tiles) for r in got.collect()} == {(1, 7, 40, 5), (4, 7, 40, 1)}


def test_a_template_that_all_items_share_stays_cheap():
    """One text a thousand times the five words that 3,000 items share, and one whole item."""
    from wattloom.llm.textblocks import blocks as cut

    template = "fill in the form below"
    rows = [(i, f"{template} " + " ".join(f"q{i}x{k}" for k in range(20))) for i in range(3000)]
    items = decontaminate.index_items(rows)
    began = time.time()
    (block,) = cut(pa.array([f"{template} " * 1000, f"{template} {rows[7][1]} {template}", " ".join(rows[9][1].split()[:4]), ""]))
    assert [m[:4] for m in decontaminate._block_matches(block, items, 0.5)] == [(1, 7, 25, 25)]
    assert time.time() - began < 5


def test_contaminated_is_brute_force_tiling(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "EXPANDED", 50)
    rng = random.Random(11)
    items = [[rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randint(2, 18))] for _ in range(12)]
    docs = [[*(rng.choice("xyz") for _ in range(4)), *items[rng.randrange(12)][rng.randint(0, 4) :], "z", *items[rng.randrange(12)]] for _ in range(40)]
    items += [items[3], []]
    block_of = lambda rows: next(iter(blocks(pa.array([" ".join(r) for r in rows]))))
    got = {(m[0], m[1]): m[3] for m in decontaminate._block_matches(block_of(docs), decontaminate.index_items([(i, " ".join(t)) for i, t in enumerate(items)]), 0.5)}
    want = {}
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            total = sum(n for _, _, n in brute_tiles(d, item, 5))
            if item and total >= 0.5 * len(item):
                want[i, j] = total
    assert set(got) == set(want) and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)  # ties may be broken otherwise
    rows = decontaminate.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == set(want)


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.2, 0.3], 400)
    n = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    for want in ({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 0.98, "b": 0.01, "c": 0.01}):
        got = mixing.fit_rates(members, ["a", "b", "c"], want).collect()
        x = np.array([r.rate for r in got])
        mass = (np.array([r.p for r in got]) * (x * [r.n_tokens for r in got])[:, None]).sum(axis=0) / n.sum()
        assert (x >= 0).all()
        np.testing.assert_allclose(mass, list(want.values()), atol=2e-2 if want["a"] > 0.9 else 1e-3)


def test_a_pass_goes_over_few_steps_and_rates_are_those_of_plain_gradient_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p, n = rng.dirichlet([0.4, 0.2, 0.3], 300), rng.integers(1, 500, 300)
    want = np.array([0.2, 0.3, 0.5])
    gone_over = []
    moved = mixing._moved
    monkeypatch.setattr(mixing, "_moved", lambda state, steps, k: gone_over.append(len(steps)) or moved(state, steps, k))
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "id long, n_tokens long, p array<double>")
    out = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", want.tolist())))
    assert out.columns == ["id", "n_tokens", "p", "rate"] and len(gone_over) > mixing.KEPT >= max(gone_over)
    whiten = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-6, hermitian=True)
    x = y = np.ones(300)
    momentum, before = 1.0, np.inf
    for _ in gone_over:
        if np.abs((x * n) @ p / n.sum() - want).max() < mixing.CLOSE:
            break
        off = (y * n) @ p / n.sum() - want
        momentum = 1.0 if off @ whiten @ off > before else momentum
        before, following = off @ whiten @ off, (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        x, last = np.maximum(y - p @ (whiten @ off), 0), x
        y, momentum = x + (momentum - 1) / following * (x - last), following
    np.testing.assert_allclose([r.rate for r in out.orderBy("id").collect()], x, atol=1e-9)


def test_mixing_runs_no_python(docs, spark, tiny):
    out = mixing.mix(docs, mixing.label_domains(spark.read.parquet(f"{tiny}/labels.parquet")))
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = out.collect()
    assert len(rows) == docs.count() and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)


def test_whole_vocabulary_gives_the_same_as_a_large_bound(docs, spark, tiny):
    labels = mixing.label_domains(spark.read.parquet(f"{tiny}/labels.parquet"))
    rows = [{r.doc_id: (r.domain, r.n_tokens, [round(x, 6) for x in r.p]) for r in mixing.mix(docs, labels, vocabulary=v).collect()} for v in (None, 10**6)]
    assert rows[0] == rows[1] and len(rows[0]) == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("run_cost", [0, 2_000, 10**12])
def test_a_step_is_that_of_its_tokens_one_by_one(spark, monkeypatch, run_cost):
    monkeypatch.setattr(lm, "RUN_COST", run_cost)
    monkeypatch.setattr(lm, "HEAD", 150)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(int(rng.exponential(40)), 400)}" for _ in range(n)) for n in (30, 0, 1, 60)]
    lex = small_lexicon(spark, texts)
    _, s = sequence_of(lex, texts)
    model, start = lm.start_model(lex), lm.start_model(lex)
    for table in (model.word, model.output, model.group, model.group_bias, model.output_bias):
        table += rng.normal(0, 0.5, table.shape)
    trainer = lm.Trainer(model, lex, 3)
    choice = np.flatnonzero(np.diff(lex.first) > 1)
    assert [sum(a <= g < b for a, b in trainer.runs) for g in choice] == [1] * len(choice)
    runs = len(trainer.runs)  # each group alone, some together, all together
    assert {0: runs == len(choice), 2_000: 1 < runs < len(choice) / 2, 10**12: runs == 1}[run_cost]
    lo, hi = 2, len(s.word) - 3
    trainer.step(s, lo, hi)
    noise_share = np.exp(start.group_bias.astype(float))
    noise = np.searchsorted(np.cumsum(noise_share / noise_share.sum()), np.random.default_rng(3).random(lm.NOISE)).clip(0, lm.GROUPS - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    names = ("word", "position", "group", "output")
    old = {k: getattr(model, k).astype(float) for k in names}
    d = {k: np.zeros_like(v) for k, v in old.items()}
    for i in range(lo, hi):
        seen = [s.word[b[i]] for b in s.before]
        r = sum(old["word"][w] @ old["position"][k] for k, w in enumerate(seen))
        g, back = lex.group_of[s.output[i]], 0
        for q, target in [(g, 1), *((q, 0) for q in noise)]:
            miss = sigmoid(r @ old["group"][q] + model.group_bias[q] - np.log(lm.NOISE * noise_share[q])) - target
            d["group"][q] += miss * r
            back += miss * old["group"][q]
        for j in range(lex.first[g], lex.first[g + 1]) if g in choice else ():
            likely = sigmoid(r @ old["output"][j] + model.output_bias[j] - np.log(lm.NOISE) - start.output_bias[j])
            miss = likely * lm.NOISE * np.exp(start.output_bias[j]) + (j == s.output[i]) * (likely - 1)
            d["output"][j] += miss * r
            back += miss * old["output"][j]
        for k, w in enumerate(seen):
            d["word"][w] += old["position"][k] @ back
            d["position"][k] += np.outer(old["word"][w], back)
    for k in names:
        step = d[k] * (1 if k == "word" else (hi - lo) ** -0.5)
        rate = lm.RATE / np.sqrt(1 + (step.reshape(len(step), -1) ** 2).mean(axis=1))
        want = old[k] - rate.reshape(-1, *[1] * (step.ndim - 1)) * step
        np.testing.assert_allclose(getattr(trainer.model, k), want, atol=2e-5, err_msg=k)


def test_contexts_are_those_of_the_places_before(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 7)
    texts = ["a b c d e f g h i", "", "a c e", "x"]
    lex = small_lexicon(spark, texts)
    _, s = sequence_of(lex, texts)
    model = lm.start_model(lex)
    model.word += np.random.default_rng(2).normal(0, 1, model.word.shape)
    want = [sum(model.word[s.word[b[i]]] @ model.position[k] for k, b in enumerate(s.before)) for i in range(1, len(s.word))]
    np.testing.assert_allclose(model.context(s), want, rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("size", [0.3, 60.0])
def test_scores_are_bounded_before_they_are_looked_at(monkeypatch, size):
    rng = np.random.default_rng(5)
    first = np.arange(lm.GROUPS + 1) * 3
    table = lambda n: rng.normal(0, size, (n, lm.DIM)).astype(np.float32)
    model = lm.LogBilinear(None, None, table(lm.GROUPS), np.zeros(lm.GROUPS, np.float32), table(first[-1]), np.zeros(first[-1], np.float32))
    r, output = table(200), rng.integers(0, first[-1], 200)
    told = []
    log_sum = lm._log_sum
    monkeypatch.setattr(lm, "_log_sum", lambda z, small: told.append(small) or log_sum(z, small))
    got = model.log_probabilities(r, output, first)
    z, own = (r @ model.group.T).astype(float), np.einsum("ij,ikj->ik", r, model.output.reshape(-1, 3, lm.DIM)[output // 3]).astype(float)
    want = [a[g] - a.max() - np.log(np.exp(a - a.max()).sum()) + b[k] - b.max() - np.log(np.exp(b - b.max()).sum()) for a, b, g, k in zip(z, own, output // 3, output % 3)]
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-4)
    assert all(told) if size < 1 else not any(told)
