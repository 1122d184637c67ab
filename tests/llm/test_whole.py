"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pytest

from wattloom.llm import common, mixing, pii, repeats


@pytest.mark.parametrize("limit", [0, 1, 5, 512, 599, 600, 700])
def test_at_most_is_exact_above_a_million(spark, limit):
    counts = sorted((1 + 977 * i + (i % 7 == 0) * 3_000_000_000 for i in range(600)), reverse=True) + [1, 1, 1]
    least = common.at_most(spark.createDataFrame([(c,) for c in counts], "c long"), "c", limit)
    over = lambda c: sum(x >= c for x in counts)
    assert over(least) <= limit and (least == 1 or over(least - 1) > limit)


@pytest.mark.parametrize("tokens", [94, 95, 96, 191, 5_000])
def test_written_data_anywhere_in_a_long_region(tokens):
    chain = pii.train_chain(pii.labelled_table())
    filler = ("row 3 of 7 end " * (tokens // 5 + 1)).split()[:tokens]
    for value, kind in (("(212) 555-7814", "phone"), ("4929 . 1234 . 5678 . 9015", "card"), ("anna (at) firma (dot) de", "email")):
        words = {"phone": "call", "card": "number", "email": "write"}[kind]
        text = " ".join([*filler[1:], words, value, "soon", *filler])
        start = text.index(value)
        ((_, spans),) = pii.find_spans([text], chain)
        assert (start, start + len(value), kind) in spans


def test_a_rare_domain_is_learned_and_its_target_met(spark):
    def text(i, rare):
        return " ".join([f"w{(i * 7 + j) % 50}" for j in range(20)] + [f"rare{(i + j) % 5}" for j in range(20)] * rare)

    docs = spark.createDataFrame([(i, text(i, i % 100 == 0)) for i in range(1_000)], "doc_id long, text string")
    # ten of a thousand documents are rare; 4,000 more labels have no document
    labelled = spark.createDataFrame([(i, "rare" if i % 100 == 0 else "usual") for i in range(1_000)] + [(i, "gone") for i in range(1_000, 5_000)], "doc_id long, domain string")
    model = mixing.learn_membership(docs, labelled, sample=40)
    assert model.domains == ["rare", "usual"]
    np.testing.assert_allclose(np.exp(model.prior), [0.01, 0.99])
    rows = mixing.mix(docs, labelled, {"rare": 0.05, "usual": 0.95}).collect()
    mass = sum(r.rate * r.n_tokens * np.array(r.p) for r in rows)
    np.testing.assert_allclose(mass / sum(r.n_tokens for r in rows), [0.05, 0.95], atol=1e-3)


def test_targets_out_of_reach_are_reported(spark):
    members = spark.createDataFrame([(10, [0.6, 0.4]), (10, [0.5, 0.5])], "n_tokens long, p array<double>")
    with pytest.warns(RuntimeWarning, match="miss the targets"):
        mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    with pytest.warns(RuntimeWarning, match="no labelled document of c"):
        mixing.fit_rates(members, ["a", "b"], {"a": 0.5, "b": 0.4, "c": 0.1})


@pytest.mark.parametrize("period", ["x", "ab", "seven b", "p" * 99 + "q" * 101, "r" * 150 + "s" * 100])
def test_a_text_that_repeats_itself_gives_few_rows(spark, period):
    size = 3_000_000
    text = (period * (size // len(period) + 1))[:size]
    texts = spark.createDataFrame([(1, text), (2, "no repeat " + "".join(chr(33 + i * i % 89) for i in range(150)))], "tid long, text string")
    spans = repeats.repeated_spans(texts).where("tid = 1")
    if len(period) <= 137:  # every window holds a whole period, so all anchors follow themselves
        assert spans.count() < 100
    ends = spans.agg({"start": "min", "stop": "max"}).first()
    assert sorted(ends) == [0, size]
    (row,) = repeats.remove_repeats(texts.withColumnRenamed("tid", "doc_id")).where("doc_id = 1").collect()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (size, size, 1)


def test_a_very_long_blank_text(spark):
    rows = spark.createDataFrame([(1, " " * 24_000_000 + "end"), (2, "y" * 199)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(rows).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans, got[2].n_removed) == (24_000_003, 24_000_000, 1, 0)
