"""Every operator on odd inputs: nulls everywhere, empty texts, repeated rows, no rows, extra columns
with clashing names."""

from __future__ import annotations

import pytest

from wattloom.llm import decontaminate, langid, lm, media, mixing, neardup, pii, quality, repeats, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tid long, score double, rid string, _day string, key int, row int, h long"
ODD = [
    (1, "a b c d e f g", "en", "s", 13, 1, 0.5, "x", "d", 1, 2, 3),
    (1, "a b c d e f g", "en", "s", 13, 1, 0.5, "x", "d", 1, 2, 3),
    (2, None, None, None, None, None, None, None, None, None, None, None),
    (None, "word", None, "s", 4, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, None, None, None, None, None, None, None),
    (4, " \n\t ", "de", "s", 4, None, None, None, None, None, None, None),
    (5, "long " * 60_000, "en", "s", 300_000, None, None, None, None, None, None, None),
    (6, "éè \U0001f600 12", "fr", "s", 7, None, None, None, None, None, None, None),
]
LABELS = "doc_id long, quality int, toxic int, text string"
SOME = [(1, 1, 0, "z"), (5, 0, 1, "z"), (5, 0, 1, "z"), (None, 1, 1, None), (6, None, None, None), (4, 1, None, None)]
ITEMS = "item_id long, text string, score int"
TESTS = [(1, "a b c d e f g", 1), (2, None, 1), (3, "", 1), (None, "a b c d e f g", 1), (4, "two words", 1)]


@pytest.fixture(params=["odd", "none"])
def tables(request, spark):
    rows, labels, tests = {"odd": (ODD, SOME, TESTS), "none": ([], [], [])}[request.param]
    return tuple(spark.createDataFrame(r, s) for r, s in ((rows, DOCS), (labels, LABELS), (tests, ITEMS)))


PER_ROW = {
    "media": lambda d, lab, t: media.text_clips(d),
    "lm": lambda d, lab, t: lm.score_documents(d),
    "toxicity": lambda d, lab, t: toxicity.score_toxicity(d, lab),
    "neardup": lambda d, lab, t: neardup.duplicate_classes(d),
    "pii": lambda d, lab, t: pii.find_pii(d),
    "repeats": lambda d, lab, t: repeats.remove_repeats(d),
    "mixing": lambda d, lab, t: mixing.mix(d, mixing.label_domains(lab)),
    "quality": lambda d, lab, t: quality.score_quality(d, lab),
    "langid": lambda d, lab, t: langid.identify(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(name, tables):
    got = PER_ROW[name](*tables).collect()
    ids = sorted((r.doc_id for r in tables[0].collect()), key=str)
    assert sorted((r.doc_id for r in got), key=str) == ids


@pytest.mark.parametrize("name", ["toxicity", "quality", "mixing"])
def test_without_labels(name, spark):
    docs, labels, tests = (spark.createDataFrame(r, s) for r, s in ((ODD, DOCS), ([], LABELS), ([], ITEMS)))
    assert len(PER_ROW[name](docs, labels, tests).collect()) == len(ODD)


FILTERS = {
    "toxicity": (lambda d, lab, t: toxicity.drop_toxic(d, lab), None),
    "neardup": (lambda d, lab, t: neardup.drop_duplicates(d), ["1", "2", "4", "5", "6", "None"]),
    "decontaminate": (lambda d, lab, t: decontaminate.drop_contaminated(d, t), None),
    "pii": (lambda d, lab, t: pii.redact(d), None),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(name, tables):
    run, kept = FILTERS[name]
    got = run(*tables)
    assert got.columns == tables[0].columns
    rows = got.collect()
    if kept and tables[0].take(1):
        assert sorted(str(r.doc_id) for r in rows) == kept


def test_contaminated_rows(spark):
    got = decontaminate.contaminated(spark.createDataFrame(ODD, DOCS), spark.createDataFrame(TESTS, ITEMS)).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in got) == [(1, "1"), (1, "1"), (1, "None"), (1, "None")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, rows):
    import corpus_pipeline

    for name, data, schema in (("documents", rows, DOCS), ("labels", SOME if rows else [], LABELS), ("benchmark", TESTS if rows else [], ITEMS)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and (not rows or 5 in {r.doc_id for r in got})
    assert 1 not in {r.doc_id for r in got}  # holds a test item


def test_clips_of_repeated_rows_and_clashing_columns(spark):
    rows = [("a", media.write_avi([]), 3), (None, b"", 4), ("a", None, None)] + [("b", media.write_avi(media.encode_all([b"x" * 64])[0]), 1)] * 2
    got = media.avi_clips(spark.createDataFrame(rows, "id string, media binary, clip int"), "id", "media").collect()
    assert sorted((str(r.id), r.clip) for r in got if r.error is None) == [("b", 0), ("b", 0)]
    assert sorted(str(r.id) for r in got if r.error) == ["None", "a"]
