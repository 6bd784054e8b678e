"""Every operator and stage on awkward rows and on an empty table."""

import math

import pytest

import corpus_pipeline
from stylemill.llm import decontamination, katz, language_id, quality_classifier, quality_rules, sampled_segmentation, simhash, substring_dedup, token_counts, toxicity

OPERATORS = {
    "op1": lambda d, l, b: quality_classifier.classify(d, l),
    "op2": lambda d, l, b: simhash.op2(d),
    "op3": lambda d, l, b: token_counts.count_tokens(d),
    "op4": lambda d, l, b: language_id.identify(d),
    "op5": lambda d, l, b: substring_dedup.op5(d),
    "op6": lambda d, l, b: quality_rules.op6(d),
    "op7": lambda d, l, b: toxicity.classify(d, l),
    "op9": lambda d, l, b: katz.score(d),
}


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, awkward, no_labels, benchmark):
    rows = OPERATORS[name](awkward, no_labels, benchmark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in awkward.collect())
    assert not any(isinstance(x, float) and not math.isfinite(x) for r in rows for x in r)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(x for x in r))
    assert len(by[1]) == 1  # repeated rows are treated alike


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_with_labels(name, awkward, spark, benchmark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (6, None, None), (None, 1, 1), (5, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    if name in ("op1", "op7"):
        assert OPERATORS[name](awkward, labels, benchmark).count() == awkward.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, nothing, no_labels, benchmark):
    assert OPERATORS[name](nothing, no_labels, benchmark).count() == 0


def test_sampling_and_leaks_on_edges(awkward, nothing, benchmark, spark):
    rows = sampled_segmentation.encode(awkward, with_ids=False).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in awkward.collect()}
    assert {r.doc_id for r in rows if not r.round_trip} == {9}  # it holds the word mark itself
    assert sampled_segmentation.encode(nothing).count() == 0
    assert decontamination.leaks(nothing, benchmark).count() == 0
    assert decontamination.leaks(awkward, benchmark).count() == 0
    assert decontamination.leaks(awkward, benchmark.limit(0)).count() == 0
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs far away."), (2, None), (3, "..."), (None, "runs far away")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(awkward, items).collect()} == {(1, 1), (2, 1), (None, 1)}


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_stages(table, request, spark):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        out.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()


def test_verdicts_on_edges(awkward):
    by = {r.doc_id: r for r in substring_dedup.op5(awkward).collect() if r.doc_id is not None}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_words and by[6].n_removed == by[6].n_words and by[5].n_removed == 0
    null = [r for r in substring_dedup.op5(awkward).collect() if r.doc_id is None]
    assert sorted(r.n_removed for r in null) == [0, by[1].n_words]
    groups = {r.doc_id: r.component_id for r in simhash.op2(awkward).collect() if r.doc_id is not None}
    assert groups[2] == 1 and groups[6] == 5 and groups[3] == groups[4] == groups[7] == 3
    lang = {r.doc_id: r.lang_pred for r in language_id.identify(awkward).collect() if r.doc_id is not None}
    assert lang[3] == lang[4] == lang[7] == lang[8] == "und" != lang[1]
