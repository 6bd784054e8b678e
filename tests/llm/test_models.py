"""Held-out quality of what is trained."""

import numpy as np
import pytest

from stylemill.llm import language_id, quality_classifier, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality(tables):
    docs, labels = tables
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity(tables):
    docs, labels = tables
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.85
    assert np.mean([r.predicted == r.toxic for r in rows if not r.held_out]) > 0.95


def test_language(tables):
    docs, _ = tables
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98


def test_isotonic_is_monotone_and_follows_the_bins():
    n = np.array([10.0, 10, 0, 10, 10])
    curve = quality_classifier.isotonic(n, np.array([1.0, 4, 0, 2, 9]))
    assert (np.diff(curve) >= 0).all() and abs(curve[1] - 6.5 / 21) < 1e-9 and curve[1] == curve[2] == curve[3]
    assert (quality_classifier.isotonic(np.zeros(5), np.zeros(5)) == 0.5).all()
