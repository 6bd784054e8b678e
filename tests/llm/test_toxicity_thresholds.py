"""Thresholds come from all labelled rows, in their natural ratio."""

from collections import namedtuple

import numpy as np
from pyspark.sql import functions as F

from stylemill.llm import toxicity

Row = namedtuple("Row", "y lang bin n seen")


def test_all_labelled_rows_are_counted_whatever_the_sample(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    real, got = toxicity.shifts, []
    monkeypatch.setattr(toxicity, "shifts", lambda counts, n: got.append(counts) or real(counts, n))
    toxicity.classify(docs, labels, sample=20).count()
    y = labels.where("toxic is not null").where(toxicity.fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    want = {r.y: r.n for r in docs.join(y, "doc_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert {k: sum(r.n for r in got[0] if r.y == k) for k in want} == want
    assert 0 < sum(r.seen for r in got[0]) <= 32


def test_threshold_is_that_of_the_natural_ratio():
    rng = np.random.default_rng(6)
    toxic, clean = rng.normal(1, 1, 4000), rng.normal(-1, 1, 32000)
    seen = 1600  # of each class, as the sample takes them
    rows = [Row(y, 0, b, n, 0) for y, z in ((1, toxic[seen:]), (0, clean[seen:])) for b, n in zip(*np.unique(np.floor(z / toxicity.BIN), return_counts=True), strict=True)]
    rows += [Row(y, 0, 0, seen, seen) for y in (0, 1)]

    def f1(cut):
        hit = (toxic >= cut).sum()
        return 2 * hit / (hit + (clean >= cut).sum() + len(toxic))

    cut = toxicity.shifts(rows, 1)[0]
    assert f1(cut) > max(f1(x) for x in np.arange(-2, 3, 0.05)) - 0.01 > f1(-0.2) + 0.1
