"""n-grams of a corpus against a walk over its words, with documents shorter than an n-gram and without words."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stylemill.operators import sequences


@pytest.mark.parametrize("n", [2, 3, 4])
def test_against_a_walk(spark, n):
    rng = random.Random(n)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "the", "dd"], k=rng.choice([0, 0, 1, 1, 2, 3, 9]))) for _ in range(300)]
    rows = [("ab"[i % 2], i * 3 - 50, t if t or i % 5 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "profile string, doc_id long, text string").repartition(4)
    want = {}
    for p in "ab":
        words = [w for q, _, t in rows if q == p for w in (t or "").split()]
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        grams = [(i, g) for i, g in enumerate(grams) if sum(w == "the" for w in g) < n - 1]
        first = {}
        for i, g in grams:
            first.setdefault(g, i)
        top = sorted(Counter(g for _, g in grams).items(), key=lambda x: (-x[1], first[x[0]]))
        want[p] = [(" ".join(g), c) for g, c in top[:7]]
    got = {p: [] for p in "ab"}
    for r in sequences.top_corpus_ngrams(docs, n, 7).orderBy("rank").collect():
        got[r.profile].append((r.phrase, r.n))
    assert got == want


def test_no_profile_is_put_in_order(spark):
    docs = spark.range(5000).select(F.lit("a").alias("profile"), F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    plan = sequences.corpus_ngrams(docs, 3)._jdf.queryExecution().executedPlan().toString()
    over = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "windowspecdefinition(" in line and "doc_id" in line]
    assert over and all("_block" in x.split("ASC")[0] for x in over)


def test_counting_shuffles_numbers_alone(spark):
    """Phrases are read again for the first k; what is counted are hashes, by an aggregate of numbers."""
    docs = spark.createDataFrame([("a", 1, "x y x"), (None, 2, "x y z"), ("a", None, "y x"), ("a", 3, "y")], "profile string, doc_id long, text string")
    got = sequences.top_corpus_ngrams(docs, 2, 2)
    assert {(r.profile, r["rank"], r.phrase, r.n) for r in got.collect()} == {("a", 1, "y x", 2), ("a", 2, "x y", 2), (None, 1, "x y", 1), (None, 2, "y z", 1)}
    plan = sequences.corpus_repetition(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(w#" not in plan and "min(struct" not in plan and "MapInArrow" in plan
