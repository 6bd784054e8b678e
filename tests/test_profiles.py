"""Feedback on texts, the rating by shorter lists, and profiles that lack sections."""

import pytest
from pyspark.sql import functions as F

from stylemill.functions import lexicons as L
from stylemill.operators import measure as M
from stylemill.operators import profile as P
from stylemill.plans import api

CALM = ["The cat sat on the mat, and the dog, too, may perhaps have slept. It was warm."] * 3
LOUD = ["Stop! Why? No, never; clearly you must run - go, go, 'go'! (Now.) " * 4] * 3


@pytest.fixture
def both(docs):
    return docs(*CALM, profile="a").unionByName(docs(*LOUD, profile="b"))


@pytest.fixture
def crossed(both):
    m = P.measurements(both)
    return P.compliance(m.withColumn("id", F.col("profile")).withColumn("profile", F.when(F.col("id") == "a", "b").otherwise("a")), m)


def test_feedback_names_what_is_most_off(crossed):
    deltas = {r.id: sorted(r.deltas, key=lambda d: -d.diff) for r in crossed.collect()}
    rows = P.feedback(crossed, 7).collect()
    for r in rows:
        d = deltas[r.id][r["rank"]]
        assert (r.metric, r["diff"], r.actual, r.target) == tuple(d)
        assert r.advice == P.ADVICE[r.metric.split(".")[0]]
        assert r.change == (None if len(r.actual) > 1 else "less" if r.actual[0] > r.target[0] else "more")
    assert {(r.metric, r.path) for r in rows} >= {("punctuation.exclamations", "punctuation.rates_per_1000w.exclamations")}
    assert len(rows) == sum(min(7, len(d)) for d in deltas.values())
    assert P.feedback(crossed.where("false")).count() == 0


def test_metrics_have_names_for_all_of_their_values(both):
    row = P.measurements(both).first()
    assert {s: len(row[s]) for s in P.METRICS} == {s: len(v) for s, v in P.METRICS.items()}
    assert set(P.PATHS) == set(P.ADVICE) == set(P.METRICS) | {"sentence_length_histogram", "paragraph_length_histogram", "one_sentence_paragraph_rate"}


def test_metrics_left_out(both, crossed):
    m = P.measurements(both)
    own = m.withColumn("id", F.col("profile")).withColumn("profile", F.when(F.col("id") == "a", "b").otherwise("a"))
    rated = {r.id: r for r in P.compliance(own, m, without=L.UNRATED).collect()}
    for r in crossed.collect():
        out = {f"punctuation.{k}" for k in L.UNRATED["punctuation"]}
        assert [d for d in r.deltas if d.metric not in out] == rated[r.id].deltas and out & {d.metric for d in r.deltas}
    alone = M.document_repetition(both.limit(1), stop=L.RATED_STOP_WORDS).first(), M.document_repetition(both.limit(1)).first()
    assert all(x.bigram_repeat_rate is not None for x in alone)


def test_lacking_sections(both):
    m = P.measurements(both)
    whole = P.similarity(m).first()
    part = P.similarity(m.withColumn("stance", F.when(F.col("profile") != "a", F.col("stance"))).withColumn("repetition", F.array().cast("array<double>"))).first()
    w = L.SIMILARITY_WEIGHTS
    out = {"stance_signals", "repetition"}
    assert whole.coverage == 1 and {k for k in w if part[k] is None} == out
    assert part.coverage == pytest.approx(1 - sum(w[k] for k in out), abs=1e-6)
    assert part.similarity == pytest.approx(sum(whole[k] * w[k] for k in w if k not in out) / sum(w[k] for k in w if k not in out), abs=1e-5)
    assert part.confidence < whole.confidence
    assert {r.component for r in P.worst(P.similarity(m.drop("stance")), 11).collect()} == set(w) - {"stance_signals"}


def test_lexicons_are_compared(both):
    m = P.measurements(both).withColumn("preferred", F.when(F.col("profile") == "a", F.array(*map(F.lit, "xyz"))).otherwise(F.array(*map(F.lit, "yzq"))))
    m = m.withColumn("avoid", F.when(F.col("profile") == "a", F.array(F.lit("x"))))
    pair = P.similarity(m).first()
    assert (pair.lexicon_preferred_overlap, pair.lexicon_avoid_overlap) == (0.5, 0.0)


def test_ids_of_profiles_stay(both):
    made = api.make(both)
    assert {r.id for r in made.collect()} == {r.id for r in made.collect()} and all(len(r.id) == 36 for r in made.collect())


def test_documents_are_counted_once(spark, monkeypatch):
    """Compliance takes both sides from one pass of counts; n-grams of both sizes come from one reading of the words."""
    from stylemill.operators import measure, profile
    from stylemill.plans import catalogue

    calls, counts = [], profile.counts
    monkeypatch.setattr(profile, "counts", lambda *a: calls.append(a) or counts(*a))
    assert catalogue.compliance(spark, "/root/testdata/sf0.001").count() == 200 and len(calls) == 1
    docs = catalogue.corpus(spark, "/root/testdata/sf0.001")
    assert measure.repetition_rates(docs)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def test_repetition_against_a_count(spark):
    import random
    from collections import Counter

    from stylemill.functions import lexicons as L
    from stylemill.operators import measure

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "ab", "cd", "it's", "x"], k=n)) for n in (0, 1, 2, 3, 5, 40, 200)] + [None]

    def rate(w, n):
        g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        c = Counter(x for x in g if sum(t in L.STOP_WORDS for t in x) < n - 1)
        return round(sum(v for v in c.values() if v >= 3) / max(1, sum(c.values())), 6)

    docs = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "profile string, doc_id long, text string")
    want = {str(i): (rate((t or "").split(), 2), rate((t or "").split(), 3)) for i, t in enumerate(texts)}
    for fn in (measure.repetition_rates, measure.document_repetition):
        assert {r.profile: (r.bigram_repeat_rate, r.trigram_repeat_rate) for r in fn(docs).collect()} == want
