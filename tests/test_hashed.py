"""n-grams counted by hashes against a count of their words."""

import random
from collections import Counter

from stylemill.operators import measure


def test_counts_are_those_of_the_words(spark):
    rng = random.Random(8)
    rows = [("ab"[i % 2], i, rng.choice([None, "", "One", " ".join(rng.choices(["Aa", "bb", "it's", "the", "of", "d9", "É", "K"], k=40))])) for i in range(200)]
    rows += [(None, 900, "x y z x y z x y z")]
    want = Counter()
    for p, _, t in rows:
        w = [x.replace("K", "k") for x in (t or "").lower().split() if x != "é"]
        for n in (2, 3):
            for i in range(len(w) - n + 1):
                if sum(x in ("the", "of", "it's") for x in w[i : i + n]) < n - 1:
                    want[p, n, tuple(w[i : i + n])] += 1
    docs = spark.createDataFrame(rows, "profile string, doc_id long, text string").repartition(3)
    got = measure.gram_repeats(docs, ["the", "of", "it's"]).collect()
    assert Counter((r.profile, r["size"], r.n) for r in got) == Counter((p, n, c) for (p, n, _), c in want.items())


def test_grams_are_dealt_out_once_before_they_are_counted(spark, docs):
    executed = measure.gram_repeats(docs("a b c"))._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1
    assert executed.index("HashAggregate") < executed.index("Exchange") and "HashAggregate" not in executed[executed.index("Exchange") :]
