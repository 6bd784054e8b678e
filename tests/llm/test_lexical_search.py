"""Ranked search: codes, the merge and whole searches against plain scoring, in many shards and waves, and edges."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stylemill.llm import lexical_search as L

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return RUN.findall((text or "").translate(UPPER))


def plain(docs, items, k=L.TOP):
    """Every item against every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c in counts:
            m = 100 - L.B + L.B * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in docs], "doc_id long, text string, item_id long, term string, shard long").repartition(parts)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    return sorted((tuple(r) for r in L.search(L.build(d), b).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**63 - 1))))
def test_codes(xs):
    data, at = L.encode(np.array(xs, np.uint64))
    assert L.decode(data.tobytes()).tolist() == xs and len(at) == len(xs) + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 9), min_size=1), min_size=1, max_size=8), st.integers(1, 5))
def test_merge(lists, k):
    total = Counter()
    for x in lists:
        total.update(x)
    want = sorted(((s, -p) for p, s in total.items() if s > 0), reverse=True)[:k]
    given_ = [([*sorted(x)], [x[p] for p in sorted(x)], max(x.values()), {}) for x in lists]
    assert sorted(L.top_places(given_, k), reverse=True) == want


def test_against_plain_scoring(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(9000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(-i, f"{t}, É{i % 3}x e_{i}") for i, t in docs[:30]]
    items = [(i, " ".join(rng.choices(words, k=12)) + " éX É1x") for i in range(25)]
    want = plain(docs, items)
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(L, "SHARD_BYTES", 3000)
    monkeypatch.setattr(L, "SHARD_DOCS", 9)
    monkeypatch.setattr(L, "ITEM_BYTES", 400)
    assert searched(spark, docs, items, parts=2) == want


def test_edges(spark):
    long = "lang " * 300_000 + "x"
    docs = [(1, "fox fox dog"), (1, "fox fox dog"), (2, "fox fox dog"), (None, "fox fox dog"), (3, None), (4, ""), (5, "-- . \n"), (6, long), (7, "a\x00Fox\x85fox_dog ①"), (8, "Ünï ÜNÏ")]
    items = [(1, "the FOX, fox; dog!"), (1, "x"), (2, None), (3, ""), (4, "?"), (None, "dog"), (5, "ünï"), (6, "absent"), (7, "①"), (8, "lang lang")]
    got = searched(spark, docs, items)
    assert got == plain(docs, items)
    assert [r[2] for r in sorted((r for r in got if r[0] == 1 and r[3] == max(x[3] for x in got if x[0] == 1)), key=lambda r: r[1])] == [1, 1, 2, None]
    assert searched(spark, [], items) == [] == searched(spark, docs, [])
    assert searched(spark, docs[4:7], items) == []
