"""The near_duplicates stage against Jaccard similarities of all pairs."""

import itertools

import numpy as np

import corpus_pipeline
from stylemill.llm import near_copies
from stylemill.llm.common import maybe

DATA = "/root/testdata/sf0.01"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept(rows):
    """rows: (doc_id, text) -> the doc_ids that represent their group."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    by, near = {}, {i: i for i, _ in sets}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for i, s in sets:
        for x in s:
            by.setdefault(x, []).append(i)
    of = dict(sets)
    for a, b in {p for v in by.values() for p in itertools.combinations(v, 2)}:
        if 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]):
            x, y = sorted((find(a), find(b)))
            near[y] = x
    return {i for i in near if find(i) == i}


def test_stage_drops_all_near_copies(spark):
    docs = corpus_pipeline.quality(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert got == kept(rows) and len({t for _, t in rows}) > len(got)


def test_copies_with_a_few_other_words_go(spark):
    words = [f"w{i}" for i in range(100)]
    other = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    # the last is close to the third alone, the third to the first
    rows = [(5, other()), (3, other(50)), (4, other(50, 52)), (9, other(50, 52, 97)), (7, "else " * 60), (None, other()), (8, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in near_copies.keep_representatives(docs).collect()) == [0, 1, 3, 7]


def test_components_larger_than_a_block_lose_no_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    # a text with few changes many times over, one whose copies drift away from it, both candidates of each other
    base = [f"w{i}" for i in range(60)]
    for k in range(60):
        words = list(base)
        words[rng.integers(60)] = f"x{k}"
        rows.append((len(rows), " ".join(words)))
    drift = base[:30] + [f"v{i}" for i in range(30)]
    for k in range(60):
        for _ in range(1 + k % 2):  # two other words often break the chain
            drift[rng.integers(60)] = f"y{k}"
        rows.append((len(rows), " ".join(drift)))
    rows = [(int(i), t) for i, (_, t) in zip(rng.permutation(len(rows)), rows, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert 10 < len(want) < len(rows) / 2
    for block in (100, 500, 3000):
        got = near_copies.near_copies(docs, block).where("doc_id = group").collect()
        assert {r.doc_id for r in got} == want


def test_block_pairs_are_those_of_different_labels(spark):
    # component 1: label 7 in blocks 10, 11, label 8 in 12, others in 13, 14; component 2: label 9 in 20, 21
    blocks = [(1, 10, 7), (1, 11, 7), (1, 12, 8), (1, 13, None), (1, 14, None), (2, 20, 9), (2, 21, 9)]
    got = near_copies.block_pairs(spark.createDataFrame(blocks, "component long, block long, one long")).collect()
    want = [(10, 12), (11, 12), *[(10, x) for x in (13, 14)], *[(11, x) for x in (13, 14)], *[(12, x) for x in (13, 14)], (13, 13), (13, 14), (14, 14)]
    assert sorted(tuple(sorted((r.a, r.b))) for r in got) == sorted(want)


def test_search_finds_every_link():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(60, 40 + rng.integers(12), replace=False)).astype(np.uint64) for _ in range(300)]
    near = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets])
    label = np.arange(300)
    while True:
        new = np.where(near, label[None, :], 300).min(1)
        if (new == label).all():
            break
        label = new
    assert (near_copies.search(sets) == label).all() and 1 < len(set(label.tolist())) < 300


def test_rows_that_are_maybe_in_hold_all_that_are(spark):
    rows = spark.range(5000).selectExpr("if(id = 7, null, id) as doc_id", "'x' as text")
    for ids in ([], [None], [0, 17, 4999, None, -3]):
        got = maybe(rows, spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id").where("_maybe").collect()
        # 5000 ids and five bits of 33 million: no other row is taken for one of them
        assert {r.doc_id for r in got} == {i for i in ids if i != -3}


def test_search_equals_all_pairs_and_shared_shingles_are_not_read(monkeypatch):
    rng = np.random.default_rng(9)
    for _ in range(20):
        base = [set(rng.choice(200, rng.integers(1, 40), replace=False).tolist()) for _ in range(5)]
        sets = []
        for _ in range(60):
            b = set(base[rng.integers(5)])
            for _ in range(rng.integers(0, 5)):
                if b:
                    b.discard(sorted(b)[rng.integers(len(b))])
                b.add(int(rng.integers(300)))
            sets.append(np.array(sorted(b), np.uint64))
        label = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
        assert near_copies.search(sets).tolist() == label
    # pages of one template: 15 shingles of 20 are common to all, and no two are compared
    pages = [np.concatenate([np.arange(15), 1000 + 5 * i + np.arange(5)]).astype(np.uint64) for i in range(20_000)]
    compared = []
    real = np.add.reduceat
    monkeypatch.setattr(near_copies.np, "add", type("Add", (), {"reduceat": staticmethod(lambda *a: compared.append(len(a[1])) or real(*a))}))
    assert (near_copies.search(pages) == np.arange(20_000)).all() and sum(compared) <= 20_000


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(80)]
    other = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    # 5 and 9 are too far from each other, the row between them is close to both
    rows = [(5, other(20)), (9, other(50)), (None, other()), (None, "alone " * 9), (None, None)]
    ends = {r.doc_id: r.group for r in near_copies.near_copies(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}
    assert ends == {5: 5, 9: 9}
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.group or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (5, 5), (9, 5)]
    kept_rows = near_copies.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in kept_rows) == [0, 0, 0, 5]


def test_fingerprints_bring_candidates_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 20_000)]
    fingerprint = lambda t: near_copies.simhash.majority(near_copies.shingles(t.encode(), near_copies.word_hashes()))
    changed = (" ".join(["x" if i % 5 == 0 and i < 5 * k else w for i, w in enumerate(words)]) for k in range(1, 200))
    other = next(t for t in changed if fingerprint(t) != fingerprint(" ".join(words)))
    rows = [(7, " ".join(words)), (4, other), (2, " ".join(words[::-1]))]
    near = [fingerprint(t) for _, t in rows]
    assert (near[0] ^ near[1]).bit_count() <= near_copies.simhash.DISTANCE < (near[0] ^ near[2]).bit_count()
    # without a band that agrees, the index of fingerprints alone brings the two together
    apart = lambda sets: np.array([[int(x.sum()) + b for b in range(24)] for x in sets], np.uint64)
    monkeypatch.setattr(near_copies, "band_keys", apart)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group for r in near_copies.near_copies(docs).collect()} == {7: 4, 4: 4, 2: 2}
