"""SimHash links through rows without an id; sampled segmentations over pieces of every kind, and their inclusion scores."""

import itertools
import math

import pytest

from stylemill.llm import lattice, simhash
from stylemill.llm import sampled_segmentation as S


def test_simhash_links_through_rows_without_an_id(spark):
    def bits(a, b):
        return bin(a ^ b).count("1")

    words = [f"w{i}" for i in range(300)]
    texts = [" ".join("x" if i == k else w for i, w in enumerate(words)) for k in range(0, 300, 5)] + [" ".join(words)]
    fp = {t: simhash.fingerprint(t.encode()) for t in texts}
    a, b, n = next((a, b, n) for a, b in itertools.combinations(texts, 2) if bits(fp[a], fp[b]) > 2 for n in texts if bits(fp[a], fp[n]) <= 2 and bits(fp[n], fp[b]) <= 2)
    run = lambda *rows: sorted((r.doc_id or 0, r.component_id) for r in simhash.op2(spark.createDataFrame(list(rows), "doc_id long, text string")).collect())
    assert run((5, a), (9, b)) == [(5, 5), (9, 9)]
    assert run((5, a), (9, b), (None, n)) == [(0, 5), (5, 5), (9, 5)]
    assert run((None, a), (None, n)) == [(0, None), (0, None)]


def test_pieces_of_letters_and_other_characters(spark):
    assert S.pre_tokens("x².y") == ["▁x", "².", "y"]
    piece = S.vocabulary().pieces.index("².")
    rows = S.encode(spark.createDataFrame([(i, "².") for i in range(200)], "doc_id long, text string"), k=2).collect()
    own = int(S.vocabulary().ids[piece])
    assert all(r.round_trip for r in rows) and any(own in r.ids for r in rows)


@pytest.mark.parametrize("text", ["the", "². a", "in of", "ab\n"])
def test_scores_against_the_enumerated_lattice(spark, text):
    """All segmentations of a short text: probabilities, and inclusion as the chance that a Gumbel there exceeds the next one."""
    v = lattice.vocabulary()
    weight = dict(zip(v.pieces, v.log_prior, strict=False))
    fallback = float(v.log_prior[-1])

    def ways(s):
        if not s:
            yield 0.0
        for n in range(1, len(s) + 1):
            w = weight.get(s[:n], fallback if n == 1 else None)
            if w is not None:
                for rest in ways(s[n:]):
                    yield w + rest

    every = [sum(x) for x in itertools.product(*(list(ways(u)) for u in S.pre_tokens(text)))]
    mass = math.log(sum(map(math.exp, every)))
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    for k in (1, 2):
        few, more = ({(r.doc_id, r["sample"]): r for r in S.encode(docs, k=n).collect()} for n in (k, k + 1))
        for (i, rank), r in few.items():
            assert min(abs(r.log_prob - (x - mass)) for x in every) < 1e-9
            assert (r.perturbed, r.ids_sha256) == (more[i, rank].perturbed, more[i, rank].ids_sha256)
            if (i, k + 1) in more:  # the next best value is the threshold
                kappa = more[i, k + 1].perturbed
                assert r.perturbed > kappa and abs(r.log_inclusion - math.log(-math.expm1(-math.exp(r.log_prob - kappa)))) < 1e-9
            else:
                assert r.log_inclusion == 0.0
