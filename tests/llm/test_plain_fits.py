"""The trained models against plain single-process versions."""

import zlib

import numpy as np

from stylemill.llm import quality_classifier, toxicity
from stylemill.llm.common import Memo, offsets


def test_quality_scores_are_those_of_a_plain_fit(spark, documents, labels, texts):
    import xxhash

    q = quality_classifier
    hashes = Memo(xxhash.xxh64_intdigest)
    x = {i: np.array(q.statistics(t.encode(), hashes), np.float32).astype(float) for i, t, _ in texts}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in x}
    y = {r.doc_id: float(r.quality) for r in labels.collect() if r.doc_id in x}
    taught = np.array([x[i] for i in x if fold[i]])
    features = q.Features(taught.mean(0), taught.std(0))
    fit = [i for i in y if 0 < fold[i] < 4]
    z, t = features(np.array([x[i] for i in fit])), np.array([y[i] for i in fit])
    weights = np.linalg.solve(z.T @ z + max(1, len(fit)) * q.RIDGE * np.eye(z.shape[1]), z.T @ t)
    n, pos = np.zeros(q.BINS), np.zeros(q.BINS)
    for i in y:
        if fold[i] == 4:
            k = int(q.bins(features(x[i][None]) @ weights)[0])
            n[k] += 1
            pos[k] += y[i]
    curve = q.isotonic(n, pos)
    rows = {r.doc_id: r for r in q.classify(documents, labels).collect()}
    for i in x:
        raw = float((features(x[i][None]) @ weights)[0])
        assert abs(rows[i].raw - raw) < 1e-6 and rows[i].held_out == (fold[i] == 0)
        near = {float(curve[int(q.bins(np.array([raw + e]))[0])]) for e in (-1e-6, 0, 1e-6)}
        assert any(abs(rows[i].score - s) < 1e-9 for s in near) and rows[i].predicted == (rows[i].score >= 0.3)


def naive(net, words):
    """The toxicity logit of one text, from rows of buckets, by sliding each filter over the words."""
    e = [net.p["e"][r].sum(0) for r in words]
    top = []
    for w in toxicity.WIDTHS:
        best = np.full(toxicity.FILTERS, -np.inf)
        for k in range(len(e)):
            best = np.maximum(best, sum(e[k + j] @ net.p[f"f{w}"][j] for j in range(w) if k + j < len(e)))
        top.append(np.maximum(best + net.p[f"b{w}"], 0))
    return float(np.concatenate(top) @ net.p["v"] + net.p["c"][0])


def test_convolutions_are_those_of_sliding_filters_and_gradients_of_differences():
    net = toxicity.Net(["de", "en"])
    net.p["e"] *= 20
    for k in ("b1", "b2", "b3"):
        net.p[k] += 0.05  # away from the kink that windows of padding alone would be at
    memo = Memo(toxicity.buckets)
    groups = [toxicity.encode_text(t, memo) for t in (b"a dreadful stupid text about nothing", b"fine", b"", b"another fine text is this one here")]
    rows, bounds = np.concatenate(groups), offsets([len(g) for g in groups])
    y, lang = np.array([1.0, 0, 0, 1]), np.array([0, 1, -1, 1])

    def loss():
        z, l, _ = net.forward(np.arange(len(rows)), bounds, {k: v.astype(float) if k == "l" else [x.astype(float) for x in v] for k, v in net.project(net.embed(rows)).items()})
        q = l - np.log(np.exp(l).sum(1, keepdims=True))
        return np.mean(np.logaddexp(0, z) - y * z) - sum(q[i, g] for i, g in enumerate(lang) if g >= 0) / len(y)

    z, _, _ = net.forward(np.arange(len(rows)), bounds, net.project(net.embed(rows)))
    assert np.allclose(z, [naive(net, g) for g in groups], atol=1e-4)
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(rows, bounds, y, lang, 0.0)  # the first moments are a tenth of the gradients
    grads = {k: v * 10 for k, v in net.m.items()}
    net.p = before
    rng = np.random.default_rng(0)
    for k in ("v", "c", "l", "lc", "f2", "b3", "f1"):
        flat = net.p[k].reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            keep, e = flat[i], 1e-3
            flat[i] = keep + e
            up = loss()
            flat[i] = keep - e
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * e) - grads[k].reshape(-1)[i]) < 2e-3, (k, i)


def test_sample_is_bounded_by_bytes():
    from pyspark.sql import Row

    rows = [Row(doc_id=i, y=i % 2, bytes=b, h=i) for i, b in enumerate([40, 10, 30, 45, 20, 10])]
    assert toxicity.within(rows, 100) == [(0, 0), (1, 1), (5, 1)]
