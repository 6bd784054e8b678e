"""Words and pre-tokens of any length, and texts with word marks, against the library and plain recursions."""

import math
import random
import zlib

import numpy as np
import sentencepiece

from stylemill.llm import lattice, language_id, sampled_segmentation, token_counts

DATA = "/root/testdata/sf0.001"


def test_token_counts_of_random_strings():
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    rng = random.Random(5)
    alphabet = ["▁"] * 4 + [" "] * 4 + list("aeinst,.\n\n\t\r0é漢字́\x00")
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 24))) for _ in range(100_000)] + ["▁▁ ▁ a", "▁  ", "▁ 漢字", "▁", " ▁", "▁\n▁ \n "]
    got = token_counts.Counter(token_counts.MODEL).count([t.encode() for t in texts])
    assert got == [len(x) for x in sp.encode(texts)]


def plain_sum(word, p, index):
    """log of the sum over all segmentations; p: logs."""
    a = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        xs = [a[i] + p[index[word[i:j]]] for i in range(max(0, j - 16), j) if word[i:j] in index]
        if word[j - 1] not in index:
            xs.append(a[j - 1] + p[-1])
        top = max(xs)
        a[j] = top + math.log(sum(math.exp(x - top) for x in xs))
    return a[-1]


def test_lattices_of_long_words():
    v = lattice.vocabulary()
    index = {x: i for i, x in enumerate(v.pieces)}
    words = ["▁the", "▁" + "straßenverkehr" * 15, "漢字" * 100, "▁a", "▁" + "ab" * 1000, "▁b" + "é" * 47]
    got = lattice.log_likelihood(words, v, np.exp(v.log_prior)[:, None])[:, 0]
    for w, x in zip(words, got, strict=True):
        assert abs(x - plain_sum(w, v.log_prior, index)) < 1e-6 * max(1, abs(x))
    # shares of the edges that leave a node sum to one, in logarithms as in scaled numbers, and agree between both
    short = lattice.build(["▁straßen"], v)
    both = lattice.build(["▁straßen", "x" * 200], v)
    a, b = lattice.step_shares(short, np.exp(v.log_prior)), lattice.step_shares(both, np.exp(v.log_prior))
    assert np.allclose(a, b[both.word == 0]) and np.allclose(np.bincount(both.start[both.word == 1], b[both.word == 1]), 1)
    e, f = (lattice.edge_shares(x, np.exp(v.log_prior)[:, None], np.zeros(len(x.size), np.int64)) for x in (short, both))
    assert np.allclose(e, f[both.word == 0])


def test_long_pre_tokens_are_segmented_whole(spark):
    units = sampled_segmentation.pre_tokens("漢" * 121 + " " + "a" * 300)
    assert [len(u) for u in units] == [122, 301]
    text = "漢字仮名" * 60 + " " + "straßenverkehr" * 40 + "  " + "😀" * 70 + " x\n\n" + "=" * 500
    docs = spark.createDataFrame([(1, text), (2, "a"), (3, text)], "doc_id long, text string")
    rows = sampled_segmentation.encode(docs, k=3).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    assert all(r.round_trip and sp.decode(list(r.ids)) == (text if r.doc_id != 2 else "a") for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id == 1}) == 3
    # the first sample's probability is that of its pieces among all segmentations of each pre-token
    v = lattice.vocabulary()
    index, place = {x: i for i, x in enumerate(v.pieces)}, {int(i): k for k, i in enumerate(v.ids)}
    for r in rows:
        if r.doc_id == 3 and r.sample == 1:
            bytes_ = set(v.byte_ids.tolist())
            total = sum(v.log_prior[place[i]] for i in r.ids if i not in bytes_)
            bare = sum(c not in index for u in sampled_segmentation.pre_tokens(text) for c in u)
            want = total + bare * v.log_prior[-1] - sum(plain_sum(u, v.log_prior, index) for u in sampled_segmentation.pre_tokens(text))
            assert abs(r.log_prob - want) < 1e-6 * abs(want)


def test_language_id_end_to_end(documents, texts):
    """Sample all training rows, fit and predict in plain Python."""
    v = lattice.vocabulary()
    index = {x: i for i, x in enumerate(v.pieces)}
    chosen = [(i, t, g) for i, t, g in texts if zlib.crc32(str(i).encode()) % 3 != 1 and g]
    rows = {r.doc_id: r for r in language_id.identify(documents).collect()}
    languages = sorted({g for _, _, g in chosen})
    counts = {}
    for _, t, g in chosen:
        for w in t.encode().split():
            if s := language_id.normalise(w):
                counts[g, s] = counts.get((g, s), 0) + 1

    def edges(w):
        return [(i, j, index[w[i:j]]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 16) + 1) if w[i:j] in index] + [(i, i + 1, len(v.pieces)) for i, c in enumerate(w) if c not in index]

    lattices = {s: edges(s) for s in {s for _, s in counts}}
    prior = np.exp(v.log_prior)
    p = {g: prior for g in languages}
    for _ in range(language_id.ROUNDS):
        e = {g: language_id.SMOOTH * len(prior) * prior for g in languages}
        for (g, s), n in counts.items():
            a, b, own = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0], lattices[s]
            for i, j, x in sorted(own, key=lambda y: y[1]):
                a[j] += a[i] * p[g][x]
            for i, j, x in sorted(own, key=lambda y: -y[0]):
                b[i] += p[g][x] * b[j]
            for i, j, x in own:
                e[g][x] += n * a[i] * p[g][x] * b[j] / a[-1]
        p = {g: x / x.sum() for g, x in e.items()}
    logs = {g: np.log(x) for g, x in p.items()}
    memo = {}
    for i, t, _ in texts[::7]:
        z = np.zeros(len(languages))
        for w in t.encode().split():
            s = language_id.normalise(w)
            if s and s not in memo:
                memo[s] = np.array([plain_sum(s, logs[g], index) for g in languages])
            z += memo.get(s, 0)
        if z.any():
            post = np.exp(z - z.max())
            assert rows[i].lang_pred == languages[int(z.argmax())] and abs(rows[i].score - post.max() / post.sum()) < 1e-6
        else:
            assert rows[i].lang_pred == "und"
