"""The operators against plain versions of what they must return."""

import collections
import hashlib
import math
import zlib

import numpy as np
import sentencepiece
import xxhash
import zstandard

import corpus_pipeline
from stylemill.llm import decontamination, katz, lattice, quality_rules, sampled_segmentation, simhash, substring_dedup, token_counts, exchange
from stylemill.llm.common import table

from .test_near_copies import kept

DATA = "/root/testdata/sf0.001"


def test_token_counts(documents, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents).collect()}
    assert got == {i: len(sp.encode(t)) for i, t, _ in texts}
    odd = ["", " ", "a  b", "  a", "a ", "a\n b", "\n\n", "tab\tx  y ", "<s>x</s> <0x0A>", "é　日本 ▁x a▁b", "a\r\nb", "▁", "x \n y  \n"]
    assert token_counts.Counter(token_counts.MODEL).count([x.encode() for x in odd]) == [len(sp.encode(x)) for x in odd]


def test_quality_rules(documents, texts):
    got = {r.doc_id: r for r in quality_rules.op6(documents).collect()}
    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for i, t, _ in texts:
        words = t.encode().split()
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)
        assert r.kept == (not failed and quality_rules.bands(t.encode(), z)[3])
    kept = {r.doc_id for r in quality_rules.keep(documents).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_quality_rules_keep_good_text(documents, labels):
    rows = quality_rules.op6(documents).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1 and not r.base_failed]) > 0.97


def fingerprints(texts):
    out = {}
    for i, t, _ in texts:
        w = t.encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def test_simhash(documents, texts):
    fp = fingerprints(texts)
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2(documents).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_gray_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 12, 600).astype(np.uint64) << np.uint64(20))
    q, at = simhash.GrayTree(codes).within(codes, 2)
    near = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), at.tolist(), strict=True)) == near


def test_links_through_upper_nodes_find_all_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 8)
    monkeypatch.setattr(simhash, "CHUNK", 5)
    monkeypatch.setattr(simhash, "DEPTH", 2)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6)]))
    codes = np.concatenate([codes, codes[:1] ^ np.uint64(7)])
    ids = rng.permutation(len(codes))
    nodes = spark.createDataFrame([(int(c.view(np.int64)), int(i)) for c, i in zip(codes, ids, strict=True)], "fp long, rep long")
    assert simhash.upper_depth(nodes) > simhash.DEPTH
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    label = ids.copy()
    while (label != (new := np.where(near, label[None, :], 1 << 30).min(1))).any():
        label = new
    from stylemill.llm.graph import components

    got = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    assert got == {int(i): int(x) for i, x in zip(ids, label, strict=True) if i != x}


def test_chain_of_fingerprints_is_one_component(spark):
    nodes = spark.createDataFrame([((1 << k) - 1, 100 - k) for k in range(0, 60, 2)], "fp long, rep long")
    from stylemill.llm.graph import components

    assert {r.component for r in components(simhash.links(nodes)).collect()} == {42}


def removed(rows, window=13):
    """rows: (id, words) -> {id: which words go}."""
    first = {}
    for i, w in sorted(rows):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = gone
    return out


def test_substring_dedup(documents, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 60_000)
    rows = [(i, t.encode().split()) for i, t, _ in texts]
    gone = removed(rows)
    want = {i: (len(w), sum(gone[i]), hashlib.sha256(b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g)).hexdigest()) for i, w in rows}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op5(documents).collect()} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_exchange_round_trip():
    rng = np.random.default_rng(2)
    keys, n = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.arange(7, dtype=np.uint32)
    a, b, c = exchange.unpack(exchange.pack(keys, n, np.zeros(0, np.int64)))
    assert (a == keys).all() and (b == n).all() and len(c) == 0


def test_katz(documents, texts, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_BYTES", 60_000)
    tokens = [(i, t.encode().lower().split() + [b" "]) for i, t, _ in texts]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens}
    c = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    total = sum(c.values()) + 0.1 * (len(c) + 1)
    pairs = collections.Counter()
    for i, ws in tokens:
        if not held[i]:
            pairs.update(zip(["start", *ws], ws, strict=False))
    n = collections.Counter(pairs.values())
    d = katz.discounts(np.array([0] + [n[r] for r in range(1, 7)]))
    prior = {w: (m + 0.1) / total for w, m in c.items()} | {None: 0.1 / total}  # None: any unknown word
    after = collections.defaultdict(dict)
    for (u, v), m in pairs.items():
        after[u][v] = m

    def history(u):
        seen = after.get(u)
        if not seen:
            return 0, 1.0
        count, freed, open_ = sum(seen.values()), sum(m * (1 - d[m]) for m in seen.values() if m <= 5), 1 - sum(prior[x] for x in seen)
        return (count, freed / count / open_) if freed > 0 else (count + 1, 1 / (count + 1) / open_)

    weights = {u: history(u) for u in {"start", *(w for _, ws in tokens for w in ws)}}

    def p(v, u):
        m, (count, alpha) = after.get(u, {}).get(v, 0), weights[u]
        return (d[m] if m <= 5 else 1) * m / count if m else alpha * prior[v if v in c else None]

    rooms = [u for u, seen in after.items() if min(seen.values()) > 5]
    assert rooms  # histories that free nothing
    for u in [*list(after)[:40], *rooms[:10]]:
        assert abs(sum(p(v, u) for v in prior) - 1) < 1e-9
    got = {r.doc_id: r for r in katz.score(documents).collect()}
    unseen = 0
    for i, ws in tokens:
        r, us = got[i], ["start", *ws[:-1]]
        unseen += sum(v not in after.get(u, {}) and u in after for u, v in zip(us, ws, strict=True))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), sum(c.values()))
        assert abs(r.base_score - sum(math.log10(prior[w if w in c else None]) for w in ws)) < 1e-6
        assert abs(r.score - sum(math.log10(p(v, u)) for u, v in zip(us, ws, strict=True))) < 1e-6
    assert unseen > 100


def test_lattice_sums_all_segmentations():
    v = lattice.vocabulary()
    p = np.exp(v.log_prior)[:, None]
    index = {x: i for i, x in enumerate(v.pieces)}
    words = ["▁the", "▁x", "▁thononith", "▁éàλ一丁ﷺ", "\n", "▁" + "ab" * 20]
    for w, got in zip(words, lattice.log_likelihood(words, v, p)[:, 0], strict=True):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * (p[index[w[i:j]], 0] if w[i:j] in index else p[-1, 0] if j - i == 1 else 0) for i in range(j))
        assert abs(got - math.log(a[-1])) < 1e-9


def test_samples_are_distinct_draws_without_replacement():
    v, n = lattice.vocabulary(), 8000
    nodes = sampled_segmentation.Nodes(v)
    paths, kappa = sampled_segmentation.sample([sampled_segmentation.pre_tokens("then a")] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), 3, nodes)
    draws = [[tuple(p.edges[p.bounds[d] : p.bounds[d + 1]]) for d in range(n)] for p, _ in paths]
    prob = {x: math.exp(p.total[d]) for (p, _), own in zip(paths, draws, strict=True) for d, x in enumerate(own)}
    assert abs(sum(prob.values()) - 1) < 1e-3 and all(len({a, b, c}) == 3 for a, b, c in zip(*draws, strict=True))
    first, pairs = collections.Counter(draws[0]), collections.Counter(zip(draws[0], draws[1], strict=True))
    for x in sorted(prob, key=prob.get)[-3:]:
        assert abs(first[x] / n - prob[x]) < 0.02
        for y in sorted(prob, key=prob.get)[-3:]:
            if x != y:
                assert abs(pairs[x, y] / n - prob[x] * prob[y] / (1 - prob[x])) < 0.02
    assert (paths[0][0].value >= paths[1][0].value).all() and (paths[2][0].value >= kappa).all()


def test_encoding_decodes_to_the_text(documents, texts):
    rows = sampled_segmentation.encode(documents).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    by = dict((i, t) for i, t, _ in texts)
    assert all(sp.decode(list(r.ids)) == by[r.doc_id] and r.round_trip for r in rows)
    assert len(rows) == 2 * len(texts) == len({(r.doc_id, tuple(r.ids)) for r in rows})
    again = {(r.doc_id, r.sample): r.ids_sha256 for r in sampled_segmentation.encode(documents.repartition(7), with_ids=False).collect()}
    assert again == {(r.doc_id, r.sample): r.ids_sha256 for r in rows}


def test_decontamination(documents, benchmark, texts):
    term = lambda t: " ".join(x for w in t.encode().split() if (x := decontamination.term(w)))
    docs = [(i, f" {term(t)} ") for i, t, _ in texts]
    exact = {(i, r.item_id) for r in benchmark.collect() for i, t in docs if f" {term(r.text)} " in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(documents, benchmark).collect()}
    assert exact and exact <= got and len(got - exact) <= 1


def index_of(benchmark):
    items = decontamination.parsed_items(benchmark)
    return decontamination.indexes(items.collect(), decontamination.postings(items).collect())


def test_wand_retrieves_what_exhaustive_scoring_does(benchmark, texts):
    (index,) = index_of(benchmark)
    rng = np.random.default_rng(3)
    some = 0
    for _ in range(200):
        words = set(rng.integers(0, len(index.terms), 40).tolist()) | {index.terms[w] for w in index.items[rng.integers(len(index.items))][1] if rng.random() < 0.75}
        scores, bound = collections.Counter(), np.zeros(index.n_blocks)
        for t in words:
            for i, x in zip(index.item[index.start[t] : index.start[t + 1]], index.share[index.start[t] : index.start[t + 1]], strict=True):
                scores[int(i)] += x
            for k in range(index.block_start[t], index.block_start[t + 1]):
                bound[index.block[k]] += index.most[k]
        got = {i for i, _ in index.wand(sorted(words), set(np.flatnonzero(bound >= decontamination.RETRIEVE).tolist()))}
        assert got == {i for i, s in scores.items() if s >= decontamination.RETRIEVE}
        some += len(got)
    assert some


def exhaustive(docs, items):
    """(doc, item) pairs: BM25 of every passage and item over the whole benchmark, then the overlap."""
    d = decontamination
    items = [(i, *d.parsed(t)) for i, t in items]
    items = [(i, q, a) for i, q, a in items if q + a]
    df = collections.Counter(w for _, q, a in items for w in set(q + a))
    n, mean = len(items), sum(len(q + a) for _, q, a in items) / len(items)
    longest = collections.defaultdict(lambda: d.LEAST)
    for _, q, a in items:
        c = d.length_class(len(q + a))
        longest[c] = max(longest[c], len(q + a))
    out = set()
    for k, (item_id, q, a) in enumerate(items):
        impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (d.K1 + 1) / (f + d.K1 * (1 - d.B + d.B * len(q + a) / mean)) for w, f in collections.Counter(q + a).items()}
        own, size = sum(impact.values()), longest[d.length_class(len(q + a))]
        for doc_id, text in docs:
            words = [x for w in text.encode().split() if (x := d.term(w))]
            for s in range(0, max(1, len(words) - size), size):
                p = words[s : s + 2 * size]
                if sum(impact.get(w, 0) for w in set(p)) / own >= d.RETRIEVE:
                    sh = d.shingles(p)
                    if d.overlap(d.shingles(q), sh, p) >= d.OVERLAP and d.overlap(d.shingles(a), sh, p) >= d.OVERLAP or d.overlap(d.shingles(q + a), sh, p) >= d.OVERLAP:
                        out.add((doc_id, item_id))
    return out


def test_decontamination_by_exhaustive_scoring(spark, documents, benchmark, texts, monkeypatch):
    by = {i: t for i, t, _ in texts}
    long = by[max(by, key=lambda i: len(by[i]))].split()
    # a long item and parts of it and of others, changed here and there
    items = [(r.item_id, r.text) for r in benchmark.collect()] + [(10_001, " ".join(long[100:700]) + ". And so it ends."), (10_002, "..."), (10_003, None)]
    base = [t for _, t in items[:40]]
    extra = [(100_000 + i, f"some words before {t} and after".replace(" the ", " a ")) for i, t in enumerate(base)] + [(200_000, " ".join(long[:90] + long[150:720])), (200_001, " ".join(long[100:300])), (200_002, " ".join(base))]
    docs = [(i, t) for i, t in by.items() if i % 4 == 0] + extra
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = exhaustive(docs, items)
    rows = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(frame, bench).collect()}
    assert set(rows) == want and (200_000, 10_001) in want and len(want) > 40
    # the same, whatever the size of the parts it is searched in
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 6000)
    again = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(frame, bench).collect()}
    assert again.keys() == rows.keys() and all(abs(again[k] - x) < 1e-9 for k, x in rows.items())


def test_pipeline_stages_by_brute_force(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, DATA)
        if name == "near_duplicates":
            assert {r.doc_id for r in out.collect()} == kept(rows)
        if name == "substring_dedup":
            split = [(i, t.encode().split()) for i, t in rows]
            gone = removed(split)
            want = {i: t if not any(gone[i]) else " ".join(x.decode() for x, g in zip(w, gone[i], strict=True) if not g) for (i, w), (_, t) in zip(split, rows, strict=True)}
            assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in want.items() if t}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "decontamination":
            bad = {r.doc_id for r in decontamination.leaks(docs, table(spark, DATA, "benchmark")).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} - bad
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "encoding" else out
    assert docs.count() > 0
