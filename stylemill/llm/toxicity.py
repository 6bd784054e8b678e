"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words, lower-cased and stripped to letters, are hashed to embeddings; filters of several widths slide over the word
sequence and the largest response of each filter over the whole text feeds a logistic output. A second output, on the
mean embedding, guesses the language, learnt from the training rows' lang column; the decision threshold of each
language is calibrated on all labelled rows but those trained on, and shifts that language's logits so that 0.5 is its
threshold.

The fit uses a bounded sample: four fifths of at most SAMPLE labelled rows of each class and SAMPLE_BYTES of text, those with the
least hash of their id; a row that would exceed the bytes is left out whole, so the driver's memory is bounded. Calibration counts all others in bins of their logits, and weights each class so that it has its share of all labelled
rows. Texts are read once for the logits, partition by partition, without a shuffle; only those numbers meet the labels.

Null and empty texts get the score of a text without words; labels with nulls teach nothing; repeated rows are scored
alike; without labels of both classes every score is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, fold, map_batches, materialise, offsets, texts

SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS, BATCH, RATE, DECAY, SEED = 1 << 15, 12, (1, 2, 3), 8, 10, 32, 0.02, 1e-2, 11
#: Width of the bins of logits that the thresholds are found in.
BIN = 0.01
#: A word's embedding is the sum of those of the word itself and of its beginnings of these lengths, so that inflected forms share.
STEMS = (4, 5, 7)
_LETTERS = re.compile(r"[^\W\d_]+")


def buckets(word: bytes) -> list[int]:
    """Hashes of a word's letters in lower case and of its longer beginnings; 0, whose embedding stays zero, for what it lacks."""
    letters = "".join(_LETTERS.findall(word.decode("utf-8", "replace").lower()))
    parts = [letters] + [f"{letters[:n]}-" if len(letters) > n else "" for n in STEMS]
    return [1 + xxhash.xxh32_intdigest(x.encode()) % (BUCKETS - 1) if x else 0 for x in parts]


def encode_text(text: bytes, memo: Memo) -> np.ndarray:
    """The buckets of all words, then as many words without any as the widest filter needs."""
    rows = [memo[w] for w in text.split()]
    return np.array(rows + [[0] * (1 + len(STEMS))] * max(WIDTHS), np.int32)


class Net:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = max(1, len(languages))
        self.languages = languages
        self.p = {"e": rng.standard_normal((BUCKETS, DIM)) * 0.02, "v": rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3, "c": np.zeros(1), "l": rng.standard_normal((DIM, n)) * 0.3, "lc": np.zeros(n)}
        self.p |= {f"f{w}": rng.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
        self.p["e"][0] = 0
        self.m, self.s, self.t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.p["e"][rows].sum(1)

    def project(self, embedded: np.ndarray) -> dict:
        """What each word adds to each filter position and to the language logits; a convolution is then a sum of lookups."""
        return {w: [(embedded @ self.p[f"f{w}"][k]).astype(np.float32) for k in range(w)] for w in WIDTHS} | {"l": (embedded @ self.p["l"]).astype(np.float32)}

    def forward(self, x: np.ndarray, bounds: np.ndarray, tables: dict) -> tuple[np.ndarray, np.ndarray, dict]:
        """Toxicity logits, language logits and filter responses; x are rows of the tables."""
        r = {}
        for w in WIDTHS:
            r[w] = tables[w][0][x]
            for k in range(1, w):
                r[w][:-k] += tables[w][k][x[k:]]
                r[w][bounds[1:] - k] = -np.inf  # these reach into the next text
        top = np.hstack([np.maximum.reduceat(r[w], bounds[:-1], axis=0) + self.p[f"b{w}"] for w in WIDTHS])
        lang = np.add.reduceat(tables["l"][x], bounds[:-1], axis=0) / np.diff(bounds)[:, None] + self.p["lc"]
        return np.maximum(top, 0) @ self.p["v"] + self.p["c"], lang, r

    def step(self, rows: np.ndarray, bounds: np.ndarray, y: np.ndarray, lang: np.ndarray, rate: float) -> None:
        """One Adam step on the two heads' mean losses; max pooling sends gradients to the winning positions alone."""
        emb, n = self.embed(rows), len(y)
        z, l, r = self.forward(np.arange(len(rows)), bounds, self.project(emb))
        at = {w: np.stack([r[w][a:b].argmax(0) + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) for w in WIDTHS}
        pre = np.hstack([np.take_along_axis(r[w], at[w], 0) + self.p[f"b{w}"] for w in WIDTHS])
        h = np.maximum(pre, 0)
        d = (1 / (1 + np.exp(-z)) - y) / n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"], g["c"] = h.T @ d, d.sum(keepdims=True)
        dh, de = np.outer(d, self.p["v"]) * (pre > 0), np.zeros_like(emb)
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = part.sum(0)
            for k in range(w):
                word = np.minimum(at[w] + k, len(rows) - 1)
                g[f"f{w}"][k] = np.einsum("nfd,nf->df", emb[word], part)
                np.add.at(de, word.ravel(), (part[:, :, None] * self.p[f"f{w}"][k].T[None]).reshape(-1, DIM))
        q = np.exp(l - l.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.flatnonzero(lang >= 0), lang[lang >= 0]] -= 1
        q[lang < 0] = 0
        q /= n
        mean = np.add.reduceat(emb, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
        g["l"], g["lc"] = mean.T @ q, q.sum(0)
        de += np.repeat(q @ self.p["l"].T / np.diff(bounds)[:, None], np.diff(bounds), axis=0)
        hit = np.flatnonzero(de.any(1))
        np.add.at(g["e"], rows[hit].ravel(), np.repeat(de[hit], rows.shape[1], axis=0))
        g["e"][0] = 0
        self.t += 1
        for k in self.p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.001 * (g[k] ** 2 - self.s[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
        self.p["e"] *= 1 - DECAY


class Lexicon(dict):
    """word -> row of the projected tables, which hold the words met so far; started anew when they are many."""

    def __init__(self, net: Net, most: int = 150_000):
        super().__init__()
        self.net, self.most, self.fresh = net, most, []
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.fresh = [[0] * (1 + len(STEMS))]  # row 0 is the padding
        self.tables, self.size = None, 1

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(buckets(word))
        self[word] = row = self.size
        self.size += 1
        return row

    def encode(self, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.size > self.most:
            self.restart()
        pad, out = np.zeros(max(WIDTHS), np.int64), []
        for t in group:
            out += [np.fromiter(map(self.__getitem__, w := t.split()), np.int64, len(w)), pad]
        if self.fresh:
            new = self.net.project(self.net.embed(np.array(self.fresh, np.int32)))
            old, self.fresh = self.tables, []
            self.tables = new if old is None else {k: np.concatenate([old[k], v]) if k == "l" else [np.concatenate(x) for x in zip(old[k], v, strict=True)] for k, v in new.items()}
        return np.concatenate(out), offsets([len(out[i]) + len(pad) for i in range(0, len(out), 2)])


def fit(rows: list[tuple[np.ndarray, float, str | None]], seed: int = SEED) -> tuple[Net, np.ndarray]:
    """rows: encoded text, label, language. The model and the places of the rows trained on, all but a fifth."""
    net = Net(sorted({r[2] for r in rows if r[2]}), seed)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    train = order[len(rows) // 5 :]
    y = np.array([r[1] for r in rows])
    lang = np.array([net.languages.index(r[2]) if r[2] else -1 for r in rows], np.int64)
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            k = train[i : i + BATCH]
            net.step(np.concatenate([rows[j][0] for j in k]), offsets([len(rows[j][0]) for j in k]), y[k], lang[k], RATE * (1 - epoch / EPOCHS))
    return net, train


def within(rows: list, most: int) -> list[tuple[int, int]]:
    """doc_id, y of the rows (doc_id, y, bytes, h) that fit into half of `most` bytes for each class, in order of h."""
    out, left = [], {0: most // 2, 1: most // 2}
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        if r.bytes <= left[int(r.y > 0)]:
            left[int(r.y > 0)] -= r.bytes
            out.append((r.doc_id, r.y))
    return out


def threshold(at: np.ndarray, toxic: np.ndarray, clean: np.ndarray, default: float = 0.0) -> float:
    """The logit with the best F1, in the middle of the gap it lies in; of logits `at`, with so many rows of each class."""
    if not toxic.sum() or not clean.sum():
        return default
    order = np.argsort(-at)
    at, hit = at[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (hit + np.cumsum(clean[order]) + toxic.sum())
    k = int(f1.argmax())
    return float((at[k] + at[k + 1]) / 2) if k + 1 < len(at) else float(at[k]) - BIN


def logit_counts(scored: DataFrame, y: DataFrame, trained: DataFrame) -> DataFrame:
    """y, lang, bin, n, seen: all labelled rows by label, guessed language and bin of the logit, and how many were trained on."""
    at = F.floor(F.least(F.greatest("z", F.lit(-30.0)), F.lit(30.0)) / BIN).alias("bin")
    both = scored.join(y, "doc_id").join(F.broadcast(trained.withColumn("seen", F.lit(1))), "doc_id", "left")
    return both.groupBy("y", "lang", at).agg(F.count("*").alias("n"), F.count("seen").alias("seen"))


def shifts(counts: list, n: int) -> list[float]:
    """The threshold of each of n languages from logit_counts; that of all languages where under 10 toxic rows are left."""
    c = np.array([(r.y, r.lang, r.bin, r.n, r.n - r.seen) for r in counts], float).reshape(-1, 5)
    c[:, 0] = c[:, 0] > 0
    total, left = ([c[c[:, 0] == y, k].sum() for y in (0, 1)] for k in (3, 4))
    weight = np.array([t / m if m else 0.0 for t, m in zip(total, left, strict=True)])[c[:, 0].astype(int)] * c[:, 4]

    def cut(own: np.ndarray, default: float) -> float:
        at, place = np.unique(c[own & (c[:, 4] > 0), 2], return_inverse=True)
        y, w = c[own & (c[:, 4] > 0), 0], weight[own & (c[:, 4] > 0)]
        return threshold((at + 0.5) * BIN, np.bincount(place, w * y, len(at)), np.bincount(place, w * (1 - y), len(at)), default)

    everywhere = cut(np.ones(len(c), bool), 0.0)
    own = [c[:, 1] == i for i in range(n)]
    return [cut(x, everywhere) if c[x & (c[:, 0] == 1), 4].sum() >= 10 else everywhere for x in own]


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_guess for each document."""
    spark = docs.sparkSession
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold("doc_id", folds) != 0).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = y.where("y = 1").orderBy(F.xxhash64("doc_id")).limit(sample).unionByName(y.where("y = 0").orderBy(F.xxhash64("doc_id")).limit(sample))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(buckets, 200_000)
        for batch in batches:
            rows = [encode_text(t, memo).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary()), batch.column("y"), batch.column("lang")], names=["doc_id", "x", "y", "lang"])

    # at most 2 x sample ids, and their join keeps the texts of all others out of the shuffle
    few = F.broadcast(spark.createDataFrame(chosen.collect(), "doc_id long, y int"))
    sizes = documents(docs, "lang").join(few, "doc_id").groupBy("doc_id", "y").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    fitting = spark.createDataFrame(within(sizes.select("doc_id", "y", "bytes", F.xxhash64("doc_id").alias("h")).collect(), SAMPLE_BYTES), "doc_id long, y int")
    found = map_batches(documents(docs, "lang").join(F.broadcast(fitting), "doc_id"), encode, "doc_id long, x binary, y int, lang string").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.x), r.lang or ""))
    rows = [(np.frombuffer(r.x, np.int32).reshape(-1, 1 + len(STEMS)), float(r.y), r.lang) for r in found]
    positive = sum(r[1] for r in rows)
    out = ["doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_guess"]
    if not 0 < positive < len(rows):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(positive / len(rows) if rows else 0.0).alias("score"), F.lit(None).cast("string").alias("lang_guess")).select(*out)
    net, train = fit(rows)
    trained = spark.createDataFrame([(i,) for i in sorted({found[j].doc_id for j in train})], "doc_id long")
    model = spark.sparkContext.broadcast(net)  # BUCKETS x DIM numbers and a few filters

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.value)
        for batch in batches:
            z, lang = [np.zeros(0)], [np.zeros(0, np.int64)]
            for group in by_size(texts(batch), 1_000_000):
                x, bounds = lexicon.encode(group)
                own, guess, _ = model.value.forward(x, bounds, lexicon.tables)
                z.append(own)
                lang.append(guess.argmax(1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(z), pa.float64()), pa.array(np.concatenate(lang), pa.int64())], names=["doc_id", "z", "lang"])

    scored = materialise(map_batches(documents(docs), score, "doc_id long, z double, lang long"))
    cuts = shifts(logit_counts(scored, y, trained).collect(), max(1, len(net.languages)))
    per = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("lang").cast("int") + 1)
    z = F.least(F.greatest(F.col("z") - per(cuts), F.lit(-30.0)), F.lit(30.0))
    return scored.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), (per(net.languages) if net.languages else F.lit(None).cast("string")).alias("lang_guess")).select(*out)


def by_size(batch: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Consecutive texts of about `most` bytes together, at least one."""
    out, size = [], 0
    for t in batch:
        if out and size + len(t) > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out
