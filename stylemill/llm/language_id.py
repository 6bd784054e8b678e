"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum, over
all its segmentations into pieces, of the product of their probabilities, found by the forward recursion; a text's is
the product over its words, reduced to their letters in lower case. The probabilities are fitted by
expectation-maximisation on word counts of a bounded sample of the training rows, about SAMPLE texts of each language,
those with the least hash of their id.

A null text, or one without a letter, is `und` with score 0; so is every text if there is no training row. Ties go to
the first language in order. Repeated rows are predicted alike; null doc_ids count as fold 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import Memo, documents, fold, map_batches, materialise, texts

SAMPLE, ROUNDS, SMOOTH = 3000, 2, 0.05
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def normalise(word: bytes) -> str:
    """The word mark and the letters in lower case; empty without a letter."""
    s = word.decode("utf-8", "replace")
    if not s.isalpha():
        s = _OTHER.sub("", s)
        if not _LETTER.search(s):
            return ""
    return lattice.MARK + s.lower()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = Memo(normalise, 200_000), {}

        def flush() -> pa.RecordBatch:
            keys, n = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for t, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                for w in t.split():
                    k = lang, memo[w]
                    counts[k] = counts.get(k, 0) + 1
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    rows = map_batches(documents(docs, "lang"), run, "lang string, word string, n long").where("word <> ''")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expectation(counts: DataFrame, languages: list[str], p: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language]: each partition adds up its words', executors add up the partitions'."""
    v = lattice.vocabulary()
    size = len(v.pieces) + 1
    shared = counts.sparkSession.sparkContext.broadcast(p)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = lattice.vocabulary(), shared.value
        total, known = np.zeros(size * len(languages)), {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang, n, words = np.array([known[x] for x in batch.column("lang").to_pylist()], np.int64), batch.column("n").to_numpy(), batch.column("word").to_pylist()
            for i, j in lattice.groups(words):
                lat, own = lattice.build(words[i:j], v), lang[i:j]
                total += np.bincount(lat.piece * len(languages) + own[lat.word], lattice.edge_shares(lat, p, own) * n[i:j][lat.word], len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], names=["k", "n"])

    out = np.zeros(size * len(languages))
    for r in counts.mapInArrow(partial, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():  # pieces x languages at most
        out[r.k] = r.n
    return out.reshape(size, len(languages))


def fit(docs: DataFrame, folds: int, held: int, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and p[piece, language], from training rows with a language."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    there = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(there)
    if not languages:
        return [], np.zeros((0, 0))
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / there[k]))])
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < least[F.col("lang")] * (1 << 20))
    counts = materialise(word_counts(chosen))
    prior = np.exp(lattice.vocabulary().log_prior)[:, None]
    p = np.repeat(prior, len(languages), axis=1)
    for _ in range(ROUNDS):
        e = expectation(counts, languages, p) + SMOOTH * len(prior) * prior
        p = e / e.sum(0)
    return languages, p


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior with equal priors), margin (log10 to the runner-up) for each document."""
    docs = documents(docs, "lang")
    languages, p = fit(docs, folds, held)
    model = docs.sparkSession.sparkContext.broadcast(p)  # pieces x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = lattice.vocabulary(), model.value
        rows: dict[bytes, int] = {}  # of words as they stand; many share their letters and so a row of the table
        known: dict[str, int] = {}
        table = np.zeros((0, len(languages)))
        for batch in batches:
            words = [t.split() for t in texts(batch)]
            if len(rows) > 200_000:
                rows, known, table = {}, {}, table[:0]
            fresh = {w: normalise(w) for w in set().union(*words) - rows.keys()} if words else {}
            new = sorted(set(fresh.values()) - known.keys(), key=len)
            known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
            table = np.concatenate([table, lattice.log_likelihood(new, v, p)])
            rows.update((w, known[s]) for w, s in fresh.items())
            pred, score, margin = [], [], []
            for w in words:
                total = table[np.fromiter(map(rows.__getitem__, w), np.int64, len(w))].sum(0)
                if not languages or not w or not total.any():
                    pred.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                order = np.argsort(-total, kind="stable")
                pred.append(languages[order[0]])
                score.append(float(1 / np.exp(np.maximum(total - total[order[0]], -700)).sum()))
                margin.append(float((total[order[0]] - total[order[1]]) / np.log(10)) if len(order) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["doc_id", "lang_pred", "score", "margin"])

    found = map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, margin double")
    return found.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "margin")
